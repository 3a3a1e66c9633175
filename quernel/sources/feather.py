"""Feather (Arrow IPC) files as a Spark data source; each file is a partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.feather  # noqa: F401  (registers the readers)
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Local paths and any scheme that pyarrow reaches (s3, gs, hdfs)."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(scheme + f.path for f in found if f.path.endswith((".feather", ".ft", ".arrow")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, at = _open(partition.path)
        with fs.open_input_file(at) as f:
            reader = pa.ipc.open_file(f)
            names = self.schema.fieldNames()
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i).select(names)


class _Message(WriterCommitMessage):
    pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema = path, schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        # named by partition, so that a second attempt replaces what a lost one left
        with fs.open_output_stream(f"{at}/part-{TaskContext.get().partitionId():05d}.feather") as f:
            with pa.ipc.new_file(f, self.schema) as writer:  # an empty partition has the schema all the same
                for b in batches:
                    writer.write_batch(b.cast(self.schema))
        return _Message()


class FeatherDataSource(DataSource):
    """spark.read.format("feather").load(path); one file, or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no feather files under {self.options['path']}")
        fs, at = _open(files[0])
        with fs.open_input_file(at) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        fs, at = _open(self.options["path"])
        if overwrite and fs.get_file_info(at).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir_contents(at)
        return _Writer(self.options["path"], to_arrow_schema(schema))


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FeatherDataSource)
    return spark.read.format("feather").load(path)


def write_feather(df: DataFrame, path: str, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(FeatherDataSource)
    df.write.format("feather").mode(mode).save(path)
