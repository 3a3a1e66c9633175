"""Readers by file extension, uploads, listings and sinks."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
import pyarrow.feather
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.sources.feather import read_feather, write_feather

Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {}


def register_reader(*extensions: str) -> Callable[[Reader], Reader]:
    def put(f: Reader) -> Reader:
        for e in extensions:
            READERS[e.lower()] = f
        return f

    return put


@register_reader(".csv")
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


register_reader(".feather", ".ft")(read_feather)


@register_reader(".parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@register_reader(".pkl", ".pickle")
def refuse_pickle(spark: SparkSession, path: str) -> DataFrame:
    raise ValueError("pickle files run code when they are read; save the data as Parquet, Feather or CSV")


def extension(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def from_path(spark: SparkSession, path: str) -> DataFrame:
    e = extension(path)
    if e not in READERS:
        raise ValueError(f"no reader for {e or 'files without extension'}; there are {', '.join(sorted(READERS))}")
    return READERS[e](spark, path)


def from_bytes(spark: SparkSession, data: bytes, name: str, fall_back: str | None = None) -> DataFrame:
    """A frame from an uploaded file's bytes; fall_back: the extension to assume for unknown ones (such as .csv)."""
    e = extension(name)
    if e not in (".csv", ".feather", ".ft", ".parquet"):
        if fall_back is None:
            raise ValueError(f"can't read uploads with extension {e or '(none)'}")
        e = fall_back
    source = io.BytesIO(data)
    if e == ".csv":
        table = pyarrow.csv.read_csv(source)
    elif e == ".parquet":
        table = pyarrow.parquet.read_table(source)
    else:
        table = pyarrow.feather.read_table(source)
    return spark.createDataFrame(table)


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = (".csv", ".feather", ".parquet")) -> list[str]:
    """The files of a folder with one of the extensions, by name, on any file system that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [str(s.getPath().toString()) for s in fs.listStatus(path)]
    return sorted(n for n in names if extension(n) in extensions)


@dataclass(frozen=True)
class SyntheticDataset:
    data: DataFrame
    factors: DataFrame


def synthetic(spark: SparkSession, rows: int = 5000, groups: int = 15, seed: int = 42) -> SyntheticDataset:
    """Machines' hourly measurements with two targets; every value depends on the row number and the seed alone."""

    def u(k: int):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(2**40)) + 0.5) / 2**40

    def normal(k: int):
        return F.sqrt(-2 * F.log(u(k))) * F.cos(2 * 3.141592653589793 * u(k + 1000))

    machine, batch = F.floor(u(1) * groups), F.floor(u(2) * (groups // 3 + 1))
    t = F.lit("2020-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("id").cast("int"))
    base = spark.range(rows).select(
        "id", t.alias("timestamp"), machine.alias("m"), batch.alias("b"),
        (-3 * (F.log(u(3)) + F.log(u(4))) + 0.05 * machine).alias("runtime_hours"),
        (20 + 3 * normal(5) + 0.1 * batch).alias("temperature"), (5 + normal(6) + 0.02 * machine).alias("pressure"), normal(7).alias("vibration"),
        F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.floor(u(8) * 5) + 1).cast("int")).alias("operator"),
    )
    wave = F.sin(F.col("id") * (12 * 3.141592653589793 / max(1, rows - 1)))
    main = 0.3 * F.col("runtime_hours") + 0.8 * F.col("temperature") - 0.5 * F.col("pressure") + 0.2 * wave + 0.5 * normal(9)
    data = base.withColumn("target_main", main).withColumn("target_secondary", 0.8 * F.col("target_main") + 0.3 * normal(10))
    data = data.select("timestamp", F.col("m").cast("string").alias("machine_id"), F.col("b").cast("string").alias("batch_id"), "runtime_hours", "temperature", "pressure", "vibration", "operator", "target_main", "target_secondary")
    return SyntheticDataset(data, spark.createDataFrame([("target_main",), ("target_secondary",)], "FactorName string"))


def named_dataset(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """The data set `name`: the file of that name in a folder, with any extension that has a reader."""
    for e in sorted(READERS):
        if extension(f"x{e}") in READERS and any(p.endswith(f"/{name}{e}") for p in list_files(spark, folder, (e,))):
            return from_path(spark, f"{folder}/{name}{e}")
    raise ValueError(f"no data set {name} in {folder}")


def dataset_split(spark: SparkSession, name: str, folder: str, target: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a named data set, with equal class shares."""
    from quernel.operators.splits import stratified_split

    return stratified_split(named_dataset(spark, name, folder), target, test, seed)


def persist(bundle: SyntheticDataset, folder: str, kind: str = "parquet") -> None:
    """Data and factor table under a folder, as Parquet or Feather."""
    for name, df in (("data", bundle.data), ("factors", bundle.factors)):
        if kind == "feather":
            write_feather(df, f"{folder}/{name}", "overwrite")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
