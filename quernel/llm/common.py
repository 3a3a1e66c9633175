"""Shared pieces: durable cuts of lineage, prefix sums without a hot task, connected components, column naming."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of bytes other than ASCII white space (a Java and RE2 class).
WORD = r"[^\x20\x09-\x0D]+"

_FALLBACK: dict[str, str] = {}


def per_process() -> dict:
    """Tables that a Python process makes once; never sent to another."""
    return sys.__dict__.setdefault("_quernel_tables", {})


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    return _FALLBACK.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quernel-"))


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which other applications may use as well."""
    return f"{work_dir(spark)}/quernel/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = f"{own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quernel_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    path, spark = getattr(df, "_quernel_path", None), df.sparkSession
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(spark: SparkSession) -> None:
    """Delete every table that cut() has left for this application. Results that have not been written yet need them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A table with no more rows is small enough for one task.
FEW = 10_000


def numbered(df: DataFrame, order: Sequence[Column], name: str, weight: Column | None = None, label: str = "numbered", few: bool = False) -> DataFrame:
    """df with `name`: the sum of `weight` (1 where None) over all rows before each row in `order`.

    few: df is known to have at most FEW rows, so one task sums them.

    Rows are ranged over partitions, each partition is summed by itself, and only one total per partition meets in one
    task, so no task gets all rows. The ranged rows are written first, so that partition numbers cannot change.
    """
    spark = df.sparkSession
    weight = F.lit(1) if weight is None else weight
    if few:
        ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(weight.cast("long")).over(ahead), F.lit(0)))
    part, base = fresh(df, "part_"), fresh(df, "base_")
    keys = [fresh(df, f"key_{i}_") for i in range(len(order))]
    ranged = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)], weight.cast("long").alias(base))
    ranged = ranged.repartitionByRange(tasks(spark), *keys)
    ranged = cut(ranged.withColumn(part, F.spark_partition_id()), label)
    totals = ranged.groupBy(part).agg(F.sum(base).alias("sum_"))
    before = totals.select(part, (F.sum("sum_").over(Window.orderBy(part)) - F.col("sum_")).alias("before_"))
    within = Window.partitionBy(part).orderBy(*keys)
    out = ranged.join(F.broadcast(before), part)  # one row per partition: bounded by the partition count
    out = out.withColumn(name, F.col("before_") + F.sum(base).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(base))
    return out.drop(part, base, "before_", *keys)


#: A key with over this share of all rows is hot; there are no more hot keys than its inverse.
HOT = 1 / 1024


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row per key and in `count` the key's rows in left; `count` is dropped.

    Rows of hot keys stay where they are and meet a broadcast of at most 1 / HOT rows; only the others are shuffled by
    key, so no task gets all rows of a hot key. total: the sum of `count`. how: 'inner' or 'left_semi'.
    """
    hot = F.col(count) > max(16.0, total * HOT)
    few = F.broadcast(right.where(hot).drop(count))
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), [*keys], "left_anti")
    return left.join(few, [*keys], how).unionByName(rest.join(right.where(~hot).drop(count), [*keys], how))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the components of all edges (u, v) in the batches."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    unite(label, at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def components(edges: DataFrame, label: str = "cc", few: int = 1 << 20) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b: long); root is the least node reachable.

    At most `few` distinct edges (16 bytes each) are united by one task. For more there are

    alternating large and small stars: minima are pre-aggregated and edges are joined to them, so a node with very many
    neighbours is neither gathered in one task (see join_hot) nor expanded into pairs. Each round is a written table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, label)
    n, seen = e.count(), None
    if n <= few:
        return cut(e.coalesce(1).mapInArrow(_united, "node bigint, root bigint"), label)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, ["u"], "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, ["u"], "n", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        drop_cut(e)
        drop_cut(large)
        e = done
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        n, seen = now[0], tuple(now)
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def numbered_ids(df: DataFrame, id_col: str, label: str = "ids") -> tuple[DataFrame, DataFrame | None]:
    """(df with id_col as a long, None) for integral ids; else ids become their places in their sort order, and the
    second table (place, id) gives them back. Null ids stay null."""
    kind = df.schema[id_col].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(id_col, F.col(id_col).cast("long")), None
    distinct = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    places = cut(numbered(distinct, [F.col("id")], "place", label=label), label)
    out = df.withColumnRenamed(id_col, "id").join(places, "id", "left").drop("id").withColumnRenamed("place", id_col)
    return out, places.select("place", "id")


def named_ids(df: DataFrame, places: DataFrame | None, *columns: str) -> DataFrame:
    """df with the ids back in `columns` that numbered_ids() made numbers; the columns' order stays."""
    if places is None:
        return df
    order = df.columns
    for c in columns:
        named = places.select(F.col("place").alias(c), F.col("id").alias(fresh(df, "id_")))
        df = df.join(named, c, "left").drop(c).withColumnRenamed(named.columns[1], c)
    return df.select(*order)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i] in `label` (index of a smaller member, or its own), in place."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables that end where a run of equal `keys` ends, of `least` rows or more, from batches sorted by `keys`."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.zeros(batch.num_rows, bool)  # where a run starts in this batch
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            ends[1:] |= v[1:] != v[:-1]
            ends[0] |= bool(held) and v[0] != held[-1].column(batch.schema.get_field_index(k))[-1].as_py()
        starts = np.flatnonzero(ends)
        if not len(starts) or rows + int(starts[-1]) < least:
            held.append(batch)
            rows += batch.num_rows
            continue
        at = int(starts[-1])
        head = [*held, *([batch.slice(0, at)] if at else [])]
        if head:
            yield pa.Table.from_batches(head)
        held, rows = [batch.slice(at)], batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def per_batch(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow for a function from one RecordBatch to one RecordBatch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := work(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


