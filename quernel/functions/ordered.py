"""Running sums, positions and exact quantiles over a total order, without one task that gets all rows.

Rows are ranged over partitions by the whole order; each partition is summed by itself, and only one total per partition
meets in one place. The ranged rows are written first, so that partition numbers cannot change. Null groups are groups
like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.durable import written

def _ranged(df: DataFrame, value: str, by: Sequence[str], few: bool = False) -> DataFrame:
    """df with _range: which range, cut at approximate quantiles within `by`, the value lies in.

    There are about two ranges for each shuffle partition, 64 at least and 4,096 at most.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << min(12, max(6, (2 * tasks - 1).bit_length()))
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    breaks = (df.groupBy(*by) if by else df).agg(F.percentile_approx(value, cuts, F.lit(4 * ranges)).alias("_breaks"))
    # one row for each group; with many groups Spark broadcasts it if it is small
    placed = match(df, F.broadcast(breaks) if few else breaks, by) if by else df.crossJoin(F.broadcast(breaks))
    placed, step = placed.withColumn("_range", F.lit(0)), ranges // 2
    while step:  # binary search, a projection a step
        placed = placed.withColumn("_range", F.col("_range") + F.when(F.get("_breaks", F.col("_range") + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return placed.drop("_breaks")


def running(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """df with, for each name in sums, the sum of its column over the rows up to this one in `order`, within `by`."""
    by = list(by)
    parts = {f"_part_{k}": c for k, c in sums.items()}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns(parts).repartitionByRange(tasks, *by, *order)
    placed = written(ranged.withColumn("_range", F.spark_partition_id()), "ranged")
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(p).alias(f"{p}_all") for p in parts])
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("_range")))
    totals = totals.select(*by, "_range", "_nth", *[F.sum(f"{p}_all").over(ahead).alias(f"{p}_before") for p in parts])
    # a partition continues one group at most: one row a partition
    out = match(placed, F.broadcast(totals.where("_nth > 1").drop("_nth")), [*by, "_range"], "left")
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({k: F.coalesce(f"_part_{k}_before", F.lit(0)) + F.sum(f"_part_{k}").over(inside) for k in sums})
    return out.select(*df.columns, *sums)


def positions(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with 1, 2, .. in `order`, within `by`; order must be total for the result to be one."""
    return running(df, order, {name: F.lit(1).cast("long")}, by)


def average_ranks(df: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the rank of `value`, ties sharing their mean rank."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running(counts, [value], {"_upto": F.col("_n")}, by)
    ranked = ranked.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return match(df, ranked, [*by, value])


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """The join on `keys`, where null equals null; the keys once, those of `left`."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


def exact_quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), name: str = "q", few: bool = False) -> DataFrame:
    """by.. and `name`: exact quantiles of the non-null values, with linear interpolation, as an array in the order of `at`.

    Rows are counted by ranges; only rows of the ranges that hold a wanted rank go on, and are sorted range by range, so
    no task holds all distinct values. few: `by` has few groups (such as columns), so the wanted ranges are broadcast.
    Without values there is no row for a group, or one row with a null where `by` is empty.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    placed = _ranged(rows, "_v", by, few)
    whole = Window.partitionBy(*by)
    totals = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))  # at most `ranges` rows for each group
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "_range", "_n", before.alias("_before"), F.sum("_n").over(whole).alias("_all"))
    place = [F.lit(float(a)) * (F.col("_all") - 1) for a in at]
    wanted = F.lit(False)
    for rank in (r for x in place for r in (F.floor(x), F.ceil(x))):
        wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")))
    wanted = totals.where(wanted).select(*by, "_range", "_before", "_all")
    kept = match(placed, F.broadcast(wanted) if few or not by else wanted, [*by, "_range"])
    counts = kept.groupBy(*by, "_range", "_before", "_all", "_v").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    ends = [e for k, x in enumerate(place) for e in (value_at(F.floor(x)).alias(f"_low{k}"), value_at(F.ceil(x)).alias(f"_high{k}"), F.max(x - F.floor(x)).alias(f"_part{k}"))]
    found = (ranked.groupBy(*by) if by else ranked).agg(*ends)
    low, high, part = ([F.col(f"_{x}{k}") for k in range(len(place))] for x in ("low", "high", "part"))
    q = F.array(*[F.when(a == b, a).otherwise(a + (b - a) * c) for a, b, c in zip(low, high, part, strict=True)])
    return found.select(*by, (q if by else F.when(F.col("_low0").isNotNull(), q)).alias(name))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(F.explode(cells).alias("_c")).select("_c.feature", "_c.value")
    got = {r["feature"]: r["q"][0] for r in exact_quantiles(rows, "value", [0.5], ["feature"], few=True).collect()}  # one row a column
    return {c: got.get(c) for c in columns}
