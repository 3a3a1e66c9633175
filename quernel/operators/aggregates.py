"""Column surveys and grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.ordered import exact_quantiles, match

def long_form(df: DataFrame, columns: Sequence[str], kind: str = "string", keep: Sequence[str] = ()) -> DataFrame:
    """(keep.., feature, value): one row per column, so that one aggregate serves all columns."""
    cols = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*keep, F.explode(cols).alias("_f")).select(*keep, "_f.feature", "_f.value")


def column_survey(df: DataFrame, columns: Sequence[str], rare_below: float = 0.01) -> DataFrame:
    """feature, cardinality (null is no value), unique_ratio, rare_share, missing_rate, most_common_freq.

    Shares are of all rows; null counts as a category in rare_share (the share of rows in categories with a share below
    rare_below) and most_common_freq.
    """
    counts = long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n"))
    counts = counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).withColumn("share", F.col("n") / F.col("total"))  # one row
    return counts.groupBy("feature").agg(
        F.count("value").alias("cardinality"),
        (F.count("value") / F.sum("n")).alias("unique_ratio"),
        F.coalesce(F.sum(F.when(F.col("share") < rare_below, F.col("share"))), F.lit(0.0)).alias("rare_share"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("share"))), F.lit(0.0)).alias("missing_rate"),
        F.max("share").alias("most_common_freq"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, share; null is a value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))  # total: one row


def group_stats(df: DataFrame, group: str, target: str) -> DataFrame:
    """group, mean, n (targets that are not null), total; null is a group."""
    return df.groupBy(group).agg(F.avg(target).alias("mean"), F.count(target).alias("n"), F.sum(target).alias("total"))


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, mean_value, std_value, count, ci95."""
    out = df.groupBy(F.col(group).alias("group")).agg(F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"), F.count(value).alias("count"))
    return out.withColumn("ci95", 1.96 * F.col("std_value") / F.sqrt(F.greatest("count", F.lit(1))))


def group_coverage(splits: dict[str, DataFrame], group: str) -> DataFrame:
    """group, split, count, share within the split (four decimals), by split and falling share."""
    parts = [df.select(F.col(group).cast("string").alias("group"), F.lit(name).alias("split")) for name, df in splits.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("group", "split").agg(F.count("*").alias("count"))
    totals = rows.groupBy("split").agg(F.count("*").alias("total"))
    counts = counts.join(F.broadcast(totals), "split")  # one row for each of `splits`
    share = F.bround(F.col("count") / F.col("total"), 4)
    return counts.select("group", "split", "count", share.alias("share")).orderBy("split", F.desc("share"), "group")


def time_buckets(df: DataFrame, ts: str, value: str, days: int = 7) -> DataFrame:
    """bucket, mean, std, n per `days` days from midnight of the first row's day; empty buckets are rows too."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01"))
    first = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    spine = first.where("first is not null").select("first", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / days).cast("int"))).alias("k"))
    rows = df.where(F.col(ts).isNotNull()).select(day.alias("day"), F.col(value).alias("v"))
    stats = rows.crossJoin(F.broadcast(first)).groupBy(F.floor((F.col("day") - F.col("first")) / days).cast("int").alias("k"))  # first: one row
    stats = stats.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"))
    bucket = F.date_add(F.lit("1970-01-01").cast("date"), F.col("first") + F.col("k") * days)
    return spine.join(stats, "k", "left").select(bucket.cast("timestamp_ntz").alias("bucket"), "mean", "std", F.coalesce("n", F.lit(0)).alias("n"))


def top_groups(df: DataFrame, group: str, value: str, n: int = 10) -> DataFrame:
    """The n groups with the highest mean: group, mean, std, n."""
    out = df.groupBy(F.col(group).alias("group")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return out.orderBy(F.desc("mean"), "group").limit(n)


def histogram(df: DataFrame, value: str, breaks: Sequence[float], density: bool = False) -> DataFrame:
    """bin, n (and density): counts between breaks, the last bin closed; values outside are dropped; empty bins stay."""
    from quernel.functions.scalars import histogram_bin

    spark = df.sparkSession
    counts = df.groupBy(histogram_bin(F.col(value), breaks).alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    edges = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(breaks[:-1], breaks[1:], strict=True))], "bin long, low double, high double")
    out = edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if density:
        out = out.withColumn("density", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy())) / (F.col("high") - F.col("low")))
    return out


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> DataFrame:
    """feature and q: exact quantiles by linear interpolation."""
    return exact_quantiles(long_form(df, columns, "double"), "value", at, ["feature"], few=True)


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, mean, low, high."""
    return long_form(df, columns, "double").groupBy("feature").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def largest_groups(df: DataFrame, group: str, n: int = 4) -> DataFrame:
    return df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group").limit(n)


def describe_importance(df: DataFrame, feature: str, importance: str) -> DataFrame:
    """feature, mean, median, min, max, std (population) of repeated importances."""
    x = F.col(importance)
    out = df.groupBy(F.col(feature).alias("feature")).agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"))
    middle = exact_quantiles(df.select(F.col(feature).alias("feature"), x.alias("value")), "value", [0.5], ["feature"])
    return match(out, middle, ["feature"], "left").select("feature", "mean", F.get("q", F.lit(0)).alias("median"), "min", "max", "std")


def mean_abs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, importance: the mean absolute contribution of each column."""
    return long_form(df, columns, "double").groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))


def fold_means(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return df.groupBy(metric).agg(F.avg(value).alias(value))


def jaccard_mean(df: DataFrame, fold: str, item: str) -> DataFrame:
    """mean Jaccard similarity of the folds' item sets over all pairs of folds; none: 0, one: 1.

    Pairs are counted by their items in common, so a fold's set is never gathered.
    """
    items = df.select(F.col(fold).alias("fold"), F.col(item).alias("item")).distinct()
    sizes = items.groupBy("fold").agg(F.count("*").alias("size"))
    a, b = items.withColumnRenamed("fold", "a"), items.withColumnRenamed("fold", "b")
    common = a.join(b, "item").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    sa, sb = sizes.toDF("a", "size_a"), sizes.toDF("b", "size_b")
    total = common.join(sa, "a").join(sb, "b").agg(F.coalesce(F.sum(F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))), F.lit(0.0)).alias("s"))
    n = sizes.agg(F.count("*").alias("k"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return total.crossJoin(n).select(F.when(F.col("k") == 0, 0.0).when(F.col("k") == 1, 1.0).otherwise(F.col("s") / pairs).alias("jaccard"))


def linear_hsic_column(x: Column, y: Column) -> Column:
    """HSIC with linear kernels: the squared sample covariance."""
    return F.covar_samp(x, y) * F.covar_samp(x, y)
