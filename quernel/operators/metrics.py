"""Metrics as aggregates, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.ordered import average_ranks, exact_quantiles, match, running

Metric = Callable[[Column, Column], Column]
METRICS: dict[str, Metric] = {}


def metric(name: str) -> Callable[[Metric], Metric]:
    """Register a metric: a function of (target, prediction) columns that gives an aggregate column."""

    def put(f: Metric) -> Metric:
        METRICS[name] = f
        return f

    return put


@metric("mse")
def _mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


@metric("rmse")
def _rmse(y: Column, p: Column) -> Column:
    return F.sqrt(_mse(y, p))


@metric("mae")
def _mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


@metric("r2")
def _r2(y: Column, p: Column) -> Column:
    sse, sst = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))


@metric("medae")
def _medae(y: Column, p: Column) -> Column:
    return F.percentile(F.abs(y - p), 0.5)


@metric("bias")
def _bias(y: Column, p: Column) -> Column:
    return F.avg(p - y)


def evaluate(df: DataFrame, target: str, prediction: str, names: Sequence[str] = ("rmse", "mae", "r2", "medae"), by: Sequence[str] = ()) -> DataFrame:
    """One column per registered metric, per group of `by` (such as a stage), over rows where both are not null."""
    if unknown := [n for n in names if n not in METRICS]:
        raise KeyError(f"no such metric: {', '.join(unknown)}; there are {', '.join(sorted(METRICS))}")
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull())
    plain = [METRICS[n](y, p).alias(n) for n in names if METRICS[n] is not _medae]
    out = (rows.groupBy(*by) if by else rows).agg(*plain) if plain else None
    if len(plain) < len(names):  # a median needs an order, not an aggregate that keeps all distinct values
        name = next(n for n in names if METRICS[n] is _medae)
        medae = exact_quantiles(rows.select(*by, F.abs(y - p).alias("_e")), "_e", [0.5], by).select(*by, F.get("q", F.lit(0)).alias(name))
        out = medae if out is None else match(out, medae, by) if by else out.crossJoin(F.broadcast(medae))  # one row each
    return out.select(*by, *names)


def confusion(df: DataFrame, target: str, predicted: str, count: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 of 0/1 columns; a ratio without a denominator is 0.

    count: a column that says how many rows a row stands for.
    """
    y, p = F.col(target) == 1, F.col(predicted) == 1

    def size(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(count))), F.lit(0)) if count else F.count_if(which)

    c = df.agg(size(y & p).alias("tp"), size(~y & p).alias("fp"), size(y & ~p).alias("fn"), size(~y & ~p).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_points(df: DataFrame, target: str, score: str) -> DataFrame:
    """threshold, fpr, tpr at each distinct score: rates of rows with that score or a higher one; null without such rows."""
    counts = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum((F.col(target) == 1).cast("long")).alias("p"), F.sum((F.col(target) != 1).cast("long")).alias("n"))
    down = running(counts.withColumn("_down", -F.col("threshold")), ["_down"], {"tp": F.col("p"), "fp": F.col("n")})
    total = counts.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return down.crossJoin(F.broadcast(total)).select("threshold", F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))


def auc(df: DataFrame, target: str, score: str, count: str | None = None) -> DataFrame:
    """auc: the rank sum of the positives, ties at their mean rank, over rows without nulls; null unless both classes occur.

    count: a column that says how many rows a row stands for.
    """
    rows = df.select((F.col(target) == 1).alias("y"), F.col(score).cast("double").alias("s"), (F.col(count) if count else F.lit(1)).cast("long").alias("c")).where("y is not null and s is not null")
    counts = rows.groupBy("s").agg(F.sum(F.when(F.col("y"), F.col("c")).otherwise(0)).alias("p"), F.sum("c").alias("c"))
    ranked = running(counts, ["s"], {"upto": F.col("c")})  # of each score: its rows share the rank upto - (c - 1) / 2
    s = ranked.agg(F.sum(F.when(F.col("p") > 0, F.col("p") * (F.col("upto") - (F.col("c") - 1) / 2))).alias("r"), F.sum("p").cast("double").alias("p"), F.sum(F.col("c") - F.col("p")).cast("double").alias("n"))
    return s.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """spearman: the correlation of mean ranks over rows where both are not null; null if either is constant."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    ranked = average_ranks(average_ranks(rows, "a", "ra"), "b", "rb")
    return ranked.agg(F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("spearman"))
