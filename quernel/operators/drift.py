"""Distribution drift between a reference and a comparison sample: one pass per family of metrics, for all features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.durable import written
from quernel.functions.ordered import exact_quantiles, running
from quernel.functions.scalars import fingerprint
from quernel.operators.aggregates import long_form

BINS = 20
METRIC_NAMES = ("ks", "cvm", "psi", "wasserstein", "js", "tv")
_ANY = Window.partitionBy


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]


def _both(ref: DataFrame, cmp: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(feature, value, side: 0 reference, 1 comparison) of non-null values, of features that have both sides."""
    rows = long_form(ref, columns, kind).withColumn("side", F.lit(0)).unionByName(long_form(cmp, columns, kind).withColumn("side", F.lit(1)))
    rows = rows.where("value is not null")
    return rows.where(~F.isnan("value")) if kind == "double" else rows


def two_sample(ref: DataFrame, cmp: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, ks, cvm, wasserstein, exact, from counts of distinct values and their running sums."""
    rows = _both(ref, cmp, columns, "double")
    counts = rows.groupBy("feature", "value").agg(F.sum((F.col("side") == 0).cast("double")).alias("a"), F.sum((F.col("side") == 1).cast("double")).alias("b"))
    totals = counts.groupBy("feature").agg(F.sum("a").alias("n"), F.sum("b").alias("m")).where("n > 0 and m > 0")
    run = running(counts, ["value"], {"ca": F.col("a"), "cb": F.col("b")}, ["feature"]).join(F.broadcast(totals), "feature")  # one row a column
    n, m, a, b = F.col("n"), F.col("m"), F.col("a"), F.col("b")
    ahead_a, ahead_b = F.col("ca") - a, F.col("cb") - b
    now, last = F.abs(F.col("ca") / n - F.col("cb") / m), F.abs(ahead_a / n - ahead_b / m)
    rank = ahead_a + ahead_b + (a + b + 1) / 2

    def squares(before: Column, k: Column) -> Column:
        """Sum of (rank - i)^2 for i = before + 1 .. before + k."""
        d = rank - before
        return k * d * d - d * k * (k + 1) + k * (k + 1) * (2 * k + 1) / 6

    stats = run.groupBy("feature", "n", "m").agg(F.max(now).alias("ks"), F.sum(F.col("value") * (last - now)).alias("wasserstein"), F.sum(squares(ahead_a, a)).alias("sa"), F.sum(squares(ahead_b, b)).alias("sb"))
    u = n * F.col("sa") + m * F.col("sb")
    cvm = u / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m))
    return stats.select("feature", "ks", cvm.alias("cvm"), "wasserstein")


def _binned(rows: DataFrame, edges: DataFrame, bin_of: Column) -> DataFrame:
    """(feature, bin, a, b) counts with empty bins of a feature's `n_bins` as rows of zeros."""
    edges = written(edges, "edges")  # one row a column; it is read twice
    counts = rows.join(F.broadcast(edges), "feature").withColumn("bin", bin_of).where("bin is not null")
    counts = counts.groupBy("feature", "bin").agg(F.sum((F.col("side") == 0).cast("double")).alias("a"), F.sum((F.col("side") == 1).cast("double")).alias("b"))
    spine = edges.select("feature", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins").cast("long") - 1)).alias("bin"))
    return spine.join(counts, ["feature", "bin"], "left").na.fill(0.0, ["a", "b"])


def psi_numeric(ref: DataFrame, cmp: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """feature, psi over bins at the reference's quantiles; comparison values outside are left out.

    With fewer than two distinct quantiles: equal bins on [min, max + 1e-6].
    """
    rows = _both(ref, cmp, columns, "double")
    q = exact_quantiles(rows.where("side = 0"), "value", [i / bins for i in range(bins + 1)], ["feature"], few=True)
    q = q.select("feature", F.array_distinct("q").alias("q"), F.element_at("q", 1).alias("lo"), F.element_at("q", -1).alias("hi"))
    step = (F.col("hi") + 1e-6 - F.col("lo")) / bins
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + i * step)
    q = q.select("feature", F.when(F.size("q") < 2, even).otherwise(F.col("q")).alias("edges")).withColumn("n_bins", F.size("edges") - 1)
    inside = (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1))
    below = sum((F.when(F.get("edges", F.lit(i)) <= F.col("value"), 1).otherwise(0) for i in range(bins + 1)), F.lit(0))
    counts = _binned(rows, q, F.when(inside, F.least(below - 1, F.col("n_bins") - 1)).cast("long"))
    by = _ANY("feature")
    counts = counts.select("feature", (F.col("a") / F.sum("a").over(by)).alias("p"), (F.col("b") / F.greatest(F.sum("b").over(by), F.lit(1.0))).alias("q"))
    return counts.groupBy("feature").agg(F.sum((F.col("p") - F.col("q")) * F.log((F.col("p") + 1e-6) / (F.col("q") + 1e-6))).alias("psi"))


def shape_numeric(ref: DataFrame, cmp: DataFrame, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """feature, js, tv, tv_prob over equal bins on the reference's range.

    tv is half the sum of density differences, without the bins' width; tv_prob is that of shares. js and tv are NaN if no
    comparison value lies in the range.
    """
    rows = _both(ref, cmp, columns, "double")
    r = rows.where("side = 0").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    one = F.col("lo") == F.col("hi")  # a constant spreads half to each side, as histograms do
    r = r.select("feature", F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), F.lit(bins).alias("n_bins"))
    width = (F.col("hi") - F.col("lo")) / bins
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    counts = _binned(rows, r, F.when(inside, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1).cast("long"))))
    by = _ANY("feature")
    counts = counts.join(r.select("feature", width.alias("width")), "feature")
    total_b = F.sum("b").over(by)
    q = F.when(total_b == 0, F.lit(float("nan"))).otherwise(F.col("b") / total_b)
    counts = counts.select("feature", "width", (F.col("a") / F.sum("a").over(by)).alias("p"), q.alias("q"))
    p, q, mid = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / 2

    def kl(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / mid)).otherwise(x * 0.0)

    return counts.groupBy("feature").agg((F.sum(kl(p) + kl(q)) / 2).alias("js"), (F.sum(F.abs(p - q) / F.col("width")) / 2).alias("tv"), (F.sum(F.abs(p - q)) / 2).alias("tv_prob"))


def categorical(ref: DataFrame, cmp: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, psi, js, tv over the reference's categories; js is the symmetric Kullback-Leibler divergence, which may be infinite."""
    rows = _both(ref, cmp, columns, "string")
    counts = rows.groupBy("feature", "value").agg(F.sum((F.col("side") == 0).cast("double")).alias("a"), F.sum((F.col("side") == 1).cast("double")).alias("b"))
    known = F.when(F.col("a") > 0, F.col("b"))
    totals = counts.groupBy("feature").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"), F.sum(known).alias("known_b"))
    shares = counts.join(F.broadcast(totals), "feature").where("a > 0 and all_b > 0")  # one row for each of `columns`
    p, q, r = F.col("a") / F.col("all_a"), F.col("b") / F.col("all_b"), F.try_divide("b", "known_b")
    forward = F.when(r == 0, F.lit(float("inf"))).otherwise(p * F.log(p / r))
    back = F.when(r == 0, 0.0).otherwise(r * F.log(r / p))
    return shares.groupBy("feature").agg(F.sum((p - q) * F.log((p + 1e-9) / (q + 1e-9))).alias("psi"), F.sum(forward + back).alias("js"), (F.sum(F.abs(p - q)) / 2).alias("tv"))


def with_risk(table: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """table with risk_level and note: high if a metric that is no NaN reaches its threshold; zero thresholds are skipped."""
    used = {k: float(v) for k, v in thresholds.items() if v and k in table.columns}
    hits = [F.when(F.col(k).isNotNull() & ~F.isnan(k) & (F.col(k) >= v), F.lit(f"{k}>{v:g}")) for k, v in used.items()]
    note = F.concat_ws(", ", *hits) if hits else F.lit("")
    return table.withColumn("note", F.when(note == "", "ok").otherwise(note)).withColumn("risk_level", F.when(F.col("note") == "ok", "low").otherwise("high"))


@dataclass(frozen=True)
class DriftReport:
    table: DataFrame
    label: str
    reference: DataFrame
    comparison: DataFrame


class DriftAnalyzer:
    """Compares samples feature by feature."""

    def __init__(self, thresholds: Mapping[str, float] | None = None):
        self.thresholds = dict(thresholds or {"psi": 0.2, "ks": 0.1})

    def table(self, ref: DataFrame, cmp: DataFrame, features: Sequence[str]) -> DataFrame:
        """One row per feature with values on both sides, those at risk first; empty if there is none."""
        numbers = numeric_columns(ref, features)
        names = [c for c in features if c not in numbers]
        parts = []
        if numbers:
            a = two_sample(ref, cmp, numbers)
            a = a.join(psi_numeric(ref, cmp, numbers), "feature").join(shape_numeric(ref, cmp, numbers).drop("tv_prob"), "feature")
            parts.append(a.select("feature", *METRIC_NAMES))
        if names:
            none = [F.lit(None).cast("double").alias(k) for k in ("ks", "cvm")]
            b = categorical(ref, cmp, names)
            parts.append(b.select("feature", *none, "psi", F.lit(None).cast("double").alias("wasserstein"), "js", "tv"))
        if not parts:
            schema = ", ".join(["feature string", *[f"{k} double" for k in METRIC_NAMES]])
            parts = [ref.sparkSession.createDataFrame([], schema)]
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return with_risk(out, self.thresholds).orderBy("risk_level", "feature")

    def compare(self, ref: DataFrame, cmp: DataFrame, features: Sequence[str], label: str = "") -> DriftReport:
        return DriftReport(self.table(ref, cmp, features), label, fingerprint(ref.select(*features)), fingerprint(cmp.select(*features)))


def quality_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n, nulls, distinct, low, high as text, one pass for all columns."""
    return long_form(df, columns).groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.countDistinct("value").alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high"))


def full_report(ref: DataFrame, cmp: DataFrame, features: Sequence[str], target: str | None = None, thresholds: Mapping[str, float] | None = None) -> dict[str, DataFrame]:
    """Quality of both samples, drift of the features and of the target."""
    drift = DriftAnalyzer(thresholds)
    out = {"quality_reference": quality_table(ref, features), "quality_comparison": quality_table(cmp, features), "drift": drift.table(ref, cmp, features)}
    if target:
        out["target_drift"] = drift.table(ref, cmp, [target])
    return out
