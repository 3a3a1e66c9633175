"""Intraclass correlation of a value within groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators.aggregates import group_summary


def icc_one_way(df: DataFrame, group: str, value: str) -> DataFrame:
    """Type, ICC, Description: three forms from one-way mean squares; groups may differ in size."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    by = rows.groupBy("g").agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("w"))
    total = rows.agg(F.avg("v").alias("mean"))
    s = by.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ssb"), F.sum("w").alias("ssw"), F.count("*").cast("double").alias("g"), F.sum("n").alias("n"), F.avg("n").alias("k"))
    s = s.select((F.col("ssb") / F.greatest(F.col("g") - 1, F.lit(1.0))).alias("b"), (F.col("ssw") / F.greatest(F.col("n") - F.col("g"), F.lit(1.0))).alias("w"), "k")
    b, w, k = F.col("b"), F.col("w"), F.col("k")
    forms = [
        ("ICC1", (b - w) / (b + (k - 1) * w + 1e-6), "one-way random, absolute agreement"),
        ("ICC2", F.when(b > w, (b - w) / (b + (k - 1) * w)).otherwise(0.0), "two-way random, absolute agreement"),
        ("ICC3", F.when(b == 0, 0.0).otherwise((b - w) / b), "two-way mixed, consistency"),
    ]
    cells = F.array(*[F.struct(F.lit(n).alias("Type"), c.alias("ICC"), F.lit(d).alias("Description")) for n, c, d in forms])
    return s.select(F.explode(cells).alias("f")).select("f.*")


def icc_two_way(df: DataFrame, target: str, rater: str, value: str) -> DataFrame:
    """Type, ICC for ICC1, ICC2, ICC3 and their averages ICC1k, ICC2k, ICC3k; every rater rates every target once.

    A design with missing or repeated ratings gives null, and so does one with a single target or rater or without variance.
    """
    rows = df.select(F.col(target).alias("t"), F.col(rater).alias("r"), F.col(value).cast("double").alias("v"))
    cells = rows.groupBy("t", "r").agg(F.avg("v").alias("v"), F.count("v").alias("c"))
    mean = cells.agg(F.avg("v").alias("mean"), F.count("*").cast("double").alias("cells"), F.max("c").alias("most"), F.min("c").alias("least"), F.var_pop("v").alias("var"))
    of_t = cells.groupBy("t").agg(F.avg("v").alias("m")).agg(F.count("*").cast("double").alias("n"), F.var_pop("m").alias("vt"))
    of_r = cells.groupBy("r").agg(F.avg("v").alias("m")).agg(F.count("*").cast("double").alias("k"), F.var_pop("m").alias("vr"))
    s = mean.crossJoin(of_t).crossJoin(of_r)  # one row each
    n, k, over = F.col("n"), F.col("k"), F.try_divide
    good = (F.col("cells") == n * k) & (F.col("most") == 1) & (F.col("least") == 1)
    st, sr, ss = F.col("vt") * n * k, F.col("vr") * n * k, F.col("var") * n * k
    s = s.select("n", "k", good.alias("good"), over(st, n - 1).alias("b"), over(ss - st, n * (k - 1)).alias("w"), over(sr, k - 1).alias("j"), over(ss - st - sr, (n - 1) * (k - 1)).alias("e"))
    b, w, j, e = (F.col(x) for x in "bwje")
    forms = [("ICC1", over(b - w, b + (k - 1) * w)), ("ICC2", over(b - e, b + (k - 1) * e + k * (j - e) / n)), ("ICC3", over(b - e, b + (k - 1) * e)), ("ICC1k", over(b - w, b)), ("ICC2k", over(b - e, b + (j - e) / n)), ("ICC3k", over(b - e, b))]
    cells = F.array(*[F.struct(F.lit(x).alias("Type"), F.when(F.col("good"), c).alias("ICC")) for x, c in forms])
    return s.select(F.explode(cells).alias("f")).select("f.*")


@dataclass(frozen=True)
class ICCResult:
    table: DataFrame
    group_summary: DataFrame
    rows: DataFrame


def evaluate_icc(df: DataFrame, group: str, target: str, prediction: str | None = None, time: str | None = None, mode: str = "one_way") -> ICCResult:
    """ICC of the target, or of the residual target - prediction, with group summary and the tidy rows it used."""
    value = F.col(target) - F.col(prediction) if prediction else F.col(target)
    rows = df.select(*[c for c in (time, group) if c], value.cast("double").alias("value")).na.drop(subset=["value", group])
    if mode == "two_way" and not time:
        raise ValueError("two-way ICC needs a rater (time) column")
    table = icc_two_way(rows, group, time, "value") if mode == "two_way" else icc_one_way(rows, group, "value")
    return ICCResult(table, group_summary(rows, group, "value"), rows)
