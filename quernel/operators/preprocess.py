"""Column filters, imputation, scaling and out-of-fold target encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.ordered import exact_quantiles, medians
from quernel.operators.aggregates import long_form
from quernel.operators.splits import kfold_labels

MISSING = "__MISSING__"


def missing_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, ratio of nulls: one pass."""
    return long_form(df, columns).groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("ratio"))


def distinct_with_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n: distinct values, null as one."""
    return long_form(df, columns).groupBy("feature").agg((F.countDistinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("n"))


def vif_table(df: DataFrame, columns: Sequence[str], gram: np.ndarray | None = None) -> dict[str, float]:
    """Variance inflation without intercept, over rows without nulls, from one pass that sums the columns' products."""
    g = gram_matrix(df, columns) if gram is None else gram
    inv = np.linalg.pinv(g)
    return {c: float(g[i, i] * inv[i, i]) for i, c in enumerate(columns)}


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    p = len(columns)
    sums = rows.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = sums[f"s{i}_{j}"] or 0.0
    return g


def vif_filter(df: DataFrame, columns: Sequence[str], most: float = 15.0) -> tuple[list[str], list[str]]:
    """(kept, dropped): the largest above `most` goes until none is, or one column is left; the data are read once."""
    g, kept, dropped = gram_matrix(df, columns), list(range(len(columns))), []
    while len(kept) > 1:
        sub = g[np.ix_(kept, kept)]
        v = np.diag(sub) * np.diag(np.linalg.pinv(sub))
        if v.max() <= most:
            break
        dropped.append(columns[kept.pop(int(v.argmax()))])
    return [columns[i] for i in kept], dropped


def out_of_fold_means(df: DataFrame, column: str, target: str, fold: str) -> DataFrame:
    """category, fold, oof: the mean target of a category's rows outside the fold, from one grouping; misses: the global mean."""
    rows = df.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("category"), F.col(fold).alias("fold"), F.col(target).cast("double").alias("y"))
    by = rows.groupBy("category", "fold").agg(F.count("*").alias("rows"), F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))
    total = by.groupBy("category").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    mean = float(rows.agg(F.avg("y")).first()[0] or 0.0)
    left = F.col("tn") - F.col("n")
    return by.join(total, "category").select("category", "fold", "rows", F.when(left > 0, (F.col("ts") - F.col("s")) / left).otherwise(mean).alias("oof"))


def oof_mapping(df: DataFrame, column: str, target: str, fold: str) -> DataFrame:
    """category, value: the mean of a category's out-of-fold values over its rows."""
    oof = out_of_fold_means(df, column, target, fold)
    return oof.groupBy("category").agg((F.sum(F.col("oof") * F.col("rows")) / F.sum("rows")).alias("value"))


def medians_and_iqr(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Exact medians and interquartile ranges (0 becomes 1)."""
    got = {r["feature"]: r["q"] for r in exact_quantiles(long_form(df, columns, "double"), "value", [0.25, 0.5, 0.75], ["feature"], few=True).collect()}
    return {c: ((q := got.get(c) or [0.0, 0.0, 0.0])[1], (q[2] - q[0]) or 1.0) for c in columns}


def robust_scaled(df: DataFrame, columns: Sequence[str], stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    stats = stats or medians_and_iqr(df, columns)
    return df.withColumns({c: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in columns})


@dataclass
class Scaler:
    """Standard (population deviation), robust or identity scaling of columns, and its inverse."""

    kind: str = "standard"
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Scaler:
        if self.kind == "identity":
            self.stats = {c: (0.0, 1.0) for c in columns}
        elif self.kind == "robust":
            self.stats = medians_and_iqr(df, columns)
        elif self.kind == "standard":
            rows = long_form(df, columns, "double").groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
            self.stats = {r["feature"]: (r["m"] or 0.0, r["s"] or 1.0) for r in rows}
        else:
            raise ValueError(f"unknown scaler: {self.kind}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.stats.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m for c, (m, s) in self.stats.items()})


def impute_and_standardize(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Only `columns`: nulls filled by the mean (or median), then standardized by the population deviation."""
    fill = df.agg(*[F.avg(c).alias(c) for c in columns]).first() if how == "mean" else medians(df, columns)
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fill[c])).alias(c) for c in columns])
    return Scaler("standard").fit(filled, columns).transform(filled)


@dataclass
class Preprocessor:
    """Drops columns that are mostly missing, constant or collinear; scales numbers robustly; encodes the rest by target."""

    most_missing: float = 0.5
    most_vif: float = 15.0
    folds: int = 5
    impute_from: str = "transform"
    dropped: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    maps: dict[str, DataFrame] = field(default_factory=dict)
    mean: float = 0.0

    def fit(self, df: DataFrame, target: str, order: Sequence[str]) -> Preprocessor:
        """order: the row order of the folds."""
        columns = [c for c in df.columns if c != target]
        gone = {r["feature"] for r in missing_ratios(df, columns).where(F.col("ratio") > self.most_missing).collect()}
        gone |= {r["feature"] for r in distinct_with_null(df, columns).where("n <= 1").collect()}
        self.dropped = [c for c in columns if c in gone]
        left = [c for c in columns if c not in gone]
        numbers = [c for c in left if isinstance(df.schema[c].dataType, T.NumericType)]
        self.categorical = [c for c in left if c not in numbers]
        self.numeric, collinear = vif_filter(df, numbers, self.most_vif) if len(numbers) > 1 else (numbers, [])
        self.dropped += collinear
        self.scale = medians_and_iqr(df, self.numeric)
        self.mean = float(df.agg(F.avg(target)).first()[0] or 0.0)
        folded = kfold_labels(df, order, self.folds, "_fold") if self.categorical else df
        self.maps = {c: oof_mapping(folded, c, target, "_fold") for c in self.categorical}
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep, the scaled numbers, then <column>_te; numbers are imputed by medians of this frame or of the fit's."""
        medians = {c: m for c, (m, _) in (medians_and_iqr(df, self.numeric) if self.impute_from == "transform" else self.scale).items()}
        cols = [((F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) - self.scale[c][0]) / self.scale[c][1]).alias(c) for c in self.numeric]
        for i, c in enumerate(self.categorical):
            m = self.maps[c].select(F.col("category").alias(f"_c{i}"), F.col("value").alias(f"_v{i}"))
            df = df.join(m, F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == F.col(f"_c{i}"), "left")
            cols.append(F.coalesce(F.col(f"_v{i}"), F.lit(self.mean)).alias(f"{c}_te"))
        return df.select(*keep, *cols)
