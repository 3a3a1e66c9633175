"""Categorical encoders: a fit is an aggregate that makes a mapping table, a transform a null-safe join with it.

NULL is a category of its own. Values compare as strings. The mapping has one row per category; Spark broadcasts it if
it is small, and shuffles it if it is not.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.ordered import positions, running
from quernel.operators.aggregates import column_survey

NULL_TOKEN = "__nan__"


class EncoderError(ValueError):
    """A configuration or input that an encoder can't work with."""


@dataclass
class Fitted:
    """What a fitted column encoder knows: a mapping (category, outputs..) with defaults, or plain expressions."""

    column: str
    names: list[str]
    mapping: DataFrame | None = None
    defaults: list[float] = field(default_factory=list)
    tables: list[list[float]] = field(default_factory=list)
    direct: dict[str, Any] | None = None


Fit = Callable[..., Fitted]
REGISTRY: dict[str, Fit] = {}
NEEDS_TARGET = {"target", "leave_one_out", "catboost", "james_stein", "woe", "multi_hash"}
SEEDED = {"catboost", "embedding", "multi_hash", "target", "leave_one_out"}


def register_encoder(name: str, fit: Fit | None = None, needs_target: bool = False) -> Callable[[Fit], Fit]:
    """Add an encoder: fit(rows(category, y), column, **params) -> Fitted. Also usable as a decorator."""

    def put(f: Fit) -> Fit:
        REGISTRY[name] = f
        if needs_target:
            NEEDS_TARGET.add(name)
        return f

    return put(fit) if fit else put


def _cats(rows: DataFrame) -> DataFrame:
    """category, n, idx: non-null categories in sorted order from 0."""
    c = rows.where("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    return positions(c, ["category"], "idx").withColumn("idx", F.col("idx") - 1)


#: Categories that encoders with a column for each can take: their names stand in the schema.
MOST_COLUMNS = 10_000


def _sorted_values(rows: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """The categories, for encoders that make a column for each: a schema must be known on the driver."""
    got = [r[0] for r in rows.where("category is not null").select("category").distinct().orderBy("category").limit(most + 1).collect()]
    if len(got) > most:
        raise EncoderError(f"more than {most} categories: a column for each is not possible")
    return got


def _stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.sum("y").alias("s"))


def _mean(rows: DataFrame) -> float:
    return float(rows.agg(F.avg("y")).first()[0] or 0.0)


def _noisy(value: Column, noise: float, seed: int) -> Column:
    """value plus N(0, noise), the same for a category on every run."""
    if not noise:
        return value
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "category"), F.lit(2**31)) + 0.5) / 2**31 for k in (1, 2)]
    return value + F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1]) * noise


@register_encoder("onehot")
def _onehot(rows: DataFrame, column: str, drop: str | None = None) -> Fitted:
    cats = _sorted_values(rows)
    if drop == "first" or (drop == "if_binary" and len(cats) == 2):
        kept = cats[1:]
    else:
        kept = cats
    return Fitted(column, [f"{column}__{c}" for c in kept], _cats(rows).select("category", "idx"), [0.0] * len(kept), direct={"kind": "indicator", "first": len(cats) - len(kept)})


@register_encoder("ordinal")
def _ordinal(rows: DataFrame, column: str) -> Fitted:
    return Fitted(column, [f"{column}__ordinal"], _cats(rows).select("category", F.col("idx").cast("double").alias("v0")), [-1.0])


@register_encoder("target")
def _target(rows: DataFrame, column: str, smoothing: float = 10.0, noise: float = 0.0, random_state: int = 42) -> Fitted:
    mean = _mean(rows)
    weight = 1 / (1 + F.exp(-(F.col("n") - smoothing)))
    value = F.when(F.col("n") == 0, mean).otherwise(mean * (1 - weight) + F.col("m") * weight)
    return Fitted(column, [f"{column}__target_mean"], _stats(rows).select("category", _noisy(value, noise, random_state).alias("v0")), [mean])


@register_encoder("leave_one_out")
def _loo(rows: DataFrame, column: str, noise: float = 0.0, epsilon: float = 1e-6, random_state: int = 42) -> Fitted:
    mean = _mean(rows)
    value = F.when(F.col("n") <= 1, mean).otherwise((F.col("s") - mean) / (F.col("n") - 1 + epsilon))
    return Fitted(column, [f"{column}__loo"], _stats(rows).select("category", _noisy(value, noise, random_state).alias("v0")), [mean])


def leave_one_out_exact(df: DataFrame, column: str, y: str) -> DataFrame:
    """df with column__loo_exact: the mean target of the other rows of its category; the global mean if there is none."""
    mean = float(df.agg(F.avg(y)).first()[0] or 0.0)
    w = df.groupBy(F.col(column).alias("_c")).agg(F.count(y).alias("_n"), F.sum(y).alias("_s"))
    own = F.col(y).isNotNull().cast("int")
    left = F.col("_n") - own
    value = F.when(left <= 0, mean).otherwise((F.col("_s") - F.coalesce(F.col(y), F.lit(0.0))) / left)
    return df.join(w, F.col(column).eqNullSafe(F.col("_c"))).withColumn(f"{column}__loo_exact", value).drop("_c", "_n", "_s")


@register_encoder("catboost")
def _catboost(rows: DataFrame, column: str, prior: float = 0.5, noise: float = 0.0, random_state: int = 42, order_by: bool = False) -> Fitted:
    """Ordered target statistics over a seeded shuffle, or over the rows' `o` if order_by."""
    rows = rows.where("y is not null")
    key = F.col("o") if order_by else F.xxhash64(F.lit(random_state), "o")
    rows = rows.select(F.coalesce("category", F.lit(NULL_TOKEN)).alias("k"), "category", "y", key.alias("ord"), "o")
    run = running(rows, ["ord", "o"], {"n": F.lit(1).cast("double"), "s": F.col("y")}, ["k"])
    stat = (F.col("s") - F.col("y") + prior) / F.col("n")
    mapping = run.groupBy("category").agg(F.avg(stat).alias("v"))
    mapping = mapping.select("category", _noisy(F.col("v"), noise, random_state).alias("v0"))
    return Fitted(column, [f"{column}__catboost"], mapping, [float(mapping.agg(F.avg("v0")).first()[0] or 0.0)])


@register_encoder("james_stein")
def _james_stein(rows: DataFrame, column: str, prior_weight: float = 5.0) -> Fitted:
    mean = _mean(rows)
    value = (mean * prior_weight + F.coalesce("s", F.lit(0.0))) / (prior_weight + F.col("n"))
    return Fitted(column, [f"{column}__james_stein"], _stats(rows).select("category", value.alias("v0")), [mean])


@register_encoder("woe")
def _woe(rows: DataFrame, column: str, regularization: float = 1.0) -> Fitted:
    rows = rows.where("y is not null")
    values = [r[0] for r in rows.select("y").distinct().limit(3).collect()]
    if len(values) != 2:
        raise EncoderError("weight of evidence needs a target with exactly two values")
    one = max(values)
    s = rows.groupBy("category").agg(F.count_if(F.col("y") == one).cast("double").alias("p"), F.count_if(F.col("y") != one).cast("double").alias("q"))
    t = s.agg(F.sum("p"), F.sum("q")).first()
    r = regularization
    mapping = s.select("category", F.log(((F.col("p") + r) / (t[0] + r)) / ((F.col("q") + r) / (t[1] + r))).alias("v0"))
    return Fitted(column, [f"{column}__woe"], mapping, [float(mapping.agg(F.avg("v0")).first()[0])])


@register_encoder("count")
def _count(rows: DataFrame, column: str) -> Fitted:
    return Fitted(column, [f"{column}__count"], rows.groupBy("category").agg(F.count("*").cast("double").alias("v0")), [0.0])


@register_encoder("frequency")
def _frequency(rows: DataFrame, column: str) -> Fitted:
    n = max(1, rows.count())
    return Fitted(column, [f"{column}__freq"], rows.groupBy("category").agg((F.count("*") / n).alias("v0")), [0.0])


def md5_bucket(value: Column, n: int) -> Column:
    """0..n-1 from the first 32 bits of the md5, the same in any engine that has md5."""
    return F.pmod(F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long"), F.lit(n))


def md5_sign(value: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(value), 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)


@register_encoder("hashing")
def _hashing(rows: DataFrame, column: str, n_features: int = 32) -> Fitted:
    return Fitted(column, [f"{column}__hash_{i}" for i in range(n_features)], direct={"kind": "hashing", "n": n_features})


@register_encoder("binary")
def _binary(rows: DataFrame, column: str) -> Fitted:
    cats = _cats(rows)
    k = cats.count()
    bits = max(1, math.ceil(math.log2(k + 1))) if k else 1
    cols = [F.shiftright(F.col("idx").cast("long"), bits - 1 - i).bitwiseAND(F.lit(1)).cast("double").alias(f"v{i}") for i in range(bits)]
    return Fitted(column, [f"{column}__bin_{i}" for i in range(bits)], cats.select("category", *cols), [0.0] * bits)


@register_encoder("helmert")
def _helmert(rows: DataFrame, column: str) -> Fitted:
    cats = _cats(rows)
    k = cats.limit(MOST_COLUMNS + 1).count()
    if k < 2:
        raise EncoderError("helmert coding needs two categories at least")
    if k > MOST_COLUMNS:
        raise EncoderError(f"more than {MOST_COLUMNS} categories: a column for each is not possible")
    return Fitted(column, [f"{column}__helmert_{i}" for i in range(k - 1)], cats.select("category", "idx"), [0.0] * (k - 1), direct={"kind": "helmert", "n": k})


@register_encoder("rare_grouping")
def _rare(rows: DataFrame, column: str, min_freq: float = 0.01) -> Fitted:
    n = max(1, rows.count())
    kept = [r[0] for r in rows.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") / n >= min_freq).orderBy(F.desc("n"), F.col("category").asc_nulls_last()).collect()]  # 1 / min_freq at most
    names = [f"{column}__top_{c}" for c in kept] + [f"{column}__rare"]
    schema = T.StructType([T.StructField("category", T.StringType())] + [T.StructField(f"v{i}", T.DoubleType()) for i in range(len(names))])
    data = [(c, *[float(c == k) for k in kept], 0.0) for c in kept]
    return Fitted(column, names, rows.sparkSession.createDataFrame(data, schema), [0.0] * len(kept) + [1.0])


@register_encoder("embedding")
def _embedding(rows: DataFrame, column: str, dim: int = 4, random_state: int = 42) -> Fitted:
    """Indicators of the `dim` most frequent categories: the truncated SVD of the one-hot matrix, up to rotation of ties."""
    rows = rows.select(F.coalesce("category", F.lit(NULL_TOKEN)).alias("category"))
    top = [r[0] for r in rows.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(dim + 1).collect()]
    top = sorted(top) if len(top) <= dim else top[:dim]
    schema = T.StructType([T.StructField("category", T.StringType())] + [T.StructField(f"v{i}", T.DoubleType()) for i in range(len(top))])
    data = [(None if c == NULL_TOKEN else c, *[float(c == k) for k in top]) for c in top]
    return Fitted(column, [f"{column}__embed_{i}" for i in range(len(top))], rows.sparkSession.createDataFrame(data, schema), [0.0] * len(top))


@register_encoder("multi_hash")
def _multi_hash(rows: DataFrame, column: str, n_hashes: int = 2, hash_dim: int = 64, dim: int = 4, random_state: int = 42, init_scale: float = 0.01) -> Fitted:
    """Per hash a table of hash_dim buckets: small random vectors plus the sum of the bucket's targets in every dimension."""
    init = np.random.default_rng(random_state).normal(0.0, 1.0, (n_hashes, hash_dim, dim)) * init_scale
    token = F.coalesce("category", F.lit(NULL_TOKEN))
    buckets = F.array(*[F.struct(F.lit(h).alias("h"), md5_bucket(F.concat(token, F.lit(f":{h}")), hash_dim).alias("b")) for h in range(n_hashes)])
    sums = rows.where("y is not null").select("y", F.explode(buckets).alias("x")).groupBy("x.h", "x.b").agg(F.sum("y").alias("s"))
    for r in sums.collect():  # n_hashes * hash_dim rows at most
        init[r["h"], r["b"]] += r["s"]
    names = [f"{column}__mh_{h}_{d}" for h in range(n_hashes) for d in range(dim)]
    tables = [init[h, :, d].tolist() for h in range(n_hashes) for d in range(dim)]
    return Fitted(column, names, tables=tables, direct={"kind": "multi_hash", "hash_dim": hash_dim, "dim": dim})


def _apply(df: DataFrame, f: Fitted, at: int) -> tuple[DataFrame, list[Column]]:
    """df joined with the mapping of f, and the encoded columns."""
    value = F.col(f.column).cast("string")
    if f.direct is not None and f.mapping is None:
        token = F.coalesce(value, F.lit(NULL_TOKEN))
        if f.direct["kind"] == "hashing":
            b, s = md5_bucket(token, f.direct["n"]), md5_sign(token)
            return df, [F.when(b == i, s).otherwise(0.0).alias(n) for i, n in enumerate(f.names)]
        dim = f.direct["dim"]
        cells = [md5_bucket(F.concat(token, F.lit(f":{k // dim}")), f.direct["hash_dim"]) for k in range(len(f.names))]
        return df, [F.get(F.array(*[F.lit(x) for x in t]), b.cast("int")).alias(n) for n, t, b in zip(f.names, f.tables, cells, strict=True)]
    key = f"_key_{at}"
    m = f.mapping.select(F.col("category").alias(key), *[F.col(c).alias(f"_{at}_{c}") for c in f.mapping.columns if c != "category"], F.lit(True).alias(f"_hit_{at}"))
    out = df.join(m, value.eqNullSafe(F.col(key)), "left")
    hit = F.col(f"_hit_{at}").isNotNull()
    if f.direct is not None:  # the mapping has the category's number; the columns are made from it
        j, k = F.col(f"_{at}_idx"), f.direct.get("n", 0)
        if f.direct["kind"] == "indicator":
            return out, [F.when(j == i + f.direct["first"], 1.0).otherwise(0.0).alias(n) for i, n in enumerate(f.names)]
        # column i of the row of category j: -1/(i+1) before the diagonal, (k-i-1)/(i+1) on it, 0 after
        return out, [F.when(j < i, -1.0 / (i + 1)).when(j == i, (k - i - 1) / (i + 1)).otherwise(0.0).alias(n) for i, n in enumerate(f.names)]
    return out, [F.when(hit, F.col(f"_{at}_v{i}")).otherwise(F.lit(d)).alias(n) for i, (n, d) in enumerate(zip(f.names, f.defaults, strict=True))]


def choose(stats: Mapping[str, float], with_target: bool, rare_threshold: float = 0.02) -> tuple[str, str]:
    """(strategy, reason) for a column by its survey."""
    n = stats["cardinality"]
    if n <= 12:
        name, why = "onehot", "at most 12 categories"
    elif n <= 60:
        name, why = ("catboost" if with_target else "ordinal"), "at most 60 categories"
    elif n <= 200:
        name, why = ("target" if with_target else "hashing"), "at most 200 categories"
    else:
        name, why = ("multi_hash" if with_target else "embedding"), "over 200 categories"
    if stats["missing_rate"] > 0.2 and with_target:
        name, why = "catboost", "over 20 % missing"
    if stats["unique_ratio"] > 0.9 and with_target:
        name, why = "multi_hash", "nearly unique"
    if stats["rare_share"] > rare_threshold:
        name, why = "rare_grouping", "many rare categories"
    return name, why


class CategoricalEncoder:
    """Encodes all text and boolean columns of a frame, each by its own strategy."""

    def __init__(self, strategy: str | Mapping[str, str] = "auto", params: Mapping[str, Mapping[str, Any]] | None = None, random_state: int | None = None, rare_threshold: float = 0.02, auto_survey: bool = True):
        if strategy == "auto" and not auto_survey:
            raise EncoderError("automatic strategies need the survey")
        self.strategy, self.params, self.random_state, self.rare_threshold = strategy, dict(params or {}), random_state, rare_threshold
        self.fitted: list[Fitted] = []
        self.decisions: list[dict[str, Any]] = []

    def _columns(self, df: DataFrame, skip: Sequence[str]) -> list[str]:
        return [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, (T.StringType, T.BooleanType))]

    def fit(self, df: DataFrame, y: str | None = None, columns: Sequence[str] | None = None, order_by: str | None = None) -> CategoricalEncoder:
        """order_by: the row order of order-dependent encoders; by default a seeded shuffle."""
        columns = list(columns) if columns is not None else self._columns(df, [y] if y else [])
        if not columns:
            raise EncoderError("no categorical columns")
        if df.limit(1).count() == 0:
            raise EncoderError("the frame is empty")
        if isinstance(self.strategy, Mapping) and (missing := [c for c in columns if c not in self.strategy]):
            raise EncoderError(f"no strategy for {', '.join(missing)}")
        survey = {r["feature"]: r.asDict() for r in column_survey(df, columns).collect()} if self.strategy == "auto" else {}
        self.fitted, self.decisions = [], []
        for c in columns:
            if self.strategy == "auto":
                name, why = choose(survey[c], y is not None, self.rare_threshold)
                self.decisions.append({"column": c, "strategy": name, "reason": why, **survey[c]})
            else:
                name = self.strategy[c] if isinstance(self.strategy, Mapping) else self.strategy
            if name not in REGISTRY:
                raise EncoderError(f"unknown strategy: {name}")
            if name in NEEDS_TARGET and y is None:
                raise EncoderError(f"{name} needs a target")
            params = dict(self.params.get(name, {}))
            if self.random_state is not None and name in SEEDED:
                params.setdefault("random_state", self.random_state)
            if name == "catboost" and order_by:
                params["order_by"] = True
            o = F.col(order_by) if order_by else F.xxhash64(*df.columns)
            rows = df.select(F.col(c).cast("string").alias("category"), (F.col(y).cast("double") if y else F.lit(None).cast("double")).alias("y"), o.alias("o"))
            self.fitted.append(REGISTRY[name](rows, c, **params))
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Only the encoded columns, in the order of fit, after those of `keep`."""
        if missing := [f.column for f in self.fitted if f.column not in df.columns]:
            raise EncoderError(f"columns missing: {', '.join(missing)}")
        out: list[Column] = []
        for i, f in enumerate(self.fitted):
            df, cols = _apply(df, f, i)
            out += cols
        return df.select(*keep, *out)

    def fit_transform(self, df: DataFrame, y: str | None = None, **kw) -> DataFrame:
        return self.fit(df, y, **kw).transform(df)

    def get_feature_names(self) -> list[str]:
        return [n for f in self.fitted for n in f.names]

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        meta = {"type": "CategoricalEncoder", "decisions": self.decisions, "fitted": [{"column": f.column, "names": f.names, "defaults": f.defaults, "tables": f.tables, "direct": f.direct, "mapping": f.mapping is not None} for f in self.fitted]}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        for i, f in enumerate(self.fitted):
            if f.mapping is not None:
                f.mapping.write.mode("overwrite").parquet(f"{path}/mapping_{i}")

    @classmethod
    def load(cls, path: str) -> CategoricalEncoder:
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta.get("type") != "CategoricalEncoder":
            raise TypeError("not a saved encoder")
        out = cls()
        out.decisions = meta["decisions"]
        out.fitted = [Fitted(f["column"], f["names"], spark.read.parquet(f"{path}/mapping_{i}") if f["mapping"] else None, f["defaults"], f["tables"], f["direct"]) for i, f in enumerate(meta["fitted"])]
        return out
