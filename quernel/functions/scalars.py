"""Row-level expressions: binning, keys, hashes, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0..bins-1 by equal width on [low, high], the last bin closed; null outside."""
    raw = F.floor((value - low) / ((high - low) / F.lit(float(bins))))
    return F.when((value >= low) & (value <= high), F.least(raw, F.lit(bins - 1).cast("long")))


def bin_by_breaks(value: Column, breaks: Sequence[float]) -> Column:
    """The bin of value among right-closed intervals of ascending breaks, the first closed on both sides; null outside."""
    out = F.when(value <= F.lit(float(breaks[0])), F.when(value == F.lit(float(breaks[0])), 0))
    for i, b in enumerate(breaks[1:]):
        out = out.when(value <= F.lit(float(b)), i)
    return out.cast("long")


def histogram_bin(value: Column, breaks: Sequence[float]) -> Column:
    """The bin of value among left-closed intervals of ascending breaks, the last closed; null outside."""
    n = len(breaks) - 1
    out = F.when((value < F.lit(float(breaks[0]))) | (value > F.lit(float(breaks[-1]))), None)
    for i in range(n - 1, 0, -1):
        out = out.when(value >= F.lit(float(breaks[i])), i)
    return out.otherwise(F.when(value.isNotNull() & ~F.isnan(value), 0)).cast("long")


def group_key(*columns: str, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])


def class_weight(target: Column, one: float, zero: float) -> Column:
    return F.when(target == 1, F.lit(float(one))).otherwise(F.lit(float(zero)))


def above(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability >= F.lit(float(threshold)), 1).otherwise(0)


def to_time(value: Column) -> Column:
    """A timestamp, null where the text is none."""
    return F.try_to_timestamp(value)


def json_md5(*columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def cache_key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, hash_sum, hash_xor: one row that any change of df's values changes; order of rows does not matter."""
    h = df.select(F.xxhash64(*df.columns).alias("h"))
    return h.agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def feature_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """Columns named in capitals; if there are none, all but the target."""
    upper = [c for c in df.columns if c == c.upper() and any(x.isalpha() for x in c) and c != target]
    return upper or [c for c in df.columns if c != target]


def matching_columns(columns: Sequence[str], text: str) -> list[str]:
    return [c for c in columns if text.lower() in c.lower()]


def partition_rows(df: DataFrame, label: str, type_col: str) -> DataFrame:
    """Rows of one partition label (such as TRAIN), whatever the letter case."""
    return df.where(F.upper(F.col(type_col)) == label.upper())


def between_dates(df: DataFrame, ts: str, valid_from: str, test_from: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows before valid_from, from there until test_from, and from there on."""
    t, v, e = F.col(ts), F.lit(valid_from).cast("timestamp_ntz"), F.lit(test_from).cast("timestamp_ntz")
    return df.where(t < v), df.where((t >= v) & (t < e)), df.where(t >= e)


def sampled(df: DataFrame, most: int, seed: int = 42) -> tuple[DataFrame, bool]:
    """At most `most` rows, chosen at random, and whether rows were left out. A sampling operator: the cap is its purpose."""
    if df.limit(most + 1).count() <= most:
        return df, False
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(most), True  # the same rows on every run


def listify(x) -> list:
    return [] if x is None else [x] if isinstance(x, str) else list(x)
