"""Chronological and stratified splits and folds. Every order is explicit; give a tiebreak to make it total."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.ordered import match, positions, running
from quernel.functions.scalars import between_dates, fingerprint
from quernel.operators.aggregates import group_coverage


@dataclass(frozen=True)
class SplitResult:
    train: DataFrame
    valid: DataFrame
    test: DataFrame
    coverage: DataFrame | None
    fingerprint: DataFrame


def chronological_labels(df: DataFrame, order: Sequence[str], ratios: Sequence[float] = (0.6, 0.2, 0.2), name: str = "split") -> DataFrame:
    """df with train, valid or test by position: the first floor(n * r1) rows, the next floor(n * r2), the rest."""
    n = df.count()
    a, b = int(n * ratios[0]), int(n * ratios[1])
    p = positions(df, order, "_pos")
    return p.withColumn(name, F.when(F.col("_pos") <= a, "train").when(F.col("_pos") <= a + b, "valid").otherwise("test")).drop("_pos")


def chronological_split(df: DataFrame, order: Sequence[str], ratios: Sequence[float] = (0.6, 0.2, 0.2), dates: tuple[str, str] | None = None, group: str | None = None) -> SplitResult:
    """By dates (valid_from, test_from) if given, else by ratios of the rows in order."""
    if dates:
        train, valid, test = between_dates(df, order[0], *dates)
    else:
        labelled = chronological_labels(df, order, ratios, "_split")
        train, valid, test = (labelled.where(F.col("_split") == s).drop("_split") for s in ("train", "valid", "test"))
    cover = group_coverage({"train": train, "valid": valid, "test": test}, group) if group else None
    return SplitResult(train, valid, test, cover, fingerprint(df))


def fold_of(position: Column, n: int, k: int) -> Column:
    """The unshuffled fold of a 0-based position: the first n mod k folds have one row more."""
    size, extra = n // k, n % k
    wide = extra * (size + 1)
    return F.when(position < wide, F.floor(position / (size + 1))).otherwise(extra + F.floor((position - wide) / max(size, 1))).cast("int")


def kfold_labels(df: DataFrame, order: Sequence[str], k: int = 5, name: str = "fold") -> DataFrame:
    n = df.count()
    return positions(df, order, "_pos").withColumn(name, fold_of(F.col("_pos") - 1, n, k)).drop("_pos")


def expanding_labels(df: DataFrame, order: Sequence[str], k: int = 5, name: str = "fold") -> DataFrame:
    """df with the fold whose test block a row is in (1..k), 0 for the first block; fold f trains on all rows before."""
    n = df.count()
    test = n // (k + 1)
    first = n - k * test
    return positions(df, order, "_pos").withColumn(name, F.when(F.col("_pos") <= first, 0).otherwise(1 + F.floor((F.col("_pos") - 1 - first) / max(test, 1))).cast("int")).drop("_pos")


def _shuffle(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *df.columns)


def stratified_folds(df: DataFrame, target: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds with equal class shares, up to one row a class; positions within a class are found in ranges."""
    rows = df.withColumn("_h", _shuffle(df, seed))
    return positions(rows, ["_h"], "_pos", [target]).withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_pos")


def counted_folds(df: DataFrame, target: str | None, k: int = 5, seed: int = 42, name: str = "fold", count: str = "n") -> DataFrame:
    """The distinct rows of df, each with a fold and how many of its copies `stratified_folds` (`shuffled_folds`, if target is
    None) puts there, where there are any. If df has a column `count`, it says how many rows a row stands for.

    Equal rows stand together in the order of a class, so positions come from the running sum of their counts.
    """
    one = df.drop(count)
    counts = df.groupBy(*one.columns).agg((F.sum(count) if count in df.columns else F.count("*")).alias(count)).withColumn("_h", _shuffle(one, seed))
    rows = running(counts, ["_h"], {"_upto": F.col(count)}, [target] if target else []).withColumn("_from", F.col("_upto") - F.col(count))
    # of the positions 0 .. x - 1, fold f has (x + k - 1 - f) div k
    dealt = F.array(*[F.struct(F.lit(f).alias("f"), F.expr(f"(_upto + {k - 1 - f}) div {k} - (_from + {k - 1 - f}) div {k}").alias("n")) for f in range(k)])
    rows = rows.withColumn("_f", F.explode(dealt)).where("_f.n > 0")
    return rows.select(*one.columns, F.col("_f.f").alias(name), F.col("_f.n").alias(count))


def shuffled_folds(df: DataFrame, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    rows = df.withColumn("_h", _shuffle(df, seed))
    return positions(rows, ["_h"], "_pos").withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_pos")


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """All rows of a group in one fold."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), group), F.lit(k)).cast("int"))


def auto_folds(df: DataFrame, target: str, task: str, group: str | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    if group:
        return group_folds(df, group, k, seed)
    return stratified_folds(df, target, k, seed) if task == "classification" else shuffled_folds(df, k, seed)


def stratified_split(df: DataFrame, target: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): per class, ceil(test * n) rows chosen by a seeded hash."""
    rows = positions(df.withColumn("_h", _shuffle(df, seed)), ["_h"], "_pos", [target])
    rows = match(rows, df.groupBy(target).agg(F.count("*").alias("_n")), [target])  # one row a class
    chosen = F.col("_pos") <= F.ceil(F.col("_n") * test)
    return rows.where(~chosen).select(*df.columns), rows.where(chosen).select(*df.columns)
