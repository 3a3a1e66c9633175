"""Removal of repeated runs of lines by winnowing, with DataFrame functions only.

A window is a run of content lines that is worth deleting: `span` lines, or fewer that have `least_words` words
together. Lines are hashed, and of every window the position of the least line hash is selected (the first of equals):
equal windows have that fingerprint at the same place, without fail. Selected positions are joined by fingerprint; a
fingerprint at one position only has no match. The others are extended both ways by the lines before and after them, as
far as the windows reach whose fingerprint they are: positions that agree in all lines of a window are a match. The
earliest position of a match keeps its lines, the windows of all later ones are deleted. A longer repeated run has a
selected position in each of its windows, so that the deleted windows together are the whole run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import WORD, cut, fresh, join_hot

#: White space at the ends of a line is no part of it.
_BLANK = " \t\x0b\x0c\r"


def selected(docs: DataFrame, span: int = 3, least_words: int = 50) -> DataFrame:
    """doc_id, key, at, h, arms: the selected content lines `at` (from 1) of every text, with their line hash.

    arms: the windows that the line is the fingerprint of, each as a and b, hashes over its lines, and its first and
    last line number. docs: doc_id (rows with a null one have no windows), text, key.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(_BLANK)).alias("t")))
    kept = F.filter(lines, lambda x: x["t"] != "")
    content = F.transform(kept, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g"), F.regexp_count(x["t"], F.lit(WORD)).alias("n")))
    base = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "key", content.alias("c"))

    def part(name: str) -> Column:  # not c.h: that would be taken apart anew at every use
        return F.transform("c", lambda x: x[name]).alias(name)

    base = base.select("doc_id", "key", *map(part, "ihgn"))

    def arm(p: Column, left: int, right: int) -> Column:
        near = lambda name, k: F.get(name, p + (k - 1))
        own, wide = near("h", 0), left + right + 1
        fits = [near("h", -k) > own for k in range(1, left + 1)] + [near("h", k) >= own for k in range(1, right + 1)]
        if left:
            fits.insert(0, p > left)
        if wide < span:
            fits.append(sum((near("n", k) for k in range(1 - left, right + 1)), near("n", -left)) >= least_words)
        fit = F.lit(True)
        for f in fits:
            fit = fit & f
        a, b = F.xxhash64(F.slice("h", p - left, wide)), F.xxhash64(F.lit(wide), F.slice("g", p - left, wide))
        return F.when(fit, F.struct(a.alias("a"), b.alias("b"), near("i", -left).alias("first"), near("i", right).alias("last")))

    def seed(p: Column) -> Column:
        arms = [arm(p, left, right) for left in range(span) for right in range(span - left)]
        return F.struct(p.alias("at"), F.get("h", p - 1).alias("h"), F.array_compact(F.array(*arms)).alias("arms"))

    seeds = F.filter(F.transform(F.sequence(F.lit(1), F.size("h")), seed), lambda s: F.size(s["arms"]) > 0)
    return base.where(F.size("h") > 0).select("doc_id", "key", F.explode(seeds).alias("s")).select("doc_id", "key", "s.*")


def repeated_runs(docs: DataFrame, span: int = 3, least_words: int = 50) -> DataFrame:
    """(doc_id, key, runs: array of (first, last) line numbers to delete) for documents with any.

    docs: doc_id, text, key. Positions are ordered by doc_id and line.
    """
    seeds = cut(selected(docs, span, least_words), "lines-selected")
    place = F.struct("doc_id", "at")
    marks = seeds.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")).where("low < high").select("h", "n")
    joined = join_hot(seeds, *_counted(marks, "lines-marks", ["h"]), how="left_semi")
    arms = cut(joined.select("doc_id", "key", F.explode("arms").alias("w")).select("doc_id", "key", "w.*"), "lines-arms")
    place = F.struct("doc_id", "first")
    match = arms.groupBy("a", "b").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")).where("low < high").select("a", "b", "low", "n")
    later = join_hot(arms, *_counted(match, "lines-matches", ["a", "b"])).where(F.struct("doc_id", "first") > F.col("low"))
    return later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _counted(groups: DataFrame, label: str, keys: list[str]) -> tuple[DataFrame, list[str], str, int]:
    """The arguments of join_hot for groups with their number of rows n."""
    groups = cut(groups, label)
    return groups, keys, "n", groups.agg(F.sum("n")).first()[0] or 0


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3, least_words: int = 50) -> DataFrame:
    """docs with `text_col` without later repeated runs, and `n_lines`, `n_removed` (fresh names where these are taken).

    A line is deleted if it lies in `span` consecutive content lines (lines that are not blank, without white space at
    their ends), or in fewer that have `least_words` words together, that also start at an earlier position: in a
    document with a smaller id, or further up. Blank lines inside a deleted run go with it.
    Defined results: a null text stays null with 0 lines; texts without a window stay; rows with a null id neither
    delete nor lose lines; rows that share id and position delete nothing of each other, so repeated rows give equal
    rows; a text may become empty; an empty table gives no rows; other columns pass through.
    """
    key, lines, gone = fresh(docs, "key_"), fresh(docs, "lines_"), fresh(docs, "runs_")
    found = repeated_runs(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")), span, least_words)
    found = found.select(F.col("doc_id").alias(fresh(docs, "id_")), F.col("key").alias(fresh(docs, "k_")), F.col("runs").alias(gone))
    id_, k_ = found.columns[:2]
    out = docs.withColumn(key, F.xxhash64(text_col)).join(found, (F.col(id_col) == F.col(id_)) & (F.col(key) == F.col(k_)), "left")
    out = out.withColumn(lines, F.split(text_col, "\n", -1))
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    stay = F.array_except(numbers, F.flatten(F.transform(gone, lambda r: F.sequence(r["first"], r["last"]))))
    kept = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    left = F.when(F.col(gone).isNull(), n).otherwise(F.size(stay)).cast("long")
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, n.alias(fresh(docs, "n_lines")), (n - left).alias(fresh(docs, "n_removed")))
