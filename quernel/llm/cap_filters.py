"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes a filter if it lies in the cap around that direction. The directions are a
product code: the (randomly rotated) space is cut into blocks, every block has a code of random orthonormal directions
and their negatives, and a direction is one word from each block. A vector's filters are list-decoded: block by block,
partial sums are dropped as soon as the best words left cannot lift them over the cap's height. Vectors meet at common
filters; their cosines are then computed in double precision, so no link below the threshold is reported.

Equal vectors are one class, found by grouping, however many they are. A pair of classes is counted only at its first
common filter. A filter with more members than a task takes is dealt out by pairs of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import components, cut, named_ids, numbered_ids, unite, whole_groups

SEED = 20240607
#: Independent codes; with more of them the numbers of filters that vectors pass differ less.
CODES = 8
#: Common filters that a pair at the least cosine has on average.
COMMON = 12.0


def _log_tail(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles from 0 to a right angle, and the log of the share of the sphere in `dim` > 1 dimensions within each."""
    angle = np.linspace(1e-6, math.pi / 2, 20_001)
    log = (dim - 2) * np.log(np.sin(angle))
    area = np.exp(log - log[-1])
    total = np.cumsum(np.append(area[0] * angle[0], (area[1:] + area[:-1]) / 2 * np.diff(angle)))
    return angle, np.log(np.maximum(total, 1e-300) / (2 * total[-1]))


def cap_height(dim: int, share: float) -> float:
    """The height of a cap that has `share` (up to a half) of the sphere: exactly, not by the normal distribution."""
    if dim < 3:
        return NormalDist().inv_cdf(1 - share) / math.sqrt(dim)
    angle, log = _log_tail(dim)
    return math.cos(float(np.interp(math.log(share), log, angle)))


def shared(dim: int, height: float, cosine: float) -> float:
    """The probability that a vector is in a cap if another at `cosine` to it is."""
    if dim < 4 or not 0 <= cosine < 1:
        return 1.0
    angle = np.linspace(0, math.acos(height), 4001)[1:]
    t = np.cos(angle)
    least = (height - cosine * t) / (math.sqrt(1 - cosine**2) * np.maximum(np.sin(angle), 1e-12))
    to, log = _log_tail(dim - 1)
    one = np.exp(np.interp(np.arccos(np.clip(np.abs(least), 0, 1)), to, log))
    one = np.where(least < 0, 1 - one, np.where(least >= 1, 0, one))
    weight = np.exp((dim - 2) * (np.log(np.sin(angle)) - math.log(math.sin(angle[-1]))))
    return float((weight * one).sum() / weight.sum())


def codes_for(dim: int, count: int, passes: float, bucket: int, seed: int = SEED, least: float = 0.93) -> list[ProductCode]:
    """Codes for a label of `count` classes: a vector passes `passes` filters, or more where higher caps are shared less."""
    height = min(cap_height(dim, min(bucket / max(count, 1), 0.5)), 0.7)
    passes = max(passes, COMMON / max(shared(dim, height, least), 1e-3))
    filters = max(8, math.ceil(count * passes / bucket / CODES))
    return [ProductCode(dim, filters, passes / CODES, seed + k) for k in range(CODES)]


class ProductCode:
    """Random product code for `dim` components: `filters` directions or more; a random vector passes `passes` of them."""

    def __init__(self, dim: int, filters: int, passes: float, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        most = max(1, min(3, dim // 4))  # of blocks, each with its directions' negatives at least
        self.blocks = next((m for m in range(most, 2, -1) if filters >= (2 * -(-dim // m)) ** m), min(2, most))
        self.cuts = [len(x) for x in np.array_split(np.arange(dim), self.blocks)]
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        words = max(2 * max(self.cuts), math.ceil(filters ** (1 / self.blocks)))
        self.codes = [self._code(rng, d, words) for d in self.cuts]
        self.base = words
        height = cap_height(dim, min(passes / words**self.blocks, 0.5))
        self.height = min(height, 0.7) * math.sqrt(self.blocks)  # a direction's words have length 1 each

    @staticmethod
    def _code(rng: np.random.Generator, dim: int, words: int) -> np.ndarray:
        parts = []
        while sum(map(len, parts)) < words:
            q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            parts += [q, -q]
        return np.concatenate(parts)[:words]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every filter that a row of `unit` passes, ordered by row and filter."""
        x = unit @ self.turn
        at, scores = 0, []
        for d, code in zip(self.cuts, self.codes, strict=True):
            scores.append(x[:, at : at + d] @ code.T)
            at += d
        rest = np.zeros((self.blocks + 1, len(x)))  # the most that blocks from i on can add
        for i in range(self.blocks - 1, -1, -1):
            rest[i] = rest[i + 1] + scores[i].max(axis=1)
        row, word, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, s in enumerate(scores):
            order = np.argsort(-s, axis=1, kind="stable")
            ranked = np.take_along_axis(s, order, axis=1)
            need = self.height - total - rest[i + 1][row]
            many = (ranked[row] >= need[:, None]).sum(axis=1)
            part = np.repeat(np.arange(len(row)), many)
            k = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
            total = total[part] + ranked[row[part], k]
            word = word[part] * self.base + order[row[part], k]
            row = row[part]
        order = np.lexsort((word, row))
        return row[order], word[order]


def _passing(classes: DataFrame, counts: dict[int, int], passes: float, bucket: int, seed: int, least: float) -> DataFrame:
    """Classes with `filters`, the sorted filters that they pass. counts: the most classes of one label, by dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                values, offsets = _flat(b.column(3))
                dims = np.diff(offsets)
                rows, words = [], []
                for d in np.unique(dims).tolist():
                    if d not in codes:
                        codes[d] = codes_for(d, counts[d], passes, bucket, seed, least)
                    own = np.flatnonzero(dims == d)
                    unit = _units(values[offsets[own][:, None] + np.arange(d)].astype(np.float64))
                    for k, code in enumerate(codes[d]):
                        row, word = code.decode(unit)
                        rows.append(own[row])
                        words.append(word * CODES + k)
                row, word = np.concatenate(rows), np.concatenate(words)
                order = np.lexsort((word, row))
                ends = np.searchsorted(row[order], np.arange(b.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word[order]))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(dims, pa.int32()), lists], names=["cid", "label", "copies", "dim", "filters"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("cid", "label", "copies", "vec").mapInArrow(work, f"cid bigint, label {label}, copies bigint, dim int, filters array<bigint>")


def _units(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list array end to end, and where each list starts (one entry more at the end)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _bucket_links(unit: np.ndarray, side: np.ndarray | None, copies: np.ndarray, filters: list[np.ndarray], filter_id: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For the members of one filter: copies linked to each, and a forest (label array). side: of a pair of its chunks."""
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    label = np.arange(len(unit))
    hit = np.flatnonzero(near.any(axis=1))
    if not len(hit):
        return np.zeros(len(unit), np.int64), label
    a, b = np.nonzero(near)
    unite(label, a[a < b], b[a < b])
    lists = [filters[i][filters[i] < filter_id] for i in hit.tolist()]
    known, at = np.unique(np.concatenate(lists), return_inverse=True)
    row = np.repeat(np.arange(len(hit)), [len(x) for x in lists])
    earlier = np.zeros((len(hit), len(hit)), bool)
    for first in range(0, len(known), 4096):  # some filters at a time: there may be very many
        some = (at >= first) & (at < first + 4096)
        has = np.zeros((len(hit), min(4096, len(known) - first)), np.float32)
        has[row[some], at[some] - first] = 1
        earlier |= has @ has.T > 0.5
    near[np.ix_(hit, hit)] &= ~earlier  # pairs with an earlier common filter are counted there
    return (near.astype(np.float64) @ copies.astype(np.float64)).astype(np.int64), label


def cap_links(classes: DataFrame, least: float, passes: float = 20.0, bucket: int = 48, chunk: int = 2048, seed: int = SEED) -> DataFrame:
    """(cid, linked: copies in other classes linked to it, root) from every filter where a class has a link.

    classes: cid, label, vec (finite, not zero, not null), copies. passes: how many filters a vector passes on average
    at least, which sets the recall; large labels have higher caps, which are shared less, and take more. The number of
    filters grows with the rows of a label so that a filter holds about `bucket` vectors; a filter with over `chunk` is dealt out by pairs of chunks.
    """
    sizes = classes.groupBy("label", F.size("vec").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n"))
    counts = {r["dim"]: r["n"] for r in sizes.collect()}  # one row per dimension
    passing = cut(_passing(classes, counts, passes, bucket, seed, least), "cap-filters")
    narrow = passing.select("cid", "label", "dim", F.explode("filters").alias("filter"))
    key = ["label", "dim", "filter"]
    large = narrow.groupBy(*key).count().where(F.col("count") > 1)
    large = large.select(*key, F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    dealt = narrow.join(large, key)  # a filter with one member has no pair
    own = F.pmod(F.xxhash64("cid", "filter"), F.col("chunks")).cast("int")
    dealt = dealt.select("cid", "filter", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("cid", "filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    body = passing.join(classes.select("cid", "vec"), "cid")
    dealt = dealt.join(body, "cid")
    keys = ["label", "dim", "filter", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 4096):
            cols = [table.column(k).to_numpy() for k in keys]
            cid, copies, side = (table.column(k).to_numpy() for k in ("cid", "copies", "side"))
            (vec, v_at), (passed, f_at) = _flat(table.column("vec")), _flat(table.column("filters"))
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            start, out = np.flatnonzero(new), []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), table.num_rows], strict=True):
                if e - s > 1:
                    unit = _units(vec[v_at[s] : v_at[e]].reshape(e - s, -1).astype(np.float64))
                    lists = [passed[f_at[k] : f_at[k + 1]] for k in range(s, e)]
                    linked, label = _bucket_links(unit, side[s:e] if cols[3][s] != cols[4][s] else None, copies[s:e], lists, int(cols[2][s]), least)
                    has = (linked > 0) | (label != np.arange(e - s))
                    if has.any():
                        out.append((cid[s:e][has], linked[has], cid[s:e][label[has]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cid", "linked", "root"])

    dealt = dealt.select("cid", *keys, "side", "copies", "filters", "vec").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(verify, "cid bigint, linked bigint, root bigint")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, **params) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of df.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is at least `least`.
    Defined results: null, empty or zero vectors and those with a null or non-finite component link with nothing, nor
    does a null label; equal vectors, repeated rows included, link with one another; a null id counts as a link, but
    component_id is the least non-null id and the row is not kept; ids that are not integers are ordered as Spark sorts
    them; an empty table gives no rows; other columns are not read.
    """
    df, places = numbered_ids(df.select(id_col, vec_col, label_col), id_col, "cap-ids")
    df = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    valid = df.where(F.col("label").isNotNull() & F.col("vec").isNotNull()).where(fine)
    classes = valid.groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "cap-classes")
    found = cut(cap_links(classes, least, **params), "cap-links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "cap-cc")
    linked = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    named = classes.drop("vec", "label").join(linked, "cid", "left").join(roots, F.col("cid") == roots["node"], "left")
    named = cut(named.select("cid", "least_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "cap-named")
    first = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(first, "root").select("cid", "n_links", "component_id")
    of = classes.select("label", "vec", "cid").join(named, "cid").drop("cid")
    out = df.join(of, ["label", "vec"], "left")
    own = F.coalesce("component_id", "id")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
    return named_ids(out, places, id_col, "component_id")
