"""SimHash near-duplicates by a binary trie joined with itself.

Every text gets one 64-bit fingerprint. Distinct fingerprints go into several tries, each of which reads another choice
of bit blocks first: with 4 + r blocks and at most 4 differing bits, some r blocks agree, so in the trie that reads those
r blocks first every linked pair starts at one common node. From there node pairs are walked together bit by bit; the
differing bits are added up, and a pair of nodes is left as soon as the error budget is spent.

Nodes too large for one task are cut into chunks, and pairs of chunks are walked as pairs of tries. A task reports a
spanning forest of the links that it finds, never the links themselves, and stars are contracted across tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import components, cut, fresh, unite, whole_groups

BITS = 64
SHINGLE = 4
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: A-Z lowered, `shingle`-word windows, a bit is 1 if set in over half of their XXH64."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
    words = raw.split()  # bytes.split() parts at exactly 0x20 and 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first = end - size
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = end[min(shingle, len(words)) - 1 :]
    h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(first[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):  # a very long text is counted in pieces
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp: the fingerprint's bits as a signed long) for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, fp bigint")


def _layouts(exact: int, budget: int) -> list[np.ndarray]:
    """For each choice of `exact` blocks out of exact + budget: the order in which a trie reads the 64 bits."""
    blocks = np.array_split(np.arange(BITS), exact + budget)
    out = []
    for chosen in combinations(range(len(blocks)), exact):
        rest = [i for i in range(len(blocks)) if i not in chosen]
        out.append((np.concatenate([blocks[i] for i in (*chosen, *rest)]), sum(len(blocks[i]) for i in chosen)))
    return out


def _reordered(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The bits of each fp in `order`, the first as the most significant."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, order]
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="big").reshape(-1).view(">u8").astype(np.uint64)


def walk(path: np.ndarray, nodes: np.ndarray, depth: np.ndarray, budget: int, label: np.ndarray, direct: int = 64, most: int = 400_000, alike: Callable | None = None) -> None:
    """Walk pairs of trie nodes; unite in `label` the leaves that differ in at most `budget` bits.

    alike: tells for leaves (a, b) within the budget which of them to unite; all where None.

    path: for each leaf its bits, in the order of the trie; sorted inside each node. nodes: rows (a0, a1, b0, b1), the
    leaf ranges of two nodes that agree so far (a0 = b0 for a node with itself). depth: bits that each row has read.
    Small node pairs are compared leaf by leaf. At most about `most` pairs are held; the others wait on a stack.
    """
    stack = [(nodes, depth.astype(np.int64), np.zeros(len(nodes), np.int64))]
    while stack:
        n, d, e = stack.pop()
        if not len(n):
            continue
        if len(n) > most:
            half = len(n) // 2
            stack += [(n[:half], d[:half], e[:half]), (n[half:], d[half:], e[half:])]
            continue
        size = (n[:, 1] - n[:, 0]) * (n[:, 3] - n[:, 2])
        small = (size <= direct) | (d >= BITS)
        if small.any():
            _compare(path, n[small], size[small], budget, label, most, alike)
            n, d, e = n[~small], d[~small], e[~small]
        if not len(n):
            continue
        mid = []
        for lo, hi in ((n[:, 0], n[:, 1]), (n[:, 2], n[:, 3])):
            mid.append(_split(path, lo, hi, d))
        same = (n[:, 0] == n[:, 2]) & (n[:, 1] == n[:, 3])
        parts = []
        for a, b, cost in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            keep = e + cost <= budget
            if (a, b) == (1, 0):
                keep &= ~same  # the mirror of (0, 1)
            lo_a, hi_a = (n[:, 0], mid[0]) if a == 0 else (mid[0], n[:, 1])
            lo_b, hi_b = (n[:, 2], mid[1]) if b == 0 else (mid[1], n[:, 3])
            keep &= (hi_a > lo_a) & (hi_b > lo_b)
            parts.append((np.column_stack([lo_a, hi_a, lo_b, hi_b])[keep], d[keep] + 1, e[keep] + cost))
        stack.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))


def _split(path: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where bit `depth` turns from 0 to 1 inside each sorted range: a binary search over all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    shift = (BITS - 1 - depth).astype(np.uint64)
    while (open_ := lo < hi).any():
        m = (lo + hi) >> 1
        one = ((path[np.minimum(m, len(path) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, m, hi)
        lo = np.where(open_ & ~one, m + 1, lo)
    return lo


def _compare(path: np.ndarray, n: np.ndarray, size: np.ndarray, budget: int, label: np.ndarray, most: int, alike: Callable | None) -> None:
    at = 0
    ends = np.cumsum(size)
    while at < len(n):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + 4 * most, "right")))
        rows = np.repeat(np.arange(at, to), size[at:to])
        k = np.arange(len(rows)) - np.repeat(ends[at:to] - size[at:to] - done, size[at:to])
        wide = (n[:, 3] - n[:, 2])[rows]
        a, b = n[rows, 0] + k // wide, n[rows, 2] + k % wide
        near = (a != b) & (label[a] != label[b])
        a, b = a[near], b[near]
        near = np.bitwise_count(path[a] ^ path[b]) <= budget
        a, b = a[near], b[near]
        if alike is not None:
            near = alike(a, b)
            a, b = a[near], b[near]
        unite(label, a, b)
        at = to


def _forest(table: pa.Table, layouts: list, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, root) of a spanning forest of the links inside whole groups of (trie, key, i, j)."""
    trie, key, i, j, side = (table.column(c).to_numpy() for c in ("trie", "key", "i", "j", "side"))
    fp = table.column("fp").to_numpy().view(np.uint64)
    path = np.zeros(len(fp), np.uint64)
    for t in np.unique(trie):
        m = trie == t
        path[m] = _reordered(np.ascontiguousarray(fp[m]), layouts[t][0])
    order = np.lexsort((path, side, j, i, key, trie))
    trie, key, i, j, side, fp, path = (x[order] for x in (trie, key, i, j, side, fp, path))
    new = np.ones(len(fp), bool)
    new[1:] = (trie[1:] != trie[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(fp))
    second = np.concatenate([[0], np.cumsum(side)])
    cross = i[start] != j[start]
    b0 = np.where(cross, end - (second[end] - second[start]), start)
    nodes = np.column_stack([start, np.where(cross, b0, end), b0, end])
    depth = np.array([layouts[t][1] for t in trie[start]], np.int64)
    nodes, depth = (x[(nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2]) & ((end - start) > 1)] for x in (nodes, depth))
    label = np.arange(len(fp))
    walk(path, nodes, depth, budget, label)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked].view(np.int64), fp[label[linked]].view(np.int64)


def trie_links(distinct: DataFrame, budget: int = 4, chunk: int = 8192) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most `budget` bits connect among the distinct `fp`.

    The number of blocks that must agree grows with the number of fingerprints, so that nodes stay small. A node with
    more than `chunk` fingerprints is dealt out by pairs of chunks.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    exact = next((r for r in (1, 2, 3) if n / 2 ** (BITS * r / (r + budget)) <= 512), 3)
    layouts = _layouts(exact, budget)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for t, (order, deep) in enumerate(layouts):
                key = (_reordered(np.ascontiguousarray(fp.view(np.uint64)), order) >> np.uint64(BITS - deep)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key), pa.array(fp)], names=["trie", "key", "fp"])

    dealt = distinct.select("fp").mapInArrow(spread, "trie int, key bigint, fp bigint")
    large = dealt.groupBy("trie", "key").count().where(F.col("count") > chunk)
    large = cut(large.select("trie", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "trie-large")
    if large.limit(1).count():
        dealt = dealt.join(large, ["trie", "key"], "left")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("chunks", F.lit(1))).cast("int")
        dealt = dealt.select("trie", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("other"))
        dealt = dealt.select("trie", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    else:
        zero = F.lit(0)
        dealt = dealt.select("trie", "key", zero.alias("i"), zero.alias("j"), zero.alias("side"), "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["trie", "key", "i", "j"], 200_000):
            a, b = _forest(table, layouts, budget)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = ["trie", "key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """docs' id, `fingerprint` (16 hex digits) and `component_id`, the least id reachable by links; one row per row.

    Defined results: a null, empty or blank text has fingerprint zero and links like any other; a text with fewer words
    than a shingle is one shingle; repeated rows share fingerprint and component; a null id takes part in links, but a
    component's id is its least non-null id (null if it has none); an empty table gives no rows; extra columns are not
    read. Texts with equal fingerprints are one node of the search, whatever their number.
    """
    marks = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = marks.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(trie_links(classes, budget), "simhash-cc")
    found = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = cut(found, "simhash-classes")
    first = found.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = found.join(first, "root").select("fp", "component_id")
    out = marks.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """The rows of docs that stay: of each component the row with the least id; of rows that repeat it, one.

    Of rows without an id one stays, and only where their component has no id at all.
    """
    return keep_first(docs, near_duplicates(docs, id_col, text_col, budget), id_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the component_id that `groups` gives it; of rows that repeat one, one."""
    names = [fresh(docs, x) for x in ("key_a", "key_b", "key_n")]
    a, b, n = names

    def keys(df: DataFrame) -> DataFrame:
        return df.withColumns({a: F.xxhash64(id_col), b: F.xxhash64(id_col, F.lit(7))})  # never null

    keep = keys(groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col)).select(a, b).distinct()
    rest = [c for c in docs.columns if c != id_col]
    once = Window.partitionBy(a, b).orderBy(F.xxhash64(*rest)) if rest else Window.partitionBy(a, b).orderBy(a)
    return keys(docs).join(keep, [a, b], "left_semi").withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*docs.columns)
