"""Near-duplicates by the Jaccard similarity of word shingles: tries over slices of a long SimHash, then exact sets.

Texts with the same set of shingles are one class. A class has a fingerprint of 1,024 bits, and several tries read other
slices of it first. Classes that share a slice start at one node of its trie; from there pairs of nodes are walked together
over the next 64 bits, as in simhash_trie, and a pair is left once it differs in too many. Leaves that are reached are
compared on the first 256 bits; what is near there is joined into loose groups. Inside a loose group the similarity of the shingle sets themselves decides, so no link is below the threshold.
With more classes slices get longer, so that nodes stay small, and tries get more, so that the recall stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import components, cut, unite, whole_groups
from quernel.llm.simhash_trie import keep_first, walk
from quernel.llm.word_hash import mix, rolling, slices, word_hashes

BITS = 1024
SHINGLE = 5
#: The share of bits that differ at a similarity of 0.8 is 0.15, up to 0.19 where shingles are few.
DIFFER = 0.17
#: Differing bits that are let through: of the first 64, and of the first 256.
LOOSE = (24, 76)
_BASE = 0xD1342543DE82EF95
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTS = np.random.default_rng(20240611).integers(0, 1 << 63, BITS // 64, dtype=np.uint64)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles, A-Z lowered; a text with fewer words is one shingle."""
    for a, b, data, offsets in slices(texts):
        h, at = word_hashes(_LOWER[data], offsets)
        for k in range(b - a):
            words = h[at[k] : at[k + 1]]
            yield np.unique(rolling(words, min(shingle, len(words)), _BASE)) if len(words) else words


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The 1,024 bits of a set of shingles, packed: a bit is 1 if set in over half of their hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 255):
        wide = mix(shingles[at : at + 255, None] ^ _SALTS)
        ones += np.add.reduce(np.unpackbits(wide.view(np.uint8).reshape(-1), bitorder="little").reshape(-1, BITS), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little")


def tries_for(classes: int, recall: float = 0.995) -> list[np.ndarray]:
    """For each trie the bits of its slice: some 512 classes or fewer share a slice by chance, and `recall` is kept."""
    width = max(8, math.ceil(math.log2(max(1, classes) / 512)))
    tries = math.ceil(math.log(1 - recall) / math.log1p(-((1 - DIFFER) ** width)))
    rng = np.random.default_rng(width)
    return [rng.choice(BITS, width, replace=False) for _ in range(tries)]


def walk_tries(heads: np.ndarray, start: np.ndarray, end: np.ndarray, cross: np.ndarray, side: np.ndarray, label: np.ndarray) -> None:
    """Unite in `label` the rows of `heads` (4 words each) that are near, inside nodes of rows start to end that share a
    slice; of a pair of chunks (cross) only rows of different sides."""
    node = np.repeat(np.arange(len(start)), end - start)
    order = np.lexsort((heads[:, 0], np.where(np.repeat(cross, end - start), side, 0), node))  # each side of a node in the order of its trie
    heads, own = heads[order], np.arange(len(order))
    second = np.where(cross, end - np.add.reduceat(side, start), start)
    first_end = np.where(cross, second, end)
    nodes = np.column_stack([start, first_end, second, end])
    nodes = nodes[(first_end > start) & (end > second) & (end - start > 1)]

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(heads[a] ^ heads[b]).sum(axis=1, dtype=np.int64) <= LOOSE[1]

    walk(np.ascontiguousarray(heads[:, 0]), nodes, np.zeros(len(nodes), np.int64), LOOSE[0], own, most=100_000, alike=alike)
    hit = np.flatnonzero(own != np.arange(len(own)))
    unite(label, order[hit], order[own[hit]])


def _similar(sets: list[np.ndarray], side: np.ndarray, cross: bool, least: Fraction, label: np.ndarray) -> None:
    """Unite in `label` the sets whose Jaccard similarity is at least `least`."""
    sizes = np.array([len(s) for s in sets], np.int64)
    for i, own in enumerate(sets[:-1]):
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        fit = (label != label[i]) & (small * least.denominator >= large * least.numerator)
        fit[: i + 1] = False
        if cross:
            fit &= side != side[i]
        others = np.flatnonzero(fit)
        if not len(others) or not len(own):
            continue
        flat, owner = np.concatenate([sets[j] for j in others]), np.repeat(np.arange(len(others)), sizes[others])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.bincount(owner[own[at] == flat], minlength=len(others))
        near = others[both * least.denominator >= (sizes[others] + sizes[i] - both) * least.numerator]
        unite(label, np.full(len(near), i), near)


def _by_groups(dealt: DataFrame, key: str, chunk: int, least: int, forest) -> DataFrame:
    """Edges (a, b) of the forests that `forest(table, start, end, cross, side, label)` finds in groups of equal `key` (rows
    start to end), dealt out by pairs of chunks where they are large. dealt: cls, key and what forest reads."""
    large = dealt.groupBy(key).count().where(F.col("count") > chunk)
    large = cut(large.select(key, F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "slices-large")
    rest = [c for c in dealt.columns if c != key]
    if large.limit(1).count():
        dealt = dealt.join(large, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.pmod(F.xxhash64("cls", F.lit(7)), "chunks").cast("int")
        dealt = dealt.select(key, *rest, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        dealt = dealt.select(key, *rest, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    else:
        dealt = dealt.select(key, *rest, *[F.lit(0).alias(c) for c in ("i", "j", "side")])
    keys = [key, "i", "j"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, least):
            k, i, j, side, cls = (table.column(c).to_numpy() for c in (*keys, "side", "cls"))
            start = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            label = np.arange(len(k))
            forest(table, start, np.append(start[1:], len(k)), i[start] != j[start], side, label)
            hit = np.flatnonzero(label != np.arange(len(k)))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(cls[label[hit]])], names=["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a bigint, b bigint")


def loose_links(classes: DataFrame, chunk: int = 8192) -> DataFrame:
    """Edges (a, b) that join classes (cls, fp) which share a slice and are near on the first 256 bits, by walks of its trie."""
    chosen = tries_for(classes.count())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                packed = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                head = packed[:, :32].copy().view(np.int64)
                bits = np.unpackbits(packed, axis=1, bitorder="little")
                words = [pa.array(np.ascontiguousarray(head[:, w])) for w in range(4)]
                for t, slice_ in enumerate(chosen):
                    node = bits[:, slice_] @ (1 << np.arange(len(slice_), dtype=np.int64)) + (t << len(slice_))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), *words], names=["cls", "node", "f0", "f1", "f2", "f3"])

    def forest(table, start, end, cross, side, label):
        walk_tries(np.column_stack([table.column(f"f{w}").to_numpy().view(np.uint64) for w in range(4)]), start, end, cross, side, label)

    dealt = classes.select("cls", "fp").mapInArrow(spread, "cls bigint, node bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    return _by_groups(dealt, "node", chunk, 65_536, forest)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: Fraction = Fraction(4, 5), shingle: int = SHINGLE, chunk: int = 512) -> DataFrame:
    """docs' id and `component_id`, the least id reachable by links of Jaccard similarity `least` or more; a row per row.

    Defined results: null, empty and blank texts have no shingles and link with one another; repeated rows share a
    component; a null id takes part in links, but a component's id is its least non-null id (null if it has none); an
    empty table gives no rows; extra columns are not read.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, fps = np.zeros(b.num_rows, np.uint64), []
            for k, s in enumerate(shingle_sets(b.column(2), shingle)):
                cls[k] = mix(np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0]
                fps.append(fingerprint(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls.view(np.int64)), pa.array(fps, pa.binary())], names=["id", "own", "cls", "fp"])

    def forest(table, start, end, cross, side, label):
        for s, e, c in zip(start.tolist(), end.tolist(), cross.tolist(), strict=True):
            if e - s > 1:
                own = np.arange(e - s)
                _similar(list(shingle_sets(table.column("text").slice(s, e - s), shingle)), side[s:e], c, least, own)
                label[s:e] = s + own

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text"))
    marks = cut(texts.mapInArrow(mark, f"id {kind}, own bigint, cls bigint, fp binary"), "slices-marks")
    classes = cut(marks.groupBy("cls").agg(F.min("id").alias("least"), F.min("own").alias("own"), F.first("fp").alias("fp")), "slices-classes")
    loose = components(loose_links(classes), "slices-loose")
    wanted = classes.join(loose, F.col("cls") == F.col("node")).select("cls", "own", "root")
    members = cut(texts.select("own", "text").join(wanted, "own").dropDuplicates(["cls"]).select("cls", "root", "text"), "slices-members")
    roots = components(_by_groups(members, "root", chunk, 512, forest), "slices-cc")
    found = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    found = cut(found, "slices-found")
    first = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(found.join(first, "root").select("cls", "component_id"), "cls").select(F.col("id").alias(id_col), "component_id")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that stay: of each component of similar texts the row with the least id, as in keep_first."""
    return keep_first(docs, similar_texts(docs, id_col, text_col, **params), id_col)
