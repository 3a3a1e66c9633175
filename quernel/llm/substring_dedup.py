"""Exact removal of word windows that an earlier document has, behind a count-min prefilter.

A window's cells in the sketch are chosen by its least 26-word shingle hash: equal windows have equal cells, so the
sketch overestimates the number of documents that hold a window, and neighbouring windows mostly share their cells, so
a document updates about one cell per 14 words. First pass: every partition counts its documents' cells; the counts are
merged by ranges of cells. Second pass: windows estimated in one document only are dropped; the others are grouped
exactly, by 96 bits of hash of the word sequence (words by 64 bits, long ones by a cryptographic digest). A window repeated in two documents has a count of at least two in
every row of the sketch, so none is lost; a sketch that is too full only lets more windows through to the grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut, named_ids, numbered_ids, tasks
from quernel.llm.word_hash import mix, rolling, slices, sliding_min, word_hashes

_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_ROWS = 2  # of the sketch
_RANGE = 1 << 22  # cells that are merged by one task


class _Windows:
    """The windows of a run of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, inner: int):
        self.h, self.first = word_hashes(data, offsets)
        n = len(self.h)
        self.width = width
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if n < width:
            self.at = np.zeros(0, np.int64)
            self.doc, self.anchor = doc[:0], self.h[:0]
            return
        ok = doc[: n - width + 1] == doc[width - 1 :]
        self.at = np.flatnonzero(ok)  # windows by the index of their first word
        self.doc = doc[self.at]
        self.anchor = sliding_min(rolling(self.h, inner, _BASES[2]), width - inner + 1)[self.at]

    def hashes(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for the picked windows."""
        at = self.at[pick]
        return rolling(self.h, self.width, _BASES[0])[at], (rolling(mix(self.h), self.width, _BASES[1])[at] >> np.uint64(32)).astype(np.uint32)


def _cells(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each anchor in every row of the sketch; width: a power of two."""
    return [(mix(anchor + np.uint64(r * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(width - 1)).astype(np.int64) for r in range(_ROWS)]


def _packed(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), kind)


def _count_cells(docs: DataFrame, width: int, span: int, inner: int) -> DataFrame:
    """(row, range, cells): per batch, sorted cells as differences; the lowest bit says two documents or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = []
            for _, _, data, offsets in slices(b.column(1)):
                w = _Windows(data, offsets, span, inner)
                new = np.ones(len(w.at), bool)
                new[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])
                a, d = w.anchor[new], w.doc[new]
                order = np.lexsort((a, d))
                a, d = a[order], d[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                seen.append(a[new])
            anchors = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
            out = []
            for r, cells in enumerate(_cells(anchors, width)):
                cell, n = np.unique(cells, return_counts=True)
                code = cell * 2 + (n > 1)
                bounds = np.searchsorted(cell, np.arange(0, width + _RANGE, _RANGE))
                out += [(r, k, _packed(np.diff(code[s:e], prepend=k * _RANGE * 2).astype(np.uint32))) for k, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if e > s]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["row", "range", "cells"])

    return docs.select("doc_id", "text").mapInArrow(work, "row int, range int, cells binary")


def _merged(counts: DataFrame) -> DataFrame:
    """(row, range, bits): a bit per cell, set if two documents or more were counted."""

    def merge(key, table):
        total = np.zeros(_RANGE, np.uint8)
        base = key[1].as_py() * _RANGE
        for blob in table.column("cells"):
            code = np.cumsum(_unpacked(blob.as_py(), np.uint32).astype(np.int64)) + base * 2
            cell = (code >> 1) - base
            total[cell] = np.minimum(total[cell] + 1 + (code & 1).astype(np.uint8), 2)
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "range": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([np.packbits(total > 1, bitorder="little").tobytes()], pa.binary())})

    return counts.groupBy("row", "range").applyInArrow(merge, "row int, range int, bits binary")


def _min_id(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the least id among entries of the same window."""
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.empty(len(a), np.int64)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return least


def _by_document(ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc_id, text key, starts of windows to remove) from one entry per window."""
    if not len(ids):
        return []
    order = np.lexsort((at, keys, ids))
    ids, keys, at = ids[order], keys[order], at[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    s = np.flatnonzero(new)
    return [(int(ids[a]), int(keys[a]), at[a:e].astype(np.int32).tobytes()) for a, e in zip(s.tolist(), [*s[1:].tolist(), len(ids)], strict=True)]


_CANDIDATES = "shard int, hits int, h1 binary, h2 binary, doc binary, at binary, doc_ids binary, keys binary"


def _candidates(docs: DataFrame, sketch, width: int, shards: int, span: int, inner: int) -> DataFrame:
    """Windows that the sketch lets through, packed by shard.

    A row with hits = 0 holds windows to be grouped; of windows repeated inside the batch only those of the smallest
    doc_id. A row with hits = 1 holds the others, which are known to be repeated.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            keys = b.column(2).to_numpy()
            parts = []
            for first, _, data, offsets in slices(b.column(1)):
                w = _Windows(data, offsets, span, inner)
                maybe = known[first + w.doc]
                for row, cells in zip(bits, _cells(w.anchor, width), strict=True):
                    maybe &= (row[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
                if maybe.any():
                    pick = np.flatnonzero(maybe)
                    parts.append((*w.hashes(pick), w.doc[pick] + first, w.at[pick] - w.first[w.doc[pick]], w.anchor[pick]))
            if not parts:
                continue
            h1, h2, doc, at, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
            later = ids[doc] > _min_id(h1, h2, ids[doc])
            shard = np.where(later, mix(keys[doc].view(np.uint64)), mix(anchor ^ np.uint64(0x51ED270B7F3A1C55))) % np.uint64(shards)
            shard = shard.astype(np.int64) * 2 + later
            order = np.argsort(shard, kind="stable")
            shard, h1, h2, doc, at = (x[order] for x in (shard, h1, h2, doc, at))
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            out = []
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
                docs_, local = np.unique(doc[s:e], return_inverse=True)
                hit = int(shard[s] & 1)
                none = np.zeros(0, np.uint8)
                out.append((int(shard[s] >> 1), hit, _packed(none if hit else h1[s:e]), _packed(none if hit else h2[s:e]), _packed(local.astype(np.int32)), _packed(at[s:e].astype(np.int32)), _packed(ids[docs_]), _packed(keys[docs_])))
            names = [x.split()[0] for x in _CANDIDATES.split(", ")]
            kinds = [pa.int32()] * 2 + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text", "key").mapInArrow(work, _CANDIDATES)


def _repeated(candidates: DataFrame) -> DataFrame:
    """(doc_id, key, at): starts of windows that a document with a smaller doc_id has; grouped exactly inside a shard."""

    def group(key, table):
        names = ("h1", "h2", "doc", "at", "doc_ids", "keys")
        kinds = (np.uint64, np.uint32, np.int32, np.int32, np.int64, np.int64)
        open_, known = [], []
        for row in table.to_pylist():
            h1, h2, doc, at, ids, keys = (_unpacked(row[c], t) for c, t in zip(names, kinds, strict=True))
            (known if row["hits"] else open_).append((h1, h2, ids[doc], keys[doc], at))
        found = [x[2:] for x in known]
        if open_:
            h1, h2, ids, keys, at = (np.concatenate(x) for x in zip(*open_, strict=True))
            later = ids > _min_id(h1, h2, ids)
            found.append((ids[later], keys[later], at[later]))
        out = _by_document(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return pa.table({"doc_id": pa.array([x[0] for x in out], pa.int64()), "key": pa.array([x[1] for x in out], pa.int64()), "at": pa.array([x[2] for x in out], pa.binary())})

    return candidates.groupBy("shard").applyInArrow(group, "doc_id bigint, key bigint, at binary")


def repeated_windows(docs: DataFrame, span: int = 50, inner: int = 26, most_cells: int = 1 << 28) -> DataFrame:
    """(doc_id, key, at: list of binaries, int32 starts of repeated windows) for documents with any.

    docs: doc_id long, text string, key long. The sketch has about eight cells per expected update, at most `most_cells`
    in a row; a bit per cell of each of its two rows (64 MB at most in all) is sent to the executors.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(most_cells, max(_RANGE, 1 << (int(size / 84) * 8).bit_length()))
    bits = [np.zeros(width // 8, np.uint8) for _ in range(_ROWS)]
    for r in _merged(_count_cells(docs, width, span, inner)).toLocalIterator():  # width / 8 bytes a row: bounded
        bits[r["row"]][r["range"] * _RANGE // 8 : (r["range"] + 1) * _RANGE // 8] = np.frombuffer(r["bits"], np.uint8)
    sketch = spark.sparkContext.broadcast(bits)
    shards = max(tasks(spark), size // (24 << 20))
    found = _repeated(_candidates(docs, sketch, width, shards, span, inner))
    return cut(found.groupBy("doc_id", "key").agg(F.collect_list("at").alias("at")), "windows-repeated")


def _kept(text: str | None, starts: list[bytes] | None, span: int) -> tuple[int, int, bytes]:
    words = b"" if text is None else text.encode("utf-8", "surrogatepass")
    words = words.split()
    if not starts:
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in starts]))
    cover[at] += 1
    np.subtract.at(cover, at + span, 1)
    stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay.tolist()])


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, with_text: bool = False, **params) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and `kept`, the words left, if with_text), one row per row of docs.

    A word goes if it is covered by a window of `span` words whose word sequence also starts in a document with a
    smaller id; windows are those of the input.
    Defined results: a null text has no words; texts shorter than a window stay; a row with a null id neither removes
    nor loses words; rows that share an id do not remove each other's words; repeated rows give equal rows; ids that are
    not integers are ordered as Spark sorts them; an empty table gives no rows; other columns are not read.
    """
    docs, places = numbered_ids(docs.select(id_col, text_col), id_col, "window-ids")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    found = repeated_windows(docs, span, **params)
    joined = docs.join(found, ["doc_id", "key"], "left").select("doc_id", "text", "at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, at in zip(b.column(1), b.column(2), strict=True):
                n, gone, kept = _kept(text.as_py(), at.as_py(), span)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            n, gone, sha, kept = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = joined.mapInArrow(work, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    cols = [F.col("doc_id").alias(id_col), "n_words", "n_removed", "kept_sha256"]
    return named_ids(out.select(*cols, "kept") if with_text else out.select(*cols), places, id_col)
