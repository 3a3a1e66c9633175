"""Packing by lexical retrieval: windows are filled with unused BM25 neighbours of the document that opens them.

Documents are dealt over shards of bounded size by likeness: each has a few keys, words chosen by consistent sampling in
which long words, which are rarer, weigh more, so that documents share a key as often as they share such words. Ordered
by their keys, documents are cut into shards. Every shard builds an inverted index of its documents; the number of
documents, the mean length and the document frequencies are those of the whole corpus. A window is opened by a seed: the
rest of the document that the window before cut, or the next unused document. When a document ends inside a window, the
unused document of the shard with the best BM25 score for the seed follows; without any that shares a term, the next
unused one. A query has all terms of its seed. Only a shard's last window is short; it is cut into sequences whose
lengths are powers of two.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut, per_process, tasks
from quernel.llm.word_hash import hashes_and_lengths, mix, slices

#: Cells in each of the two rows of the count-min sketch of document frequencies. Terms that are rarer than one in a
#: cell's share of all postings (2^-20) share cells and weigh about alike.
SKETCH_BITS = 20
K1, B = 1.2, 0.75
KEYS = 2
#: Bytes that a document counts for besides its text, so that a shard of short ones has a bounded number of them.
LEAST = 1024
#: Bits of a term's hash: terms are told apart inside a shard by so many.
TERM_BITS = 42
_ROW = 0x632BE59BD9B4E019
_MOST = 1 << (56 - TERM_BITS)  # texts whose terms are sorted at once
_PARTS = 16  # of a row of the sketch


class Encoder:
    """Token ids as the tokenizers library gives them for a tokenizer file, without added special tokens.

    ranks: the same vocabulary for tiktoken, which is several times faster. Texts that hold the file's special token,
    which the two libraries treat differently, and texts that the fast one can't take go to tokenizers.
    """

    def __init__(self, file: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        """The ids of text, then id 0."""
        if any(s in text for s in self.special):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            try:
                ids = self.fast.encode_ordinary(text)
            except BaseException as e:  # it panics on texts that overrun its regular expression stack
                if type(e).__name__ != "PanicException":  # a class that the library does not export
                    raise
                ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array([*ids, 0], "<u4")


def encoder(files: tuple[str, str, str]) -> Encoder:
    made = per_process()
    if ("encoder", files) not in made:
        made["encoder", files] = Encoder(*files)
    return made["encoder", files]


def public_files() -> tuple[str, str, str]:
    """The byte-level BPE of 50,257 ids: tokenizers' file, tiktoken's file, the pattern that parts texts."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def _terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, document, term, length, count, words) for runs of texts: their distinct terms and numbers of words.

    A term is TERM_BITS of a word's hash, A-Z lowered; ordered by document and term. Lengths stop at 255 bytes.
    """
    lower = data.copy()
    lower[(lower >= 65) & (lower <= 90)] += 32
    h, at, size = hashes_and_lengths(lower, offsets)
    code = (h >> np.uint64(64 - TERM_BITS) << np.uint64(8)) | np.minimum(size, 255).astype(np.uint64)
    for a in range(0, len(at) - 1, _MOST):
        first = at[a : a + _MOST + 1]
        words = np.diff(first)
        key = np.sort(np.repeat(np.arange(len(words), dtype=np.uint64) << np.uint64(TERM_BITS + 8), words) | code[first[0] : first[-1]])
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, n = key[start], np.diff(np.append(start, len(key)))
        term = (key >> np.uint64(8)) & np.uint64((1 << TERM_BITS) - 1)
        yield a, (key >> np.uint64(TERM_BITS + 8)).astype(np.int64), term, (key & np.uint64(255)).astype(np.int64), n, words


def _salted(term: np.ndarray, salt: int) -> np.ndarray:
    return mix(term ^ np.uint64(_ROW * salt % 2**64))


def _cells(term: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each term in either row of the sketch."""
    return [(_salted(term, r + 1) >> np.uint64(64 - bits)).astype(np.int64) for r in range(2)]


_CUBES = np.maximum(np.arange(256), 1).astype(np.float64) ** 3


def _keys(doc: np.ndarray, term: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts KEYS of its terms, by consistent sampling with the cubes of their lengths as weights."""
    out = np.zeros((KEYS, n), np.int64)
    if len(term):
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        weight = -1 / _CUBES[size]
        for k in range(KEYS):
            u = ((_salted(term, k + 11) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            race = np.log(u) * weight
            best = np.minimum.reduceat(race, start)
            won = np.flatnonzero(race == np.repeat(best, np.diff(np.append(start, len(doc)))))
            out[k, doc[won]] = term[won].view(np.int64)
    return out


def _prepared(docs: DataFrame, kind: str, bits: int) -> DataFrame:
    """One row per document with its keys, and rows with parts of the sketch of the documents that a task has seen.

    docs: id, text, hash. A document's row has a null part. Part -1 holds the numbers of documents and words.
    """
    span = (1 << bits) // _PARTS
    keys = [f"k{k}" for k in range(KEYS)]
    names = ["id", "text", "hash", "size", *keys, "part", "sums"]
    schema = f"id {kind}, text string, hash bigint, size bigint, {', '.join(k + ' bigint' for k in keys)}, part int, sums binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, types = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64), None
        for b in batches:
            found, size = [np.zeros((KEYS, 0), np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in slices(b.column(1)):
                for _, doc, term, length, _, words in _terms(data, offsets):
                    for r, cell in enumerate(_cells(term, bits)):
                        np.add.at(df[r], cell, 1)
                    total += [len(words), words.sum()]
                    found.append(_keys(doc, term, length, len(words)))
                size.append(np.diff(offsets) + LEAST)
            types = [*b.schema.types, *[pa.int64()] * (1 + KEYS), pa.int32(), pa.binary()]
            rest = [pa.nulls(b.num_rows, t) for t in types[-2:]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(size)), *map(pa.array, np.concatenate(found, axis=1)), *rest], names=names)
        if types is not None:
            parts = [(-1, total), *[(r * _PARTS + k, df[r, k * span : (k + 1) * span]) for r in range(2) for k in range(_PARTS)]]
            columns = [pa.nulls(len(parts), t) for t in types[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p for p, _ in parts], pa.int32()), pa.array([_packed(x) for _, x in parts], pa.binary())], names=names)

    return docs.mapInArrow(work, schema)


def _packed(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little") * 8, "zstd", asbytes=True), np.int64)


class Statistics:
    """The number of documents, their mean words, and document frequencies by a count-min sketch of two rows."""

    def __init__(self, n: int, words: int, sketch: np.ndarray, bits: int):
        self.n, self.mean, self.sketch, self.bits = n, words / max(1, n), sketch, bits

    def idf(self, term: np.ndarray) -> np.ndarray:
        df = np.min([self.sketch[r][cell] for r, cell in enumerate(_cells(term, self.bits))], axis=0)
        return np.log1p(np.maximum(self.n - df + 0.5, 0.5) / (df + 0.5))


def _statistics(prepared: DataFrame, bits: int) -> Statistics:
    """The sketches of all tasks, added up part by part in two steps; 2 * 2^bits numbers come to the driver."""
    blobs = prepared.where("part is not null").select("part", "sums")
    many = max(1, math.isqrt(blobs.count() // (2 * _PARTS + 1)))

    def merge(key, table):
        total = sum(_unpacked(x.as_py()) for x in table.column("sums"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([_packed(total)], pa.binary())})

    some = blobs.groupBy("part", F.pmod(F.xxhash64("sums"), F.lit(many)).alias("g")).applyInArrow(merge, "part int, sums binary")
    sums = {r["part"]: _unpacked(r["sums"]) for r in some.groupBy("part").applyInArrow(merge, "part int, sums binary").collect()}
    if not sums:
        return Statistics(0, 0, np.zeros((2, 1 << bits), np.int64), bits)
    rows = [np.concatenate([sums[r * _PARTS + k] for k in range(_PARTS)]) for r in range(2)]
    return Statistics(*sums[-1].tolist(), np.stack(rows), bits)


class Index:
    """BM25 over the documents of one shard, with the statistics of the corpus.

    Terms of many documents are rows of a dense table, and their part of the scores is a product of matrices, made for a
    run of seeds at a time; the postings of the others are added up seed by seed.
    """

    def __init__(self, texts: pa.Array, stats: Statistics, dense: int = 16, run: int = 256):
        parts = [(d + first + a, t, c, w) for first, _, data, offsets in slices(texts) for a, d, t, _, c, w in _terms(data, offsets)]
        doc, term, count, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.n, self.run = len(texts), run
        if len(term) < 1 << (64 - TERM_BITS):
            order = np.sort((term << np.uint64(64 - TERM_BITS)) | np.arange(len(term), dtype=np.uint64))
            term, at = order >> np.uint64(64 - TERM_BITS), (order & np.uint64((1 << (64 - TERM_BITS)) - 1)).astype(np.int64)
        else:  # a shard of one document that is far longer than a shard
            at = np.argsort(term, kind="stable")
            term = term[at]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(term)))
        doc, count = doc[at], count[at]
        weight = np.repeat(stats.idf(term[first]), many) * count * (K1 + 1) / (count + K1 * (1 - B + B * words[doc] / max(stats.mean, 1e-9)))
        often = many > max(dense, self.n // dense)
        of = np.repeat(np.cumsum(often) - 1, many)
        wide = np.repeat(often, many)
        self.table = np.zeros((int(often.sum()), self.n))
        self.table[of[wide], doc[wide]] = weight[wide]
        self.blocks: dict[int, np.ndarray] = {}
        rare = (many > 1) & ~often  # terms of one document of the shard lead nowhere
        keep = np.repeat(rare, many)
        self.posting_doc, self.posting_weight = doc[keep], weight[keep]
        self.first = np.append(0, np.cumsum(many[rare]))
        own = np.repeat(np.arange(int(rare.sum())), many[rare])
        by_doc = np.argsort(self.posting_doc, kind="stable")
        self.doc_term = own[by_doc]
        self.doc_first = np.searchsorted(self.posting_doc[by_doc], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for all terms of the seed."""
        block = seed // self.run
        if block not in self.blocks:
            asked = self.table[:, block * self.run : (block + 1) * self.run] > 0
            self.blocks[block] = asked.T.astype(np.float64) @ self.table
        score = self.blocks[block][seed % self.run].copy()
        terms = self.doc_term[self.doc_first[seed] : self.doc_first[seed + 1]]
        if len(terms):
            a, b = self.first[terms], self.first[terms + 1]
            size = b - a
            flat = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            score += np.bincount(self.posting_doc[flat], self.posting_weight[flat], minlength=self.n)
        return score

    def neighbours(self, seed: int, free: np.ndarray, k: int = 8) -> tuple[np.ndarray, bool]:
        """The k best free documents that share a term with the seed (best first, ties by position), or all; whether all."""
        score = np.where(free, self.scores(seed), 0.0)
        found = np.flatnonzero(score >= np.partition(score, -k)[-k]) if self.n > k else np.arange(self.n)
        found = found[score[found] > 0]
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, len(found) < k


def windows(lengths: np.ndarray, index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); every token of every document stands in exactly one."""
    free = np.ones(len(lengths), bool)
    out, now, room = [], [], window
    next_free, doc, start = 0, -1, 0
    seed, ranked, at, whole = -1, None, 0, False
    while True:
        if doc < 0:  # the window needs a document
            while seed >= 0:
                while ranked is not None and at < len(ranked) and not free[ranked[at]]:
                    at += 1
                if ranked is not None and (at < len(ranked) or whole):
                    break
                ranked, whole = index.neighbours(seed, free)
                at, whole = 0, whole or not len(ranked)
            if ranked is not None and at < len(ranked):
                doc = int(ranked[at])
            else:
                while next_free < len(free) and not free[next_free]:
                    next_free += 1
                if next_free == len(free):
                    break
                doc = next_free
            free[doc], start = False, 0
        if seed < 0:
            seed, ranked = doc, None
        n = min(room, int(lengths[doc]) - start)
        now.append((doc, start, n))
        room, start = room - n, start + n
        if start == lengths[doc]:
            doc = -1
        if not room:
            out.append(now)
            now, room, seed, ranked = [], window, -1, None
    return out + _powers_of_two(now)


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces cut into sequences of descending powers of two."""
    total = sum(n for _, _, n in pieces)
    out, i, used = [], 0, 0
    for size in (1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1):
        now, room = [], size
        while room:
            doc, start, n = pieces[i]
            take = min(room, n - used)
            now.append((doc, start + used, take))
            room, used = room - take, used + take
            if used == n:
                i, used = i + 1, 0
        out.append(now)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, files: tuple[str, str, str] | None = None, shard_bytes: int = 4 << 20, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document.

    files: see Encoder. shard_bytes: text of a shard and LEAST for each document, and one document more at most. bits: see
    SKETCH_BITS.
    Defined results: a null text is an empty one, which is the single id 0; repeated rows are packed once each; a null
    id passes through; equal scores go to the document that is first by keys, id and text hash; a document longer than a
    window fills several; an empty table gives no rows; other columns are not read.
    """
    files = files or public_files()
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prepared = cut(_prepared(docs.withColumn("hash", F.xxhash64("text")), kind, bits), "packing-keys")
    stats = spark.sparkContext.broadcast(_statistics(prepared, bits))  # 16 * 2^bits bytes
    docs = prepared.where("part is null").drop("part", "sums")
    size = docs.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(-(-size // shard_bytes), max(tasks(spark), size // (32 << 20))))
    order = [f"k{k}" for k in range(KEYS)] + ["id", "hash"]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, room = [], shard_bytes
        for b in batches:
            ends, at = np.cumsum(b.column(3).to_numpy()), 0
            while at < b.num_rows:
                base = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(ends, base + room)) + 1, b.num_rows)
                held.append(b.slice(at, to - at))
                room -= int(ends[to - 1]) - base
                at = to
                if room <= 0:
                    yield pa.Table.from_batches(held)
                    held, room = [], shard_bytes
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for table in shards(batches):
            texts = table.column("text").combine_chunks()
            encode, known, ids = encoder(files), {}, []
            for t in texts.to_pylist():  # copies stand in the same shard
                if t not in known:
                    known[t] = encode(t)
                ids.append(known[t])
            lengths = np.array([len(x) for x in ids])
            packed = windows(lengths, Index(texts, stats.value), window)
            rows = [(d, s, n, zlib.crc32(ids[d][s : s + n].tobytes()), base + q) for q, seq in enumerate(packed) for d, s, n in seq]
            base += len(packed)
            offset = np.concatenate([np.cumsum([0, *[n for _, _, n in seq[:-1]]]) for seq in packed])
            doc, start, length, crc, sequence = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            own = table.column("id").combine_chunks().take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([own, *map(pa.array, (start, length, crc, lengths[doc], sequence, offset.astype(np.int64)))], names=names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    dealt = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
