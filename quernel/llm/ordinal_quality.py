"""Quality grades by ordinal cumulative-link regression on hashed text.

A text has one score, a sum of hashed-feature weights shared by all grades; ordered thresholds cut the score into
grades: P(grade <= k) = 1 / (1 + exp(score - threshold_k)). The model gives an expected grade and the probability of a
grade of at least `select`, by which documents are kept.

Features, hashed into one space of weights: the distinct words, lower case and without punctuation, each by presence;
and how much of the text is upper case, digits, white space, single punctuation marks, words that repeat the word
before, words seen before in the text, and long or short words, each as one bin of its share on a log scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut, fresh
from quernel.llm.word_hash import mix, slices, word_hashes

SPACE_BITS = 20
GRADES = 3
_PART = 1 << 18
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(_MARKS)] = 32
    table[48:58] = 48  # digits are alike
    return table


def _classes() -> np.ndarray:
    """For each byte the number of its class: 0 none, 1 upper case, 2 digit, 3 white space, then each mark."""
    table = np.zeros(256, np.uint8)
    table[65:91], table[48:58], table[[9, 10, 11, 12, 13, 32]] = 1, 2, 3
    table[list(_MARKS)] = np.arange(4, 4 + len(_MARKS))
    return table


_PLAIN, _CLASS = _plain(), _classes()
_N_CLASS = 4 + len(_MARKS)


def _bins(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Half-octave bins of a share; 0: none at all."""
    share = part / np.maximum(whole, 1)
    return np.where(part > 0, 1 + np.floor(2 * np.log2(np.maximum(share, 2.0**-12) * 4096)).astype(np.int64), 0)


def features(texts: pa.Array, bits: int = SPACE_BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ends, features): the feature numbers of text first + i are features[ends[i]:ends[i + 1]]."""
    for first, _, data, offsets in slices(texts):
        n = len(offsets) - 1
        h, at = word_hashes(_PLAIN[data], offsets)
        doc = np.repeat(np.arange(n), np.diff(at))
        size, words = np.diff(offsets), np.diff(at)
        order = np.lexsort((h, doc))
        dh, dd = h[order], doc[order]
        new = np.ones(len(dh), bool)
        new[1:] = (dh[1:] != dh[:-1]) | (dd[1:] != dd[:-1])
        own = np.repeat(np.arange(n), size)
        counts = np.bincount(own * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
        shares = [(counts[:, c], size) for c in range(1, _N_CLASS)]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        shares.append((np.bincount(doc[again], minlength=n), words))
        shares.append((words - np.bincount(dd[new], minlength=n), words))
        shares.append((size, np.maximum(words, 1) * 64))
        shares.append((np.minimum(words, 4096), np.full(n, 4096)))
        ids = [mix(np.uint64(0xA5A5 + k * 1000) + _bins(p, w).astype(np.uint64)) for k, (p, w) in enumerate(shares)]
        rows = np.concatenate([dd[new], *[np.arange(n)] * len(ids)])
        feats = (np.concatenate([dh[new], *ids]) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(rows, kind="stable")
        yield first, np.searchsorted(rows[order], np.arange(n + 1)), feats[order]


class OrdinalModel:
    """Weights of hashed features and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    @classmethod
    def fit(cls, ends: np.ndarray, feats: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, bits: int = SPACE_BITS, least: int = 10, steps: int = 150, rate: float = 0.15, decay: float = 2e-4) -> OrdinalModel:
        """Maximum likelihood with a quadratic penalty, by full-batch steps with adapted rates (Adam); no randomness.

        Features in fewer than `least` texts have weight zero.
        """
        counts = np.zeros(1 << bits, np.int64)
        for at in range(0, len(feats), _PART):
            counts += np.bincount(feats[at : at + _PART], minlength=1 << bits)
        used = np.flatnonzero(counts >= least)
        place = np.full(1 << bits, -1, np.int32)
        place[used] = np.arange(len(used))
        col = place[feats]
        row = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))[col >= 0]
        col = col[col >= 0]
        del counts, feats, place
        parts = [slice(at, at + _PART) for at in range(0, len(col), _PART)]  # so that no copy is as long as the sample
        n = len(grades)
        y = grades.astype(np.int64)
        if not n:  # without ratings nothing speaks against a text: every grade is likely
            return cls(np.zeros(1 << bits, np.float32), np.arange(-n_grades + 1, 0, dtype=np.float64) * 4, bits)
        below = np.cumsum(np.bincount(y, minlength=n_grades))[:-1]
        t0 = np.log((below + 0.5) / (n - below + 0.5))
        x = np.concatenate([np.zeros(len(used)), t0[:1], np.log(np.maximum(np.diff(t0), 0.1))])  # gaps stay positive
        m, v = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, steps + 1):
            w, first, gaps = x[: len(used)], x[len(used)], np.exp(x[len(used) + 1 :])
            theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
            score = np.zeros(n)
            for p in parts:
                score += np.bincount(row[p], w[col[p]], minlength=n)
            s = _sigmoid(theta[None, :] - score[:, None])
            cdf = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
            mass = np.maximum(cdf[np.arange(n), y + 1] - cdf[np.arange(n), y], 1e-12)
            d = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
            up, low = d[np.arange(n), y + 1] / mass, d[np.arange(n), y] / mass  # of the log likelihood, by the upper and lower cut
            g_score = -(up - low)
            g_theta = np.array([up[y == k].sum() - low[y == k + 1].sum() for k in range(n_grades - 1)])
            g_gaps = np.cumsum(g_theta[::-1])[::-1]
            g_w = np.zeros(len(used))
            for p in parts:
                g_w += np.bincount(col[p], g_score[row[p]], minlength=len(used))
            g = np.concatenate([g_w, g_gaps[:1], g_gaps[1:] * gaps]) / n
            g[: len(used)] -= decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-4)
        weights = np.zeros(1 << bits, np.float32)
        weights[used] = x[: len(used)]
        theta = x[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(x[len(used) + 1 :]))])
        return cls(weights, theta, bits)

    def tails(self, ends: np.ndarray, feats: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, .. for each text."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[feats].astype(np.float64))])
        score = sums[ends[1:]] - sums[ends[:-1]]
        return 1 - _sigmoid(self.thresholds[None, :] - score[:, None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The graded rating of a label: 0 toxic, 1 not toxic but of low quality, 2 neither; null if either is null."""
    return F.when(F.col(toxic).isNull() | F.col(quality).isNull(), None).when(F.col(toxic) != 0, 0).when(F.col(quality) == 0, 1).otherwise(2)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 16_000, bits: int = SPACE_BITS, n_grades: int = GRADES, **fit) -> OrdinalModel:
    """A model from ratings (id, grade), fitted on at most `most` rated documents; without any it keeps all texts.

    The sample is the rated ids with the least hashes, so it is the same on every run and needs no pass over the texts;
    the texts' feature numbers, never the texts, come to the driver: some MB, whatever the corpus.
    """
    rated = ratings.where("grade is not null and id is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = cut(rated.orderBy(F.xxhash64("id"), "id").limit(most), "quality-sample")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # `most` rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, ends, feats in features(b.column(1), bits):
                out += [feats[s:e].astype(np.int32).tobytes() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["id", "grade", "feats"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = picked.mapInArrow(work, f"id {kind}, grade int, feats binary").orderBy("id", "feats").select("grade", "feats").toArrow()
    feats = rows.column("feats").combine_chunks()  # some MB: see `most`
    feats = feats.chunk(0) if isinstance(feats, pa.ChunkedArray) and feats.num_chunks else feats
    grades = rows.column("grade").to_numpy().astype(np.int64)
    if not len(grades):
        return OrdinalModel.fit(np.zeros(1, np.int64), np.zeros(0, np.int32), grades, n_grades, bits, **fit)
    _, offsets, data = feats.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(feats.type) else np.int32)[feats.offset : feats.offset + len(grades) + 1].astype(np.int64)
    return OrdinalModel.fit((offsets - offsets[0]) // 4, np.frombuffer(data, np.int32)[offsets[0] // 4 : offsets[-1] // 4], grades, n_grades, bits, **fit)


def scored(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", select: int = 2, least: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability (of a grade >= select) and keep (fresh names where these are taken).

    Defined results: a null text is scored as an empty one; a text without words has its length and share features
    only; repeated rows score alike; null ids and other columns pass through; an empty table gives no rows.
    """
    names = [fresh(docs, c) for c in ("expected_grade", "tail_probability", "keep")]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.bits))  # 4 bytes a feature number: bounded
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = OrdinalModel(*shared.value)
        for b in batches:
            tails = [model.tails(ends, feats) for _, ends, feats in features(b.column(at), model.bits)]
            if not tails:
                continue
            tail = np.concatenate(tails)
            columns = [*b.columns, pa.array(tail.sum(axis=1)), pa.array(tail[:, select - 1]), pa.array(tail[:, select - 1] >= least)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may clash but for their letter case
    k = len(docs.columns)
    schema = ", ".join([*[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)], f"c{k} double, c{k + 1} double, c{k + 2} boolean"])
    return plain.mapInArrow(work, schema).toDF(*docs.columns, *names)
