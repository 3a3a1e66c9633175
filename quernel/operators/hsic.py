"""Kernel dependence (HSIC) and HSIC-lasso feature selection.

Kernels are taken between all pairs of rows. A Gaussian kernel of one column is, to rounding, a product of a few functions
of each row (a Chebyshev series, or the column's values where they are few), so the sums over all pairs follow from one
pass over the rows. The median distance of all pairs is exact: sorted values are cut into blocks, and only pairs of blocks
that can hold the median are counted. Columns too wide for a series take all pairs of rows: they are dealt to blocks, every
task gets one pair of blocks, and only sums leave it; equal rows are one row with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.ordered import medians
from quernel.operators.aggregates import linear_hsic_column, long_form

#: Rows of a block, on average.
BLOCK = 4096
#: Kernel values that a task holds at once.
_HELD = 1 << 17
#: Terms of a column's series, and of all columns together; beyond, kernels are taken pair by pair.
TERMS, ALL_TERMS = 512, 2048
#: The most that a series may differ from its kernel.
_EXACT = 1e-12
#: Thresholds that a pass over pairs of blocks counts at, and distinct pairs of values that the driver may hold at its end.
_AT_ONCE, _FEW = 16, 1 << 20


def impute(df: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """Nulls and NaN of numeric columns replaced by the column's median, mean, or zero."""
    clean = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    if how == "zero":
        return clean.na.fill(0.0, list(columns))
    if how not in ("median", "mean"):
        raise ValueError(f"unknown imputation: {how}")
    fill = medians(clean, columns) if how == "median" else clean.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return clean.na.fill({c: fill[c] for c in columns if fill[c] is not None})


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; constants become 0."""
    s = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - (s[c]["m"] or 0.0)) / s[c]["s"] if s[c]["s"] else F.lit(0.0) for c in columns})


def linear_hsic(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """feature, hsic with linear kernels: one aggregate over all rows."""
    rows = long_form(df, columns, "double", [F.col(y).cast("double").alias("y")])
    return rows.groupBy("feature").agg(linear_hsic_column(F.col("value"), F.col("y")).alias("hsic"))


def _rows(df: DataFrame, columns: Sequence[str], max_rows: int | None, order: str | None, seed: int) -> DataFrame:
    """(v: the columns as an array, w: how many rows have it); rows with a null are left out. max_rows: of a sample."""
    value = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(value.alias("v"), *([F.col(order).alias("o")] if order else [])).where(~F.exists("v", lambda x: x.isNull()))
    if max_rows is not None:
        rows = rows.orderBy("o" if order else F.rand(seed)).limit(max_rows)  # a sample only where the caller asks for one
    return rows.groupBy("v").agg(F.count("*").cast("double").alias("w"))


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """(i, j, side, v, w): every row once for each pair i <= j of blocks that its own block is in."""
    blocks = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    dealt = rows.select("v", "w", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    return dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "v", "w")


def _two_sides(key, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(values by column and row, weights) of both blocks of a pair, and whether they are the same block."""
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).T
    w, side = table.column("w").to_numpy(), table.column("side").to_numpy(zero_copy_only=False).astype(bool)
    same = key[0].as_py() == key[1].as_py()
    a = np.ascontiguousarray(x if same else x[:, ~side])
    return (a, w, a, w, True) if same else (a, w[~side], np.ascontiguousarray(x[:, side]), w[side], False)


def _median_squares(pairs: DataFrame, p: int, n: float) -> np.ndarray:
    """For each column the median squared distance of all pairs of different rows.

    Squares are sorted by their bits: pass by pass, 11 bits more of the two middle values are found from counts, so only
    2048 counts a column and middle value leave the blocks.
    """
    total = int(n) * (int(n) - 1)  # ordered pairs: every unordered one twice
    rank = np.array([[2 * ((total // 2 - 1) // 2), 2 * (total // 4)]] * p, np.int64)
    prefix = np.zeros((p, 2), np.uint64)
    for shift, width in ((53, 11), (42, 11), (31, 11), (20, 11), (9, 11), (0, 9)):
        known = prefix.copy()

        def count(key, table):  # used up inside this pass
            xa, wa, xb, wb, same = _two_sides(key, table)
            hist = np.zeros((p, 2, 1 << width))
            step = max(1, _HELD // max(1, len(wb)))
            for at in range(0, len(wa), step):
                rows = np.arange(at, min(at + step, len(wa)))
                weight = wa[rows, None] * wb[None, :] * (1 if same else 2)
                if same:
                    weight[np.arange(len(rows)), rows] -= wa[rows]  # a row is no pair with itself
                for f in range(p):
                    bits = ((xa[f, rows, None] - xb[f, None, :]) ** 2).view(np.uint64).ravel()
                    for t in range(2):
                        if t and known[f, 1] == known[f, 0]:
                            continue  # counted once for both
                        hit = np.flatnonzero((bits >> np.uint64(shift + width)) == known[f, t]) if shift + width < 64 else slice(None)
                        digit = (bits[hit] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                        hist[f, t] += np.bincount(digit.view(np.int64), weight.ravel()[hit], 1 << width)
            f, t, digit = np.nonzero(hist)
            return pa.table([pa.array(f), pa.array(t), pa.array(digit), pa.array(hist[f, t, digit].astype(np.int64))], names=["f", "t", "digit", "n"])

        hist = np.zeros((p, 2, 1 << width), np.int64)
        for r in pairs.groupBy("i", "j").applyInArrow(count, "f long, t long, digit long, n long").groupBy("f", "t", "digit").agg(F.sum("n").alias("n")).collect():
            hist[r["f"], r["t"], r["digit"]] = r["n"]
        alike = prefix[:, 0] == prefix[:, 1]
        hist[alike, 1] = hist[alike, 0]
        for f in range(p):
            for t in range(2):
                upto = np.cumsum(hist[f, t])
                digit = int(np.searchsorted(upto, rank[f, t], "right"))
                rank[f, t] -= upto[digit] - hist[f, t, digit]
                prefix[f, t] = (prefix[f, t] << np.uint64(width)) | np.uint64(digit)
    return prefix.view(np.float64).mean(axis=1)


def _sorted_blocks(values: DataFrame, block: int) -> DataFrame:
    """(f, low, high, total, own, v, w): the distinct values of each column in order, in blocks; total: their rows, own: the
    sum of the squares of their weights."""
    size = max(block, -(-values.count() // 1024))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            f, x, w = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
            cuts = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1).tolist(), len(f)]
            parts = [slice(a, b) for s, e in zip(cuts, cuts[1:], strict=False) for a, b in ((a, min(a + size, e)) for a in range(s, e, size))]
            many = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([int(f[c.start]) for c in parts], pa.int32()), pa.array([x[c][0] for c in parts]), pa.array([x[c][-1] for c in parts]), pa.array([w[c].sum() for c in parts]), pa.array([w[c] @ w[c] for c in parts]), pa.array([x[c] for c in parts], many), pa.array([w[c] for c in parts], many)], names=["f", "low", "high", "total", "own", "v", "w"])

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= size:
                yield from out()
                held = []
        if sum(h.num_rows for h in held):
            yield from out()

    return values.repartitionByRange("f", "x").sortWithinPartitions("f", "x").mapInArrow(work, "f int, low double, high double, total double, own double, v array<double>, w array<double>")


def _upto(a: np.ndarray, b: np.ndarray, most: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each a, the range of the sorted b (not below a; after a's own place if same) whose squared distance is at most `most`."""
    first = np.arange(1, len(a) + 1) if same else np.zeros(len(a), np.int64)
    at = np.maximum(np.searchsorted(b, a + np.sqrt(most), "right"), first)
    while (over := (at > first) & ((b[np.maximum(at - 1, 0)] - a) ** 2 > most)).any():
        at = at - over
    while (under := (at < len(b)) & ((b[np.minimum(at, len(b) - 1)] - a) ** 2 <= most)).any():
        at = at + under
    return first, at


def _median_squares_sorted(values: DataFrame, p: int, n: float, block: int) -> np.ndarray:
    """For each column the median squared distance of all pairs of different rows; values: (f, x, w), distinct.

    A middle value lies between bounds (as the bits of a double, the lower one excluded) that the ends of the blocks give.
    Pass by pass, pairs of blocks whose distances can lie there are counted at thresholds between the bounds, until few
    pairs of values are left, which are sorted.
    """
    total = int(n) * (int(n) - 1)  # ordered pairs: every unordered one twice
    ranks = sorted({2 * ((total // 2 - 1) // 2), 2 * (total // 4)})
    blocks = _sorted_blocks(values, block).persist()
    spark = values.sparkSession
    bits = lambda x: np.asarray(x, np.float64).view(np.int64)
    try:
        ends: dict[int, list] = {f: [] for f in range(p)}
        for r in blocks.select("f", "low", "high", "total", "own").collect():  # some 1024 blocks a column
            ends[r["f"]].append((r["low"], r["high"], r["total"], r["own"]))
        pairs, bounds = {}, {}
        for f, rows in ends.items():
            low, high, weight, own = np.array(sorted(rows)).T
            i, j = np.triu_indices(len(low))
            least, most = bits(np.where(i == j, 0.0, (low[j] - high[i]) ** 2)), bits((high[j] - low[i]) ** 2)
            count = np.where(i == j, weight[i] * weight[i] - weight[i], 2 * weight[i] * weight[j]).astype(np.int64)
            pairs[f] = (low[i], low[j], least, most, count)
            up, down = np.argsort(least), np.argsort(most)
            for r in ranks:
                a = least[up][np.searchsorted(np.cumsum(count[up]), r, "right")] - 1
                b = most[down][np.searchsorted(np.cumsum(count[down]), r, "right")]
                bounds[f, r] = (int(a), int(b), None if a >= 0 else 0, None)  # above a, up to b; rows up to a; distinct pairs between
        found: dict[tuple[int, int], float] = {}
        while True:
            for key, (a, b, _, _) in bounds.items():
                if b - a == 1:
                    found[key] = float(np.int64(b).view(np.float64))
            todo = {k: x for k, x in bounds.items() if k not in found}
            if not todo:
                break
            few = {k for k, (_, _, below, between) in todo.items() if below is not None and between is not None and between <= _FEW}
            at: dict[int, list[int]] = {}
            for (f, r), (a, b, _, _) in todo.items():
                if (f, r) not in few:
                    at.setdefault(f, []).extend(a + (b - a) * k // _AT_ONCE for k in range(_AT_ONCE + 1) if a + (b - a) * k // _AT_ONCE >= 0)
            at = {f: sorted(set(x)) for f, x in at.items()}
            ranges = {f: sorted({todo[k][:2] for k in few if k[0] == f}) for f in {k[0] for k in few}}
            members, base, number = [], {}, 0
            for f in set(at) | set(ranges):
                left, right, least, most, count = pairs[f]
                lower = min([*at.get(f, []), *[a + 1 for a, _ in ranges.get(f, [])]])
                upper = max([*at.get(f, []), *[b for _, b in ranges.get(f, [])]])
                open_ = (least <= upper) & (most >= lower)
                base[f] = int(count[most < lower].sum())
                for x, y in zip(left[open_].tolist(), right[open_].tolist(), strict=True):
                    members.append((f, x, number, 0))
                    if x != y:
                        members.append((f, y, number, 1))
                    number += 1

            def count_pairs(table):  # used up inside this pass
                order = np.argsort(table.column("side").to_numpy())
                f, same = table.column("f")[0].as_py(), len(order) == 1
                (a, wa), (b, wb) = ((table.column("v")[int(k)].values.to_numpy(), table.column("w")[int(k)].values.to_numpy()) for k in (order[0], order[-1]))
                before, out = np.concatenate([[0.0], np.cumsum(wb)]), []
                for t in at.get(f, ()):
                    first, to = _upto(a, b, float(np.int64(t).view(np.float64)), same)
                    n = 2 * (wa @ (before[to] - before[first])) + (wa @ (wa - 1) if same else 0)
                    out.append((f, t, int(n), int((to - first).sum()) + (len(a) if same else 0), False))
                for low, high in ranges.get(f, ()):
                    first, to = _upto(a, b, float(np.int64(high).view(np.float64)), same)
                    start = _upto(a, b, float(np.int64(low).view(np.float64)), same)[1] if low >= 0 else first
                    k = np.repeat(np.arange(len(a)), to - start)
                    j = np.arange(len(k)) - np.repeat(np.cumsum(to - start) - (to - start), to - start) + start[k]
                    squares, weight = ((b[j] - a[k]) ** 2).view(np.int64), 2 * wa[k] * wb[j]
                    if same and low < 0:
                        squares, weight = np.append(squares, 0), np.append(weight, wa @ (wa - 1))
                    each, of = np.unique(squares, return_inverse=True)
                    out += [(f, int(t), int(x), 0, True) for t, x in zip(each, np.bincount(of, weight), strict=True)]
                cols = list(zip(*out, strict=True)) or [()] * 5
                return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["f", "t", "n", "pairs", "value"])

            dealt = blocks.join(F.broadcast(spark.createDataFrame(members, "f int, low double, pair int, side int")), ["f", "low"]).select("pair", "side", "f", "v", "w")
            got: dict[tuple[int, bool], list] = {}
            counted = dealt.groupBy("pair").applyInArrow(count_pairs, "f int, t long, n long, pairs long, value boolean")
            for r in counted.groupBy("f", "t", "value").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).collect():  # thresholds, or _FEW values
                got.setdefault((r["f"], r["value"]), []).append((r["t"], r["n"], r["pairs"]))
            for (f, r), (a, b, below, _) in todo.items():
                if (f, r) in few:
                    for t, x, _ in sorted(v for v in got[f, True] if a < v[0] <= b):
                        below += x
                        if below > r:
                            found[f, r] = float(np.int64(t).view(np.float64))
                            break
                    continue
                seen = [(a, below, 0)] if below is not None and a < 0 else []
                seen += [(t, base[f] + x, m) for t, x, m in sorted(got[f, False]) if a <= t <= b]
                k = next(k for k, (_, x, _) in enumerate(seen) if x > r)
                bounds[f, r] = (seen[k - 1][0], seen[k][0], seen[k - 1][1], seen[k][2] - seen[k - 1][2])
        return np.array([np.mean([found[f, r] for r in (ranks[0], ranks[-1])]) for f in range(p)])
    finally:
        blocks.unpersist()


class _Series:
    """A kernel exp(-(x - y)^2 / (2 s2)) on a range as terms(x) @ a @ terms(y): a Chebyshev series, or given values."""

    def __init__(self, s2: float, low: float, high: float, values: np.ndarray | None = None):
        self.middle, self.half, self.values, self.a = (low + high) / 2, (high - low) / 2, values, None
        if values is not None:
            self.size, self.a = len(values), np.exp(-((values[:, None] - values) ** 2) / (2 * s2))
            return
        m = max(1, min(TERMS + 1, math.ceil(2 * self.half / math.sqrt(s2)))) if self.half else 1
        while m <= TERMS:
            angle = np.pi * (np.arange(m) + 0.5) / m
            node, d = np.cos(angle) * self.half, np.cos(np.outer(np.arange(m), angle)) * 2 / m
            d[0] /= 2
            a = d @ np.exp(-((node[:, None] - node) ** 2) / (2 * s2)) @ d.T
            grid = np.linspace(-1, 1, 3 * m + 2)
            t = np.polynomial.chebyshev.chebvander(grid, m - 1)
            if np.abs(t @ a @ t.T - np.exp(-(((grid[:, None] - grid) * self.half) ** 2) / (2 * s2))).max() <= _EXACT:
                self.size, self.a = m, a
                return
            m += max(4, m // 4)

    def terms(self, x: np.ndarray) -> np.ndarray:
        if self.values is not None:
            return (x[:, None] == self.values).astype(float)
        return np.polynomial.chebyshev.chebvander(np.clip((x - self.middle) / (self.half or 1.0), -1, 1), self.size - 1)


def _gram_of_series(rows: DataFrame, series: Sequence[_Series], n: float) -> np.ndarray:
    """HSIC of every pair of columns from sums of products of their terms: one pass over the rows."""
    p, at = len(series), np.concatenate([[0], np.cumsum([s.size for s in series])])
    size = int(at[-1]) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            for k in range(0, b.num_rows, 8192):
                part = b.slice(k, 8192)
                w, v = part.column(1).to_numpy(), part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, p)
                x = np.concatenate([*[s.terms(v[:, f]) for f, s in enumerate(series)], np.ones((len(v), 1))], axis=1)
                total += x.T @ (x * w[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in total], pa.list_(pa.float64())), pa.array(np.arange(size))], names=["s", "at"])

    total = np.zeros((size, size))
    parts = rows.select("v", "w").mapInArrow(products, "s array<double>, at long").select("at", F.posexplode("s").alias("k", "x"))
    for r in parts.groupBy("at", "k").agg(F.sum("x").alias("x")).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s")).collect():  # the squared number of terms
        total[r["at"]] = [x["x"] for x in r["s"]]
    centred = total[:-1, :-1] - np.outer(total[:-1, -1], total[-1, :-1]) / n
    out = np.zeros((p, p))
    for f in range(p):
        for g in range(f, p):
            m = centred[at[f] : at[f + 1], at[g] : at[g + 1]]
            out[f, g] = out[g, f] = np.sum((series[f].a @ m) * (m @ series[g].a)) / ((n - 1) * (n - 1))
    return out


def _kernel_sums(pairs: DataFrame, s2: np.ndarray) -> DataFrame:
    """Per block pair: (v, w, k: kernel sums with the other block) for its rows, and a row without v whose k is the
    matrix of sums of products of two columns' kernels."""
    p, scale = len(s2), -0.5 / np.asarray(s2, np.float64)

    def work(key, table):
        xa, wa, xb, wb, same = _two_sides(key, table)
        ka, kb, cross = np.zeros(xa.shape), np.zeros(xb.shape), np.zeros((p, p))
        step = max(1, _HELD // max(1, len(wb) * p))
        for at in range(0, len(wa), step):
            part = slice(at, at + step)
            k = xa[:, part, None] - xb[:, None, :]
            np.exp(k * k * scale[:, None, None], out=k)
            ka[:, part] = k @ wb
            weighted = k * wa[part, None]
            if not same:
                kb += weighted.sum(axis=1)
            cross += k.reshape(p, -1) @ (weighted * wb).reshape(p, -1).T
        rows = [(x, w, k) for x, w, k in ((xa, wa, ka), *(() if same else ((xb, wb, kb),)))]
        v = [*np.concatenate([x.T for x, _, _ in rows]).tolist(), None]
        k = [*np.concatenate([k.T for _, _, k in rows]).tolist(), (cross if same else 2 * cross).ravel().tolist()]
        w = [*np.concatenate([w for _, w, _ in rows]).tolist(), 0.0]
        kind = pa.list_(pa.float64())
        return pa.table([pa.array(v, kind), pa.array(w, pa.float64()), pa.array(k, kind)], names=["v", "w", "k"])

    return pairs.groupBy("i", "j").applyInArrow(work, "v array<double>, w double, k array<double>")


def _row_sums(parts: DataFrame, p: int) -> DataFrame:
    """(v, w, k): for each distinct row its kernel sums with all rows."""
    sums = [F.sum(F.get("k", F.lit(f))).alias(f"k{f}") for f in range(p)]
    return parts.where("v is not null").groupBy("v").agg(F.first("w").alias("w"), *sums).select("v", "w", F.array(*[f"k{f}" for f in range(p)]).alias("k"))


def _summed(arrays: DataFrame, column: str, size: int) -> np.ndarray:
    """Elementwise sums of arrays of `size` doubles."""
    out = np.zeros(size)
    for r in arrays.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # `size` rows
        out[r["at"]] = r["x"]
    return out


def kernel_row_sums(df: DataFrame, columns: Sequence[str], variances: Sequence[float], block: int = BLOCK) -> DataFrame:
    """(v, w, k): for each distinct row v of `columns`, held by w rows, the sums k of RBF kernels with all rows."""
    pairs = _block_pairs(_rows(df, columns, None, None, 0), block)
    return _row_sums(_kernel_sums(pairs, np.asarray(variances, np.float64)), len(columns))


def _gram(df: DataFrame, columns: Sequence[str], sigmas: Sequence[float | None], max_rows: int | None = None, order: str | None = None, seed: int = 42, block: int = BLOCK) -> np.ndarray | None:
    """HSIC of every pair of columns, as a matrix, with RBF kernels; None for less than two rows.

    A sigma of None is the square root of the median squared distance of pairs. Only sums leave the blocks.
    """
    p = len(columns)
    rows = _rows(df, columns, max_rows, order, seed).persist()  # read once a pass
    try:
        n = float(rows.agg(F.sum("w")).first()[0] or 0.0)
        if n < 2:
            return None
        s2 = np.array([s**2 if s else np.nan for s in sigmas], np.float64)
        values = rows.select(F.posexplode("v").alias("f", "x"), "w").groupBy("f", "x").agg(F.sum("w").alias("w")).persist()
        try:
            ends = {r["f"]: r for r in values.groupBy("f").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n")).collect()}
            finite = all(np.isfinite([r["a"], r["b"]]).all() for r in ends.values())
            if np.isnan(s2).any():
                median = _median_squares_sorted(values, p, n, block) if finite else _median_squares(_block_pairs(rows, block), p, n)
                s2 = np.where(np.isnan(s2), np.maximum(median, 1e-12), s2)
            if finite:
                series = [_Series(s2[f], ends[f]["a"], ends[f]["b"]) for f in range(p)]
                few = [f for f in range(p) if ends[f]["n"] <= TERMS and (series[f].a is None or series[f].size > ends[f]["n"])]
                given = values.where(F.col("f").isin(few)).select("f", "x").collect() if few else []  # TERMS a column
                for f in few:
                    series[f] = _Series(s2[f], ends[f]["a"], ends[f]["b"], np.array(sorted(r["x"] for r in given if r["f"] == f)))
                if all(x.a is not None for x in series) and sum(x.size for x in series) <= ALL_TERMS:
                    return _gram_of_series(rows, series, n)
        finally:
            values.unpersist()
        pairs = _block_pairs(rows, block)
        parts = _kernel_sums(pairs, s2).persist()
        try:
            cross = _summed(parts.where("v is null"), "k", p * p).reshape(p, p)

            def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    w, k = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
                    sums = np.concatenate([(k.T @ (k * w[:, None])).ravel(), w @ k])
                    yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["s"])

            sums = _summed(_row_sums(parts, p).select("w", "k").mapInArrow(products, "s array<double>"), "s", p * p + p)
        finally:
            parts.unpersist()
    finally:
        rows.unpersist()
    within, whole = sums[: p * p].reshape(p, p), sums[p * p :]
    return (cross - 2 / n * within + np.outer(whole, whole) / (n * n)) / ((n - 1) * (n - 1))


def rbf_hsic(df: DataFrame, x: str, y: str, sigma_x: float | None = None, sigma_y: float | None = None) -> DataFrame:
    """hsic with RBF kernels over all rows of df without nulls; null for less than two.

    A sigma of None is the square root of the median squared distance of pairs.
    """
    g = _gram(df, [x, y], [sigma_x, sigma_y])
    return df.sparkSession.createDataFrame([(None if g is None else float(g[0, 1]),)], "hsic double")


def relevance(df: DataFrame, columns: Sequence[str], y: str, top_k: int = 100, min_hsic: float = 0.0, sigma: float | None = None, max_rows: int | None = None, order: str | None = None, seed: int = 42, imputation: str = "median") -> list[tuple[str, float]]:
    """(feature, hsic) by falling dependence on y; constants have 0; min_hsic counts only if above 0."""
    clean = standardized(impute(df, [*columns, y], imputation), [*columns, y])
    g = _gram(clean, [*columns, y], [sigma] * (len(columns) + 1), max_rows, order, seed)
    values = np.zeros(len(columns)) if g is None else g[:-1, -1]
    ranked = sorted(zip(columns, values.tolist(), strict=True), key=lambda p: (-p[1], p[0]))
    return [(c, v) for c, v in ranked if not (min_hsic > 0 and v < min_hsic)][:top_k]


def nonnegative_lasso(a: np.ndarray, r: np.ndarray, lam: float, steps: int = 500, tol: float = 1e-6, start: np.ndarray | None = None, patience: float = np.inf, least: float = 1e-8) -> np.ndarray:
    """min b'Rb - a'b + lam * sum(b), b >= 0, by accelerated proximal steps; see HSICLasso for patience and least."""
    step = 1 / max(2 * float(np.linalg.eigvalsh(r)[-1]), 1e-12)
    b = np.zeros(len(a)) if start is None else start.copy()
    z, t, same = b.copy(), 1.0, 0
    for _ in range(steps):
        new = np.maximum(0.0, z - step * (2 * r @ z - a + lam))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - b)
        same = same + 1 if ((new > least) == (b > least)).all() else 0
        if np.abs(new - b).max(initial=0.0) < tol or same >= patience:
            return new
        b, t = new, t2
    return b


@dataclass
class HSICLasso:
    """Selects features that depend on y and little on one another. lam None: a path of penalties, until the number of
    features lies in `target`, else the penalty whose number is closest to its middle."""

    lam: float | None = 1e-3
    top_k: int = 100
    least: float = 1e-8
    target: tuple[int, int] = (30, 80)
    path: int = 14
    steps: int = 800
    patience: int = 20
    sigma: float | None = None
    max_rows: int | None = None
    order: str | None = None
    seed: int = 42
    imputation: str = "median"
    coefficients: dict[str, float] = field(default_factory=dict)
    selected: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: Sequence[str], y: str) -> HSICLasso:
        clean = standardized(impute(df, [*columns, y], self.imputation), [*columns, y])
        g = _gram(clean, [*columns, y], [self.sigma] * (len(columns) + 1), self.max_rows, self.order, self.seed)
        g = np.zeros((len(columns) + 1,) * 2) if g is None else g
        a, r = g[:-1, -1], g[:-1, :-1]
        if self.lam is not None:
            b = nonnegative_lasso(a, r, self.lam, self.steps)
        else:
            low, high = (min(x, len(columns)) for x in self.target)
            best, b, gap = None, np.zeros(len(a)), np.inf
            for lam in np.geomspace(10, 1e-3, self.path) * max(float(a.max(initial=0.0)), 1e-12):
                b = nonnegative_lasso(a, r, lam, self.steps, start=b, patience=self.patience, least=self.least)
                n = int((b > self.least).sum())
                if abs(n - (low + high) / 2) < gap:
                    best, gap = b, abs(n - (low + high) / 2)
                if low <= n <= high:
                    best = b
                    break
            b = best
        order = sorted(range(len(columns)), key=lambda k: (-b[k], columns[k]))
        self.coefficients = {columns[k]: float(b[k]) for k in order}
        self.selected = [columns[k] for k in order if b[k] > self.least][: self.top_k]
        return self

    def __call__(self, df: DataFrame, columns: Sequence[str], y: str, **overrides) -> dict:
        """Fit with temporary settings; returns features and coefficients."""
        if unknown := [k for k in overrides if not hasattr(self, k)]:
            raise TypeError(f"unknown settings: {unknown}")
        once = HSICLasso(**{k: overrides.get(k, getattr(self, k)) for k in self.__dataclass_fields__ if k not in ("coefficients", "selected")}).fit(df, columns, y)
        return {"selected": once.selected, "coefficients": once.coefficients}
