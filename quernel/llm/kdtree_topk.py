"""Exact top-k inner products by KD-trees, one per shard of the vectors.

Every shard gets a KD-tree: nodes are cut at the median of their widest component and carry tight bounding boxes. For
a query, a box bounds the inner product of all its vectors from above. Nodes are visited best first, and a query is done
with a shard when its best open box is below its kth score. The kth score is propagated: every query first searches its
own shard, and takes what it finds there as its threshold to all others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import cut, named_ids, numbered_ids

#: Scores stay exact in double arithmetic below this.
EXACT = 2.0**53


class KDTree:
    """Median splits with tight boxes over integer vectors; leaves are ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.range, self.kids = [], [], [], []
        self.x, self.ids = x, ids
        self._grow(0, len(x), leaf)
        self.x, self.ids = x[self.order], ids[self.order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _grow(self, a: int, b: int, leaf: int) -> int:
        rows = self.order[a:b]
        part = self.x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        me = len(self.range)
        self.lo.append(lo)
        self.hi.append(hi)
        self.range.append((a, b))
        self.kids.append(None)
        if b - a > leaf and (hi > lo).any():  # never for vectors without components
            wide = int(np.argmax(hi.astype(np.float64) - lo))
            mid = (b - a) // 2
            self.order[a:b] = rows[np.argpartition(part[:, wide], mid)]
            self.kids[me] = (self._grow(a, a + mid, leaf), self._grow(a + mid, b, leaf))
        return me

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node: no vector in the node's box has a larger inner product."""
        return _products(np.maximum(q, 0), self.hi) + _products(np.minimum(q, 0), self.lo)

    def search(self, qids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query the up to k best (score, id) with score >= kth, without its own id, ties to the smaller id."""
        bound = self.bounds(q)
        out = []
        for i in range(len(q)):
            best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst on top
            least = kth[i]
            open_ = [(-bound[i, 0], 0)] if len(self.x) else []
            while open_ and -open_[0][0] >= least:
                node = heapq.heappop(open_)[1]
                if self.kids[node]:
                    for child in self.kids[node]:
                        if bound[i, child] >= least:
                            heapq.heappush(open_, (-bound[i, child], child))
                    continue
                a, b = self.range[node]
                score = _products(q[i : i + 1], self.x[a:b])[0]
                ids = self.ids[a:b]
                good = np.flatnonzero((score >= least) & (ids != qids[i]))
                if len(good) > k:
                    good = good[np.lexsort((ids[good], -score[good]))[:k]]
                for j in good.tolist():
                    entry = (int(score[j]), -int(ids[j]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    least = max(least, best[0][0])
            out.append([(s, -n) for s, n in sorted(best, reverse=True)])
        return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by the floating-point unit where that is exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _matrix(column) -> np.ndarray:
    return np.array(list(column), np.int64)


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, shard_rows: int = 8192, block: int = 16384, leaf: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for every row where `is_query` holds, its k best rows by integer inner product.

    Components become floor(scale * x). A row is not its own candidate: candidates are all rows with another id.
    shard_rows: rows of a KD-tree. block: queries searched by one task in one shard; more go to other tasks.
    Defined results: vectors that are null or hold null or non-finite components take no part, neither do rows with a
    null id; an empty vector scores 0; vectors of other lengths than the query's are no candidates; a repeated row is
    one candidate more with the same id, and a repeated query is answered once; rows that share an id but not the vector
    are queries of their own, each with ranks from 1, and no candidates of one another; ids that are not integers are
    ordered as Spark sorts them; components are exact as long as scores fit a long; an empty table gives no rows.
    """
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    rows, places = numbered_ids(rows, "id", "kd-ids")
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(fine)
    ints = F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = cut(rows.select("id", ints.alias("vec"), F.size("vec").alias("dim"), "asks"), "kd-rows")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).collect()}
    shards = {d: max(1, -(-n // shard_rows)) for d, (n, _) in sizes.items()}
    blocks = {d: max(1, -(-(q or 0) // block)) for d, (_, q) in sizes.items()}
    spark = df.sparkSession
    plan = spark.createDataFrame([(d, shards[d], blocks[d]) for d in sorted(sizes)], "dim int, shards int, blocks int")
    rows = rows.join(F.broadcast(plan), "dim")  # one row per vector length
    shard = F.pmod(F.xxhash64("id"), "shards").cast("int")
    group = F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")
    queries = rows.where("asks").dropDuplicates(["id", "vec"]).select("dim", "shards", group.alias("group"), shard.alias("own"), F.col("id").alias("qid"), "vec")
    queries = cut(queries.withColumn("qkey", F.monotonically_increasing_id()), "kd-queries")

    def answer(key, tree_rows, asked):
        if not len(tree_rows) or not len(asked):
            return pd.DataFrame({"qkey": [], "qid": [], "vec_id": [], "score": []}).astype("int64")
        tree = KDTree(tree_rows["id"].to_numpy(), _matrix(tree_rows["vec"]), leaf)
        qkeys, qids, q = asked["qkey"].to_numpy(), asked["qid"].to_numpy(), _matrix(asked["vec"])
        kth = asked["kth"].to_numpy()
        found = []
        for at in range(0, len(q), 1024):
            part = slice(at, at + 1024)
            for c, i, best in zip(qkeys[part].tolist(), qids[part].tolist(), tree.search(qids[part], q[part], kth[part], k), strict=True):
                found += [(c, i, n, s) for s, n in best]
        return pd.DataFrame(found, columns=["qkey", "qid", "vec_id", "score"]).astype("int64")

    def search(asked: DataFrame, over: DataFrame) -> DataFrame:
        key = ["dim", "shard", "group"]
        return over.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(answer, "qkey bigint, qid bigint, vec_id bigint, score bigint")

    trees = rows.select("dim", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("group"), "id", "vec")
    worst = F.lit(-(2**63)).alias("kth")
    home = cut(search(queries.select("dim", F.col("own").alias("shard"), "group", "qkey", "qid", "vec", worst), trees), "kd-home")
    kth = home.groupBy("qkey").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    other = queries.join(kth, "qkey", "left").select("dim", "own", "group", "qkey", "qid", "vec", F.coalesce("kth", F.lit(-(2**63))).alias("kth"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    other = other.where("shard <> own").select("dim", "shard", "group", "qkey", "qid", "vec", "kth")
    found = home.unionByName(search(other, trees))
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = found.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return named_ids(found, places, "query_id", "vec_id")
