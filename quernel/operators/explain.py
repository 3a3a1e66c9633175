"""Shapley values of tree ensembles and additive models on rows.

For a tree, a row's Shapley values follow from its leaves alone: over the features on the path to a leaf, a feature in
the coalition passes its splits or not, and one outside passes with the share of training rows that did. The sum over
coalitions is a product of linear factors, so a leaf costs the square of its features, for all rows of a batch at once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.durable import shared_folder

Leaf = tuple[float, list[tuple[int, float, float, float]]]  # value; per feature: number, low, high, share of rows that pass


def _nodes(model: Any, spark) -> tuple[pd.DataFrame, dict[int, float]]:
    """All nodes of a saved tree model (treeID, id, ..), and the weight of each tree: as large as the model."""
    path = f"{shared_folder(spark)}/quernel/{spark.sparkContext.applicationId}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        weights = {int(r[0]): float(r[2]) for r in spark.read.parquet(f"{path}/treesMetadata").collect()}  # number, metadata, weight
        return data.select("treeID", "nodeData.*").toPandas(), weights
    return data.withColumn("treeID", F.lit(0)).toPandas(), {0: 1.0}


def leaves(model: Any, spark) -> list[Leaf]:
    """The leaves of all trees of a fitted model, with what their paths ask of each feature."""
    nodes, weights = _nodes(model, spark)
    kind = type(model).__name__
    forest, classes = kind.startswith("RandomForest"), "Classification" in kind and not kind.startswith("GBT")
    scale = 1.0 / max(1, len(weights)) if forest else 1.0
    out: list[Leaf] = []
    for tree, part in nodes.groupby("treeID"):
        by = {int(r.id): r for r in part.itertuples()}
        count = {i: float(sum(r.impurityStats)) if classes else float(r.impurityStats[0]) for i, r in by.items()}
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            i, path = todo.pop()
            r = by[i]
            if r.leftChild < 0:
                value = float(r.impurityStats[1]) / max(count[i], 1e-12) if classes else float(r.prediction)
                out.append((value * scale * (1.0 if forest else weights[int(tree)]), [(f, *x) for f, x in path.items()]))
                continue
            split = r.split
            f, cut = int(split["featureIndex"]), float(split["leftCategoriesOrThreshold"][0])
            low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
            for child, bounds in ((int(r.leftChild), (low, min(high, cut))), (int(r.rightChild), (max(low, cut), high))):
                todo.append((child, {**path, f: (*bounds, share * count[child] / max(count[i], 1e-12))}))
    return out


def shapley(found: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Shapley values, rows by features, of the ensemble with these leaves (low < x <= high passes)."""
    out = np.zeros(x.shape)
    for value, path in found:
        m = len(path)
        if not m:
            continue
        passes = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in path]
        weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
        for i, (f, _, _, share) in enumerate(path):
            poly = [np.ones(len(x))]  # of the others: coefficient k is the sum over coalitions of k features
            for j, (_, _, _, z) in enumerate(path):
                if j != i:
                    poly = [(poly[k] * z if k < len(poly) else 0.0) + (poly[k - 1] * passes[j] if k else 0.0) for k in range(len(poly) + 1)]
            out[:, f] += value * (passes[i] - share) * sum(w * p for w, p in zip(weight, poly, strict=True))
    return out


def explain(model: Any, df: DataFrame, features: Sequence[str], most: int | None = 2000, seed: int = 42, count: str | None = None) -> DataFrame:
    """df's rows (a sample of `most`, the ones with the least hashes; all if None) with shap_<feature>, and their column `count`.

    Additive models give their contributions, less the mean that is their bias; tree models their Shapley values.
    """
    kept = [count] if count else []
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], *kept)
    if most is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), *features)).limit(most)
    if hasattr(model, "contributions"):
        return model.contributions(rows, "shap_").select(*features, *kept, *[f"shap_{c}" for c in features])
    found = df.sparkSession.sparkContext.broadcast(leaves(model, df.sparkSession))  # as large as the model

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            values = shapley(found.value, p[list(features)].to_numpy(float))
            yield pd.concat([p, pd.DataFrame(values, columns=[f"shap_{c}" for c in features], index=p.index)], axis=1)

    schema = ", ".join([f"`{c}` double" for c in features] + [f"`{c}` bigint" for c in kept] + [f"`shap_{c}` double" for c in features])
    return rows.mapInPandas(work, schema)


def importance(model: Any, df: DataFrame, features: Sequence[str], most: int | None = 2000, count: str | None = None) -> DataFrame:
    """feature, importance: the mean absolute Shapley value or contribution on rows, largest first.

    most: None takes all rows, equal ones together; count: a column that says how many rows a row stands for then.
    """
    from quernel.operators.aggregates import mean_abs

    if most is None:
        equal = df.groupBy(*[F.col(c).cast("double").alias(c) for c in features]).agg(F.sum(count or F.lit(1)).alias("_n"))
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(f"shap_{c}").alias("value")) for c in features])
        values = explain(model, equal, features, None, count="_n").select("_n", F.explode(cells).alias("_c"))
        weighed = F.sum(F.col("_n") * F.col("_c.value")) / F.sum("_n")
        return values.groupBy("_c.feature").agg(weighed.alias("importance")).orderBy(F.desc("importance"), "feature")
    rows = explain(model, df, features, most).select(*[F.col(f"shap_{c}").alias(c) for c in features])
    return mean_abs(rows, list(features)).orderBy(F.desc("importance"), "feature")

