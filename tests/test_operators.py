import json
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quernel import config
from quernel.functions import scalars as S
from quernel.functions.ordered import average_ranks, exact_quantiles, positions
from quernel.operators import additive as G
from quernel.operators import aggregates as A
from quernel.operators import drift as D
from quernel.operators import encoders as E
from quernel.operators import explain as EX
from quernel.operators import forest as FO
from quernel.operators import hsic as H
from quernel.operators import icc as I
from quernel.operators import metrics as M
from quernel.operators import models as X
from quernel.operators import preprocess as P
from quernel.operators import probes as R
from quernel.operators import splits as W
from quernel.operators.forest import fit as fit_forest
from quernel.sources import readers


@pytest.fixture(scope="module")
def frame(spark):
    return readers.synthetic(spark, 600, 12).data.cache()


def test_synthetic_is_reproducible(spark):
    a, b = (S.fingerprint(readers.synthetic(spark, 200, 5).data).first() for _ in range(2))
    assert a == b
    assert readers.synthetic(spark, 200, 5).factors.count() == 2


def test_chronological_split(frame):
    s = W.chronological_split(frame, ["timestamp"], (0.5, 0.3, 0.2), group="machine_id")
    n = [x.count() for x in (s.train, s.valid, s.test)]
    assert sum(n) == 600 and n[0] > n[1] > 0
    assert s.coverage.columns == ["group", "split", "count", "share"]


def test_drift_of_halves_and_of_itself(frame):
    a, b = positions(frame, ["timestamp"], "k").where("k <= 300"), positions(frame, ["timestamp"], "k").where("k > 300")
    t = D.DriftAnalyzer({"psi": 0.1, "ks": 0.1}).table(a, b, ["runtime_hours", "temperature", "operator"]).collect()
    assert {r["feature"] for r in t} == {"runtime_hours", "temperature", "operator"}
    same = D.DriftAnalyzer().table(a, a, ["runtime_hours", "operator"]).collect()
    assert all(abs(r["psi"]) < 1e-9 and r["risk_level"] == "low" for r in same)
    assert D.DriftAnalyzer().table(a, b, []).count() == 0


def test_two_sample_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, 150).astype(float), rng.integers(3, 25, 90).astype(float)
    ref, cmp = (spark.createDataFrame([(float(v),) for v in z], "v double") for z in (x, y))
    got = D.two_sample(ref, cmp, ["v"]).first()
    grid = np.unique(np.concatenate([x, y]))
    fx, fy = (np.searchsorted(np.sort(z), grid, "right") / len(z) for z in (x, y))
    assert got["ks"] == pytest.approx(np.abs(fx - fy).max())
    assert got["wasserstein"] == pytest.approx(float((np.abs(fx - fy)[:-1] * np.diff(grid)).sum()))
    both = np.concatenate([x, y])
    rank = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
    n, m = len(x), len(y)
    u = n * ((np.sort(rank[:n]) - np.arange(1, n + 1)) ** 2).sum() + m * ((np.sort(rank[n:]) - np.arange(1, m + 1)) ** 2).sum()
    assert got["cvm"] == pytest.approx(u / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)))


def test_icc(frame):
    out = I.evaluate_icc(frame.withColumn("pred", F.col("target_main") * 0.9), "machine_id", "target_main", "pred", "timestamp")
    assert [r["Type"] for r in out.table.collect()] == ["ICC1", "ICC2", "ICC3"]


def test_tree_scores(frame):
    s = W.chronological_split(frame, ["timestamp"], (0.5, 0.3, 0.2))
    table, trees = X.tree_scores(s.train, s.valid, ["temperature", "vibration"], "target_main", 2, 10)
    rows = table.collect()
    assert rows[0]["feature"] == "temperature" and rows[0]["delta_mse"] > 0 and rows[0]["split_gain"] <= 0
    assert set(trees) == {"temperature", "vibration"}


@pytest.fixture(scope="module")
def cats(spark):
    rows = [("a", 1.0, True), ("a", 0.0, True), ("b", 1.0, False), (None, 0.0, None), ("c", 1.0, True), (None, 1.0, False)]
    return spark.createDataFrame(rows, "city string, y double, flag boolean")


@pytest.mark.parametrize("name", sorted(E.REGISTRY))
def test_encoders_keep_rows_and_take_unseen_values(name, spark, cats):
    enc = E.CategoricalEncoder(name, random_state=1).fit(cats, "y", ["city"])
    new = spark.createDataFrame([("zzz", 1.0, True), (None, 0.0, False), ("a", 0.0, True)], cats.schema)
    out = enc.transform(new)
    assert out.count() == 3 and out.columns == enc.get_feature_names()
    assert all(v is not None and not math.isnan(v) for r in out.collect() for v in r)


def test_encoder_save_and_load(spark, cats, tmp_path):
    enc = E.CategoricalEncoder({"city": "woe", "flag": "multi_hash"}).fit(cats, "y", ["city", "flag"])
    enc.save(str(tmp_path / "e"))
    back = E.CategoricalEncoder.load(str(tmp_path / "e"))
    assert sorted(map(tuple, enc.transform(cats).collect())) == sorted(map(tuple, back.transform(cats).collect()))


def test_encoder_errors(spark, cats):
    with pytest.raises(E.EncoderError):
        E.CategoricalEncoder("target").fit(cats)
    with pytest.raises(E.EncoderError):
        E.CategoricalEncoder("nothing").fit(cats, "y")
    with pytest.raises(E.EncoderError):
        E.CategoricalEncoder({"city": "count"}).fit(cats, "y", ["city", "flag"])
    with pytest.raises(E.EncoderError):
        E.CategoricalEncoder("count").fit(cats.limit(0))
    with pytest.raises(E.EncoderError):
        E.CategoricalEncoder("woe").fit(cats.withColumn("y", F.monotonically_increasing_id().cast("double")), "y", ["city"])
    with pytest.raises(E.EncoderError):
        E.CategoricalEncoder("count").fit(cats, "y", ["city"]).transform(cats.drop("city"))
    with pytest.raises(E.EncoderError):
        E.CategoricalEncoder(auto_survey=False)


def test_encoder_plug_in(spark, cats):
    @E.register_encoder("length")
    def length(rows, column):
        m = rows.select("category").distinct().select("category", F.length("category").cast("double").alias("v0")).where("v0 is not null")
        return E.Fitted(column, [f"{column}__length"], m, [0.0])

    try:
        assert E.CategoricalEncoder("length").fit(cats, "y", ["city"]).transform(cats).agg(F.sum("city__length")).first()[0] == 4
    finally:
        del E.REGISTRY["length"]


def test_auto_strategy_and_missing_values(spark, cats):
    enc = E.CategoricalEncoder().fit(cats, "y")
    assert {d["column"] for d in enc.decisions} == {"city", "flag"}


def test_positions_of_texts(spark):
    texts = [f"Customer#{k * 7919 % 1000:09d}" for k in range(1000)] + ["Customer#", "é", "", "Customer", "zz", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["k"] for r in positions(df, ["t"], "k").collect()}
    assert got == {t: k + 1 for k, t in enumerate(sorted(texts, key=lambda t: t.encode()))}
    assert positions(df.limit(0), ["t"], "k").count() == 0
    same = positions(df.where("t like 'Customer#%'"), ["t"], "k")
    assert sorted(r["k"] for r in same.collect()) == list(range(1, 1002))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in np.round(rng.exponential(10, 301), 1)] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "v", at, ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for h, v in rows if h == g and v is not None], at))
    assert np.allclose(exact_quantiles(df, "v", at).first()["q"], np.quantile([v for _, v in rows if v is not None], at))
    assert exact_quantiles(df.limit(0), "v", at).first()["q"] is None
    assert exact_quantiles(df.limit(0), "v", at, ["g"]).count() == 0


def test_null_classes_keep_their_rows(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    train, test = W.stratified_split(df, "y")
    assert train.count() + test.count() == 100 and test.where("y is null").count() == 7
    assert W.stratified_folds(df, "y").count() == 100


def test_undefined_ratios_are_null(spark):
    df = spark.range(6).select(F.lit(1).alias("one"), F.col("id").cast("double").alias("x"), F.lit(2.0).alias("c"))
    assert M.auc(df, "one", "x").first()[0] is None
    assert {r["fpr"] for r in M.roc_points(df, "one", "x").collect()} == {None}
    assert M.spearman(df, "x", "c").first()[0] is None
    assert M.evaluate(df, "c", "x", ("r2",)).first()[0] == 0 and M.evaluate(df, "c", "c", ("r2", "medae")).first()[:] == (1.0, 0.0)
    assert {r["ICC"] for r in I.icc_two_way(df, "one", "x", "c").collect()} == {None}
    assert {(r["n"], r["density"]) for r in A.histogram(df.limit(0), "x", [0, 1, 2], True).collect()} == {(0, None)}
    mixed = df.withColumn("y", F.when(F.col("x") < 4, (F.col("x") > 1).cast("int")))
    assert M.auc(mixed, "y", "x").first()[0] == 1


def test_drift_of_disjoint_categories(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "c string") for t in ("aabc", "xyz"))
    row = D.categorical(a, b, ["c"]).first()
    assert np.isclose(row["tv"], 0.5) and row["js"] is None
    assert D.categorical(a, b.limit(0), ["c"]).count() == 0


def test_folds_are_disjoint_and_even(frame):
    for rows in (W.kfold_labels(frame, ["timestamp"], 7), W.shuffled_folds(frame, 7), W.stratified_folds(frame, "operator", 7)):
        n = [r["count"] for r in rows.groupBy("fold").count().collect()]
        assert len(n) == 7 and sum(n) == 600
    groups = W.group_folds(frame, "machine_id", 3).select("machine_id", "fold").distinct()
    assert groups.count() == groups.select("machine_id").distinct().count()
    train, test = W.stratified_split(frame, "operator")
    assert train.count() + test.count() == 600 and abs(test.count() - 120) <= 5


def test_positions_and_ranks(spark):
    rng = np.random.default_rng(0)
    v = [int(x) for x in rng.integers(0, 30, 200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i long, v long")
    got = {r["i"]: r["k"] for r in positions(df, ["v", "i"], "k").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda p: p[1])] == sorted(range(200), key=lambda i: (v[i], i))
    ranks = {r["i"]: r["r"] for r in average_ranks(df, "v", "r").collect()}
    assert ranks == {i: sum(y < x for y in v) + (v.count(x) + 1) / 2 for i, x in enumerate(v)}


def test_vif_drops_collinear(spark):
    rng = np.random.default_rng(3)
    a, b, e = rng.normal(size=(3, 300))
    df = spark.createDataFrame([(float(x), float(y), float(x + 1e-3 * z)) for x, y, z in zip(a, b, e, strict=True)], "a double, b double, c double")
    kept, dropped = P.vif_filter(df, ["a", "b", "c"])
    assert len(kept) == 2 and len(dropped) == 1 and "b" in kept


def test_preprocessor(frame):
    rows = frame.drop("timestamp", "target_secondary").withColumn("gone", F.lit(None).cast("double")).withColumn("id", F.monotonically_increasing_id())
    p = P.Preprocessor().fit(rows, "target_main", ["id"])
    out = p.transform(rows)
    assert p.dropped.count("gone") == 1 and "operator_te" in out.columns and out.count() == 600
    assert out.select([F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first().asDict() == dict.fromkeys(out.columns, 0)


def test_scalers_invert(frame):
    for kind in ("standard", "robust", "identity"):
        s = P.Scaler(kind).fit(frame, ["temperature"])
        gap = s.inverse(s.transform(frame)).agg(F.sum("temperature")).first()[0] - frame.agg(F.sum("temperature")).first()[0]
        assert abs(gap) < 1e-6


@pytest.mark.parametrize("head", ["none", "affine", "residual"])
def test_additive_contributions_sum_to_prediction(frame, head, tmp_path):
    m = G.HierarchicalAdditiveRegressor(["temperature", "pressure", "runtime_hours"], "target_main", "operator", head).fit(frame)
    out = m.predict_and_contributions(frame)
    total = sum((F.col(f"contrib_{f}") for f in m.features), F.col("bias"))
    assert out.where(F.abs(total - F.col("prediction")) > 1e-9).count() == 0
    assert M.evaluate(out, "target_main", "prediction", ("r2",)).first()[0] > 0.9
    m.save(str(tmp_path / head))
    again = G.HierarchicalAdditiveRegressor.load(str(tmp_path / head)).predict(frame)
    assert abs(again.agg(F.sum("prediction")).first()[0] - out.agg(F.sum("prediction")).first()[0]) < 1e-6
    unknown = m.predict_and_contributions(frame.withColumn("operator", F.lit("new")))
    assert unknown.where(F.abs(F.col("contrib_pressure") - F.col("base_pressure")) > 1e-12).count() == 0


def test_additive_bins_classify(frame):
    df = frame.withColumn("hot", (F.col("target_main") > 15).cast("int"))
    m = X.AdditiveBins("hot", ["temperature", "pressure"], 8, binary=True).fit(df)
    assert M.auc(m.contributions(df), "hot", "prediction").first()[0] > 0.9


def test_probe_selector_drops_noise(frame):
    s = X.ProbeSelector(probes=3, rounds=1, threshold="max").fit(frame, "target_main", ["temperature", "vibration"])
    assert "temperature" in s.kept and s.trace.count() == 2


def test_hsic(spark, frame):
    rows = [r for r in H.relevance(frame, ["temperature", "vibration"], "target_main", max_rows=200, order="timestamp")]
    assert rows[0][0] == "temperature"
    m = H.HSICLasso(max_rows=200, order="timestamp").fit(frame, ["temperature", "vibration"], "target_main")
    assert m.selected[0] == "temperature"
    assert set(H.HSICLasso(max_rows=200, order="timestamp")(frame, ["temperature", "vibration"], "target_main", lam=1e9)["selected"]) == set()


def test_hsic_in_blocks_against_whole_matrices(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((90, 3)), 1)
    x[:, 2] = x[:, 0] ** 2
    x = np.concatenate([x, x[:25], x[:5]])  # repeated rows
    df = spark.createDataFrame([(*map(float, r),) for r in x] + [(None, 1.0, 1.0)], "a double, b double, c double")
    n = len(x)
    h = np.eye(n) - 1 / n
    kernels = []
    for k in range(3):
        d2 = (x[:, k, None] - x[None, :, k]) ** 2
        kernels.append(h @ np.exp(-d2 / (2 * np.median(d2[np.triu_indices(n, 1)]))) @ h)
    want = np.array([[np.trace(p @ q) / (n - 1) ** 2 for q in kernels] for p in kernels])
    for block in (16, 4096):
        got = H._gram(df, ["a", "b", "c"], [None] * 3, block=block)
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert np.isclose(H.rbf_hsic(df, "a", "c").first()[0], want[0, 2])
    assert H.rbf_hsic(df.limit(0), "a", "c").first()[0] is None
    even = np.median(np.concatenate([np.subtract.outer(v, v)[np.triu_indices(4, 1)] ** 2 for v in [np.array([0.0, 1.0, 4.0, 9.0])]]))
    four = H._rows(spark.createDataFrame([(0.0,), (1.0,), (4.0,), (9.0,)], "a double"), ["a"], None, None, 0)
    assert H._median_squares(H._block_pairs(four, 2), 1, 4.0)[0] == even
    constant = spark.createDataFrame([(1.0, float(k)) for k in range(5)], "a double, b double")
    assert H.relevance(constant, ["a"], "b") == [("a", 0.0)]


def test_rules_and_logistic(frame):
    df = frame.withColumn("hot", (F.col("temperature") > 21).cast("int"))
    assert X.rules(df, ["temperature", "pressure"], "hot", trees=3, depth=2).count() > 0
    assert X.logistic_pipeline(df, ["temperature"], "hot").stages[-1].coefficients[0] > 0


def test_cross_validation(frame):
    out = X.time_series_cv(frame, ["temperature", "pressure"], "target_main", ["timestamp"], "tree", k=2)
    assert out.predictions.count() == 600 and out.predictions.where("oof is null").count() == 200
    assert out.stability.first()[0] == 1.0


def test_cross_validation_of_the_additive_model(frame):
    out = X.time_series_cv(frame, ["temperature", "pressure"], "target_main", ["timestamp"], "ebm", k=2, repeats=2)
    assert out.metrics.where("metric = 'r2' and fold = 0").first()["value"] > 0.5
    df = frame.withColumn("hot", (F.col("target_main") > 15).cast("int"))
    scores, oof, models = X.classification_cv(df, ["temperature", "pressure"], "hot", "ebm", k=3)
    assert scores.first()["auc"] > 0.9 and oof.count() == 600 and len(models) == 3


def brute_shapley(found, row):
    """Over all coalitions: features outside one pass a split with the share of rows that did."""
    from itertools import combinations
    from math import factorial

    p = len(row)

    def value(known):
        total = 0.0
        for v, path in found:
            for f, low, high, share in path:
                v *= (low < row[f] <= high) if f in known else share
            total += v
        return total

    out = [0.0] * p
    for i in range(p):
        for k in range(p):
            for c in combinations([j for j in range(p) if j != i], k):
                out[i] += factorial(k) * factorial(p - 1 - k) / factorial(p) * (value({*c, i}) - value(set(c)))
    return out


def test_shapley_values_against_all_coalitions(spark, frame):
    features = ["temperature", "pressure", "runtime_hours", "vibration"]
    hot = frame.withColumn("hot", (F.col("target_main") > 15).cast("double"))
    kinds = [(X.REGRESSORS, "tree", "target_main", {"maxDepth": 4}), (X.REGRESSORS, "lightgbm", "target_main", {"maxIter": 5, "maxDepth": 3}), (X.CLASSIFIERS, "rf", "hot", {"numTrees": 6, "maxDepth": 4})]
    for table, kind, target, params in kinds:
        model = X._fit(table, kind, X.assembled(hot, features), target, params)
        found = EX.leaves(model, spark)
        rows = EX.explain(model, hot, features, 25)
        scored = model.transform(X.assembled(rows, features))
        shown = F.col("prediction") if target != "hot" else vector_to_array("probability")[1]
        got = scored.select(*features, *[f"shap_{c}" for c in features], shown.alias("shown")).collect()
        base = {round(r["shown"] - sum(r[f"shap_{c}"] for c in features), 9) for r in got}
        assert len(got) == 25 and max(base) - min(base) < 1e-6
        for r in got[:5]:
            assert np.allclose([r[f"shap_{c}"] for c in features], brute_shapley(found, [r[c] for c in features]))


def test_shuffled_columns_keep_values(frame):
    out = X.shuffled_columns(frame, ["temperature", "pressure"], "target_main", 3, block=100).toPandas()
    assert len(out) == 600 * (1 + 2 * 3)
    base = out[out.feature.isna()]
    for c in ("temperature", "pressure"):
        for i in range(3):
            part = out[(out.feature == c) & (out.repeat == i)]
            assert np.allclose(np.sort(part[c]), np.sort(base[c]))
            other = {"temperature": "pressure", "pressure": "temperature"}[c]
            both = part.merge(base, on=["target_main", other])
            assert len(both) == 600 and (both[f"{c}_x"] != both[f"{c}_y"]).mean() > 0.95


def test_boosting_stops_when_rounds_do_not_help(frame):
    model = X._fit(X.REGRESSORS, "lightgbm", X.assembled(frame, ["vibration"]), "target_main", {})
    assert model.getNumTrees < 50


def test_losses(frame):
    m = G.HierarchicalAdditiveRegressor(["temperature", "pressure"], "target_main", "operator", "residual").fit(frame)
    got = {r["term"]: r["value"] for r in m.losses(frame, {"centre": 2.0}).collect()}
    rows = m.predict_and_contributions(frame).toPandas()
    added = np.column_stack([rows[f"contrib_{f}"] - rows[f"base_{f}"] for f in m.features])
    assert got["mse"] == pytest.approx(((rows.target_main - rows.prediction) ** 2).mean())
    assert got["contribution_l1"] == pytest.approx(np.abs(added).mean()) and got["contribution_l2"] == pytest.approx((added**2).mean())
    means = rows.assign(a=added[:, 0], b=added[:, 1]).groupby("operator")[["a", "b"]].mean().to_numpy()
    assert got["centre"] == pytest.approx((means**2).mean()) and got["total"] == pytest.approx(got["mse"] + 2 * got["centre"])
    with pytest.raises(ValueError):
        m.losses(frame, {"nothing": 1.0})


def test_lasso_solution():
    a, r = np.array([1.0, 0.5]), np.array([[2.0, 0.0], [0.0, 1.0]])
    assert np.allclose(H.nonnegative_lasso(a, r, 0.2), [0.2, 0.15], atol=1e-5)  # (a - lam) / (2 r); steps end below 1e-6
    early = H.nonnegative_lasso(a, r, 0.2, patience=1)
    assert (early > 0).all()


def test_datasets_and_charts(spark, frame, tmp_path):
    frame.select("operator", "temperature").toPandas().to_csv(tmp_path / "machines.csv", index=False)
    train, test = readers.dataset_split(spark, "machines", str(tmp_path), "operator", 0.25)
    assert train.count() + test.count() == 600 and train.groupBy("operator").count().count() == 5
    with pytest.raises(ValueError):
        readers.named_dataset(spark, "nothing", str(tmp_path))
    R.save_chart(R.line_table(frame, "timestamp", "temperature"), "T <1>", str(tmp_path / "deep" / "t.html"), "x", "y")
    page = (tmp_path / "deep" / "t.html").read_text()
    assert "<polyline" in page and "T &lt;1&gt;" in page
    bars = R.to_svg(spark.createDataFrame([("a", 1.0), ("b", -1.0)], "label string, value double"), "label", "value", "bar")
    assert bars.count("<rect") == 2 and R.to_svg(frame, "temperature", "pressure", "scatter").count("<circle") == 600
    assert R.scatter_table(frame, "temperature", "pressure", 50).count() == 50
    assert R.violin_table(frame, "temperature", "operator").agg(F.sum("n")).first()[0] == 600


def test_wide_encoders_make_no_square_table(spark):
    df = spark.createDataFrame([(f"c{k:05d}",) for k in range(300)], "c string")
    out = E.CategoricalEncoder("onehot").fit(df, None, ["c"])
    assert out.fitted[0].mapping.columns == ["category", "idx"]
    assert out.transform(df).agg(F.sum("c__c00007")).first()[0] == 1.0
    with pytest.raises(E.EncoderError):
        E.CategoricalEncoder("helmert").fit(spark.range(E.MOST_COLUMNS + 1).select(F.col("id").cast("string").alias("c")), None, ["c"])


def test_positions_where_one_prefix_covers_all(spark):
    df = spark.createDataFrame([(f"https://example.org/{k * 37 % 1000:04d}", k % 7) for k in range(1000)] + [("zz", 1)], "t string, g int")
    got = positions(df, ["t"], "k")
    assert [r["k"] for r in got.orderBy("t").collect()] == list(range(1, 1002))
    by = positions(df, ["t"], "k", ["g"]).groupBy("g").agg(F.max("k").alias("a"), F.countDistinct("k").alias("b"), F.count("*").alias("c")).collect()
    assert all(r["a"] == r["b"] == r["c"] for r in by)


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    readers.write_feather(df, str(tmp_path / "f"), "overwrite")
    assert sorted(map(tuple, readers.read_feather(spark, str(tmp_path / "f")).collect())) == [(1, "x"), (2, None)]
    df.toPandas().to_csv(tmp_path / "c.csv", index=False)
    assert readers.from_path(spark, str(tmp_path / "c.csv")).count() == 2
    with pytest.raises(ValueError):
        readers.from_path(spark, "x.pkl")
    with pytest.raises(ValueError):
        readers.from_path(spark, "x.unknown")
    assert readers.from_bytes(spark, b"a\n1\n", "upload", ".csv").count() == 1
    assert [n.rsplit("/", 1)[1] for n in readers.list_files(spark, str(tmp_path))] == ["c.csv"]


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("data: {path: x, seed: 1}\nmodel: {kind: logistic}\n")
    (tmp_path / "b.yaml").write_text("data: {seed: 2}\n")
    got = config.typed(config.BaselineSettings, config.load(tmp_path / "a.yaml", tmp_path / "b.yaml", overrides={"model": {"impute": "median"}}))
    assert got.data.path == "x" and got.data.seed == 2 and got.model.impute == "median"
    with pytest.raises(ValueError):
        config.typed(config.DataSettings, {"unknown": 1})


def test_probes_and_charts(frame):
    assert R.available() == sorted(R.PROBES) and len(R.PROBES) == 6
    with pytest.raises(KeyError):
        R.run("nothing")
    assert A.time_buckets(frame, "timestamp", "target_main", 7).agg(F.sum("n")).first()[0] == 600
    assert "<table>" in R.to_html(R.box_table(frame, "temperature", "operator"), "Boxes")
    assert R.histogram_table(frame, "temperature", 10).agg(F.sum("n")).first()[0] == 600


def test_metrics_registry(frame):
    M.METRICS["worst"] = lambda y, p: F.max(F.abs(y - p))
    try:
        assert M.evaluate(frame, "target_main", "target_secondary", ("worst",)).first()[0] > 0
    finally:
        del M.METRICS["worst"]
    with pytest.raises(KeyError):
        M.evaluate(frame, "target_main", "target_secondary", ("nothing",))


def test_streams(spark, cats, tmp_path):
    from quernel.streaming.transforms import encoded_stream

    cats.write.parquet(str(tmp_path / "in"))
    enc = E.CategoricalEncoder("count").fit(cats, "y", ["city"])
    q = encoded_stream(spark.readStream.schema(cats.schema).parquet(str(tmp_path / "in")), enc, ["y"]).writeStream.format("memory").queryName("encoded").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("encoded").count() == cats.count()


def test_kernel_dependence_takes_no_pairs_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 401
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 7, n) / 3, np.where(rng.random(n) < 0.7, 0, rng.random(n)), rng.exponential(size=n) ** 2])
    x[100:160] = x[:60]
    squares = [(c[:, None] - c) ** 2 for c in x.T]
    kernels = [np.exp(-d / (2 * max(np.median(d[np.triu_indices(n, 1)]), 1e-12))) for d in squares]
    centre = np.eye(n) - 1 / n
    want = np.array([[np.sum((centre @ k @ centre) * m) / (n - 1) ** 2 for m in kernels] for k in kernels])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")

    def none(*args):
        raise AssertionError("pairs of all rows")

    with monkeypatch.context() as m:
        m.setattr(H, "_block_pairs", none)
        assert np.allclose(H._gram(df, list("abcd"), [None] * 4), want, rtol=1e-9, atol=0)
        m.setattr(H, "_FEW", 0)  # bounds meet bit by bit, in many blocks
        assert np.allclose(H._gram(df, list("abcd"), [None] * 4, block=64), want, rtol=1e-9, atol=0)
    monkeypatch.setattr(H, "ALL_TERMS", 0)  # too wide for series: pair by pair
    assert np.allclose(H._gram(df, list("abcd"), [None] * 4), want, rtol=1e-9, atol=0)


def test_boosters_get_equal_rows_once(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    df = spark.range(4000).selectExpr("cast(id % 5 as double) as a", "cast(id % 3 as double) as b", "cast(id % 5 + 2 * (id % 3) as double) as y")
    fit, seen = GBTRegressor.fit, []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows, *a: (seen.append((rows.count(), rows.agg(F.sum("_weight")).first()[0])), fit(self, rows, *a))[1])
    model = X._fit(X.REGRESSORS, "gbt", X.assembled(df, ["a", "b"]), "y", {"maxIter": 3, "maxDepth": 2, "stepSize": 0.5})
    assert seen == [(15, 4000.0)] and set(X.gain_importance(model, ["a", "b"])) == {"a", "b"}


def test_search_shares_passes_between_trials(spark, monkeypatch):
    df = spark.range(3000).selectExpr("cast(id % 7 as double) as a", "cast(id % 4 as double) as b", "cast(id % 7 + id % 4 + pmod(hash(id), 100) / 100 as double) as y", "id")
    space, seen, fit = {"knots": [2], "ridge": [0.1, 1.0], "scaler": ["standard", "robust"]}, [], G.Scaler.fit
    monkeypatch.setattr(G.Scaler, "fit", lambda self, *a: (seen.append(self), fit(self, *a))[1])
    model, trials = G.search(df, df, space, trials=4, halving=0, features=["a", "b"], target="y")
    rows = trials.collect()
    assert len(rows) == 4 and len(seen) == len({json.loads(r["params"])["scaler"] for r in rows})
    for r in rows:
        alone = G.HierarchicalAdditiveRegressor(features=["a", "b"], target="y", **json.loads(r["params"])).fit(df)
        assert np.isclose(alone.score(df), r["score"], rtol=1e-9)


def _nodes_of(model, spark):
    nodes = EX._nodes(model, spark)[0].sort_values(["treeID", "id"])
    cut = [(r["featureIndex"], *[round(x, 9) for x in r["leftCategoriesOrThreshold"]]) for r in nodes["split"]]
    return list(zip(nodes["id"], nodes["leftChild"], nodes["rightChild"], nodes["rawCount"], nodes["prediction"], cut, strict=True)), np.array(nodes["impurityStats"].tolist()), nodes[["impurity", "gain"]].to_numpy()


@pytest.mark.parametrize("params", [{}, {"impurity": "entropy", "maxBins": 8, "minInstancesPerNode": 40}, {"minInfoGain": 0.002, "minWeightFractionPerNode": 0.02}])
def test_trees_on_distinct_rows_are_those_of_mllib(spark, params):
    df = spark.range(6000).selectExpr("cast(pmod(hash(id), 45) as double) as a", "cast(pmod(hash(id, 1), 7) as double) as b", "cast(pmod(hash(id, 2), 100) as double) as c", "id")
    df = df.selectExpr("a", "b", "c", "cast(case when pmod(hash(id, 3), 100) < a + 5 * b then 1 when c > 60 then 2 else 0 end as double) as y", "1.0 + pmod(id, 2) as w")
    est = X.RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", numTrees=1, maxDepth=5, bootstrap=False, seed=1, **params)
    rows = X.assembled(df, ["a", "b", "c"])
    (mine, stats, sizes), (theirs, want, want_sizes) = (_nodes_of(m, spark) for m in (fit_forest(est, rows, ["a", "b", "c"], "y", "w"), est.fit(rows)))
    assert len(mine) > 10 and mine == theirs
    inner = sizes[:, 1] >= 0  # a leaf's impurity serves nothing, and MLlib gives it as -1 where no split is allowed
    assert np.allclose(stats, want) and np.allclose(sizes[inner], want_sizes[inner])


def test_forest_draws_copies_as_rows(spark, monkeypatch):
    """The draws of c copies have mean and variance c; MLlib's forest isn't asked, and gets all rows where it is."""
    df = spark.range(4000).selectExpr("cast(id % 5 as double) as a", "cast(id % 3 as double) as b", "cast(id % 2 as double) as y")
    fit, seen = X.RandomForestClassifier.fit, []
    monkeypatch.setattr(X.RandomForestClassifier, "fit", lambda self, rows, *a: (seen.append(rows.count()), fit(self, rows, *a))[1])
    model = X._fit(X.CLASSIFIERS, "rf", X.assembled(df, ["a", "b"]), "y", {"numTrees": 400, "maxDepth": 1})
    nodes = EX._nodes(model, spark)[0]
    drawn = nodes[nodes["id"] == 0]["rawCount"].to_numpy()
    assert not seen and model.getNumTrees == 400 and abs(drawn.mean() - 4000) < 15 and 0.75 < drawn.var() / 4000 < 1.3
    again = X._fit(X.CLASSIFIERS, "rf", X.assembled(df.repartition(7), ["a", "b"]), "y", {"numTrees": 400, "maxDepth": 1})
    assert again.toDebugString.split("\n")[1:] == model.toDebugString.split("\n")[1:]
    few = df.groupBy("a", "b", "y").agg(F.count("*").alias("n"))
    monkeypatch.setattr(FO, "MOST", 20)
    X._fit(X.CLASSIFIERS, "rf", X.assembled(few, ["a", "b"]), "y", {"numTrees": 2, "maxDepth": 1}, None, "n")
    assert seen == [4000] and X.repeated(few, "n", 30).exceptAll(df).count() == 0


def test_classes_in_folds_by_counts(spark):
    df = spark.range(3000).selectExpr("nullif(cast(pmod(hash(id), 4) as double), 3) as a", "cast(pmod(hash(id, 1), 3) as double) as b", "cast(pmod(hash(id, 2), 3) = 0 as double) as y")
    rows = {tuple(r) for r in W.stratified_folds(df, "y", 4).groupBy("a", "b", "y", "fold").count().collect()}
    assert rows == {tuple(r) for r in W.counted_folds(df, "y", 4).collect()}
    scores, oof, models = X.classification_cv(df, ["a", "b"], "y", k=4, numTrees=5, maxDepth=3, weights=(2.0, 1.0))
    whole = df.where("a is not null")
    assert len(models) == 4 and oof.select("a", "b", "y").exceptAll(whole).count() == 0 and oof.count() == whole.count()
    want = M.confusion(oof, "y", "predicted").crossJoin(M.auc(oof, "y", "probability")).first()
    assert np.allclose(scores.first(), want) and scores.columns == list(want.asDict())
    assert oof.columns == ["a", "b", "y", "_fold", "probability", "predicted"]


@pytest.mark.parametrize("weight", [None, "w"])
def test_rules_of_distinct_rows_are_those_of_all(spark, monkeypatch, weight):
    from pyspark.ml.stat import Summarizer

    df = spark.range(3000).selectExpr("nullif(cast(pmod(hash(id), 4) as int), 3) as a", "cast(pmod(hash(id, 1), 3) as double) as b", "id", "1.0 + pmod(id, 2) as w")
    df = df.selectExpr("a", "b", "cast(coalesce(a, 1) + b + pmod(hash(id, 3), 3) > 3 as int) as y", "w")
    fit, seen = X.LogisticRegression.fit, []
    monkeypatch.setattr(X.LogisticRegression, "fit", lambda self, rows, *a: (m := fit(self, rows, *a), seen.append((self, rows.localCheckpoint(), m)))[0])
    got = {r["rule"]: r for r in X.rules(df, ["a", "b"], "y", 10, trees=8, depth=2, penalty=0.01, weight=weight).collect()}
    est, rows, model = seen[0]
    assert rows.count() == df.select("a", "b", "y", *([weight] if weight else [])).distinct().count() < 60 and len(got) > 2
    for rule, r in got.items():
        assert np.isclose(r["support"], df.agg(F.avg(F.expr(f"coalesce(double({rule}), 0.0)"))).first()[0])
    every = X.repeated(rows.withColumn("_w", F.col("_w") / F.col("_n")), "_n")
    assert every.count() == 3000
    # each rule has the penalty that it has in a fit on all rows, and the fits reach the same objective
    before, now = (x.agg(Summarizer.std(F.col("features"), F.col("_w"))).first()[0].toArray() for x in (every, rows))
    assert np.allclose(0.01 * before, est.getRegParam() * now, rtol=1e-9) and not np.allclose(before, now, rtol=1e-4)
    whole = fit(X.LogisticRegression(labelCol="y", regParam=0.01, elasticNetParam=1.0, weightCol="_w"), every)
    assert np.isclose(whole.summary.objectiveHistory[-1], model.summary.objectiveHistory[-1], rtol=1e-5)


def test_rules_weigh_every_path(spark, monkeypatch):
    df = spark.range(2000).selectExpr("cast(pmod(hash(id), 23) as double) as a", "cast(pmod(hash(id, 1), 19) as double) as b").selectExpr("a", "b", "cast(a * b > 90 or a = 3 as int) as y").coalesce(1)
    fit, seen = X.LogisticRegression.fit, []
    monkeypatch.setattr(X.LogisticRegression, "fit", lambda self, rows, *a: (seen.append((self, rows.collect(), m := fit(self, rows, *a))), m)[1])
    got = [tuple(r) for r in X.rules(df, ["a", "b"], "y", 2, trees=10, depth=3, penalty=1e-3).collect()]
    est, rows, model = seen[0]
    found = X.paths(X._fit(X.CLASSIFIERS, "rf", X.assembled(df, ["a", "b"]), "y", {"numTrees": 10, "maxDepth": 3, "seed": 42}))
    assert model.numFeatures == len(found) > 16 and len(got) == 2  # before: 8 of them
    assert len({frozenset(p) for p in found}) == len(found) and all(len({c[:2] for c in p}) == len(p) for p in found)
    # at the least objective a coefficient's slope is the penalty at most, before 100 rounds or after
    x = np.array([r["features"].toArray() for r in rows])
    y, w, beta = np.array([r["y"] for r in rows]), np.array([r["_w"] for r in rows]), model.coefficients.toArray()
    slope = x.T @ (w * (1 / (1 + np.exp(-x @ beta - model.intercept)) - y)) / w.sum()
    spread = np.sqrt(np.maximum(0, w @ (x - w @ x / w.sum()) ** 2 / (w.sum() - (w**2).sum() / w.sum())))
    assert (np.abs(slope) <= 1.1 * est.getRegParam() * spread + 1e-6).all() and est.getMaxIter() > 100
    share = w @ x / w.sum()
    assert np.allclose([g[3] for g in got], sorted(np.abs(beta) * np.sqrt(share * (1 - share)))[:-3:-1])


def test_paths_that_rows_hold_are_those_of_sql(spark, monkeypatch):
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate((a, b) for a in (None, math.nan, -math.inf, math.inf, -1.0, 0.5, 2.0) for b in (None, 1, 2, 3))], "a double, b int, k int")
    found = [((0, "<=", 0.5),), ((0, ">", 0.5),), ((1, ">", 1.5),), ((0, "<=", 2.0), (0, ">", -1.0)), ((0, ">", -1.0), (1, "<=", 2.5))]
    texts = [" and ".join(f"{'ab'[f]} {side} {cut}D" for f, side, cut in p) for p in found]
    monkeypatch.setattr(X, "PART", 8)  # in slices of a batch
    got = {r["k"]: list(r["v"].toArray()) for r in X._held(df, ["a", "b"], found, "v").collect()}
    want = df.select("k", *[F.expr(f"coalesce(double({t}), 0.0)") for t in texts]).collect()
    assert len(got) == 28 and all(got[r[0]] == list(r[1:]) for r in want)


def test_shapley_selection_explains_every_row(spark, monkeypatch):
    # many copies of few rows, some of them null in a feature
    df = spark.range(9000).selectExpr("cast(pmod(hash(id), 12) as double) as a", "nullif(cast(pmod(hash(id, 1), 9) as double), 8) as b", "id").selectExpr("a", "b", "a + 3 * coalesce(b, 0) as y")
    fit, models = X._fit, []
    monkeypatch.setattr(X, "_fit", lambda *a, **b: (models.append(fit(*a, **b)), models[-1])[1])
    s = X.ProbeSelector(probes=2, rounds=1, mode="shap", params={"maxIter": 4, "maxDepth": 3}).fit(df, "y", ["a", "b"])
    data, probes = X.ProbeSelector(probes=2)._with_probes(df)
    folds, names, want = W.shuffled_folds(data, 3, 42, "_fold").toPandas(), ["a", "b", *probes], []
    for f, model in enumerate(models):
        x = folds[folds["_fold"] == f][names].dropna().to_numpy()
        want.append(np.abs(EX.shapley(EX.leaves(model, spark), x)).mean(0))
        assert len(x) > 2000  # before: the 2,000 with the least hashes
    got = {r["feature"]: r for r in s.trace.collect()}
    assert len(models) == 3
    for i, c in enumerate("ab"):
        v = np.array(want)[:, i]
        assert np.allclose([got[c]["mean"], got[c]["min"], got[c]["max"]], [v.mean(), v.min(), v.max()], rtol=1e-9)
    assert np.isclose(got["a"]["threshold"], np.mean(want, 0)[2:].mean())
    # counts instead of rows, and all rows one by one, give the same
    x = W.shuffled_folds(data, 3, 42, "_fold").where("_fold = 0").na.drop()
    few = x.groupBy(*names).agg(F.count("*").alias("n"))
    for rows, count in ((x, None), (few, "n")):
        found = {r["feature"]: r["importance"] for r in EX.importance(models[0], rows, names, None, count).collect()}
        assert np.allclose([found[c] for c in names], want[0], rtol=1e-9, atol=1e-15)


def test_shapley_selection_of_classes_explains_every_row(spark, monkeypatch):
    df = spark.range(7000).selectExpr("cast(pmod(hash(id), 12) as double) as a", "cast(pmod(hash(id, 1), 9) as double) as b", "cast(pmod(hash(id), 12) > 5 as int) as y")
    fit, models = X._fit, []
    monkeypatch.setattr(X, "_fit", lambda *a, **b: (models.append(fit(*a, **b)), models[-1])[1])
    s = X.ProbeSelector(probes=2, rounds=1, mode="shap", params={"numTrees": 5, "maxDepth": 3}).fit(df, "y", ["a", "b"])
    data, probes = X.ProbeSelector(probes=2)._with_probes(df.select("a", "b", F.col("y").cast("double").alias("y")))
    folds = W.stratified_folds(data, "y", 3, 42, "_fold").toPandas()
    want = [np.abs(EX.shapley(EX.leaves(m, spark), folds[folds["_fold"] == f][["a", "b", *probes]].to_numpy())).mean(0) for f, m in enumerate(models)]
    assert "a" in s.kept and np.isclose({r["feature"]: r["mean"] for r in s.trace.collect()}["a"], np.mean(want, 0)[0], rtol=1e-9)


@pytest.mark.parametrize("counted", [False, True])
def test_rows_in_folds_by_counts(spark, counted):
    df = spark.range(3000).selectExpr("nullif(cast(pmod(hash(id), 4) as double), 3) as a", "cast(pmod(hash(id, 1), 3) as double) as b")
    want = {tuple(r) for r in W.shuffled_folds(df, 4).groupBy("a", "b", "fold").count().collect()}
    rows = df.groupBy("a", "b").agg(F.count("*").alias("n")) if counted else df
    assert {tuple(r) for r in W.counted_folds(rows, None, 4).collect()} == want
