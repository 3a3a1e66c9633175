"""Queries for sources, models, selectors, probes and charts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from quernel.functions.durable import shared_folder
from quernel.operators import additive as G
from quernel.operators import drift as D
from quernel.operators import hsic as H
from quernel.operators import icc as I
from quernel.operators import models as X
from quernel.operators import probes as R
from quernel.operators import splits as W
from quernel.plans.registry import SQL, query, r, rounded, table
from quernel.plans.relational import CUT
from quernel.plans.statistics import NUMERIC_DRIFT, drift_digits
from quernel.sources import readers as S

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _items(spark, d):
    """lineitem's numbers with an order; the whole table."""
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", *FEATURES, (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_returnflag").alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("cls"))


@query("io1_csv", "SELECT r_regionkey, r_name FROM region")
def io1(spark, d):
    text = "r_regionkey,r_name\n" + "".join(f"{x[0]},{x[1]}\n" for x in table(spark, d, "region").select("r_regionkey", "r_name").collect())
    return S.from_bytes(spark, text.encode(), "region.csv").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("io2_feather", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io2(spark, d):
    import io

    import pyarrow.feather as pf

    out = io.BytesIO()
    pf.write_feather(table(spark, d, "nation").toArrow(), out)
    return S.from_bytes(spark, out.getvalue(), "nation.feather").select("n_nationkey", "n_name", "n_regionkey")


@query("io3_upload", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def io3(spark, d):
    import io

    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").toArrow(), out)
    return S.from_bytes(spark, out.getvalue(), "supplier.parquet")


@query("io4_upload_falls_back", "SELECT n_nationkey, n_name FROM nation")
def io4(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    text = "n_nationkey,n_name\n" + "".join(f"{a},{b}\n" for a, b in rows)
    return S.from_bytes(spark, text.encode(), "nation.txt", ".csv").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("io7_feather_sink", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def io7(spark, d):
    folder = f"{_folder(spark)}/bundle-{uuid.uuid4().hex}"
    S.persist(S.SyntheticDataset(table(spark, d, "orders").select("o_orderstatus", "o_totalprice"), table(spark, d, "region")), folder, "feather")
    back = S.from_path(spark, f"{folder}/data.feather") if S.list_files(spark, folder, (".feather",)) else S.READERS[".feather"](spark, f"{folder}/data")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("io8_dataset_split", """SELECT p_brand, k <= ceil(n * 0.25) AS in_test, count(*) AS n
FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) GROUP BY 1, 2""")
def io8(spark, d):
    train, test = S.dataset_split(spark, "part", d, "p_brand", 0.25)
    both = train.withColumn("in_test", F.lit(False)).unionByName(test.withColumn("in_test", F.lit(True)))
    return both.groupBy("p_brand", "in_test").agg(F.countDistinct("p_partkey").alias("n"))


@query("io5_listing", "SELECT table_name || '.parquet' AS name FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')")
def io5(spark, d):
    return spark.createDataFrame([(os.path.basename(p),) for p in S.list_files(spark, d)], "name string")


@query("io6_synthetic")
def io6(spark, d):
    return S.synthetic(spark).data


@query("m1_regressor")
def m1(spark, d):
    df = _items(spark, d)
    model = X._fit(X.REGRESSORS, "lightgbm", X.assembled(df, FEATURES), "y", {})
    return spark.createDataFrame(sorted(X.gain_importance(model, FEATURES).items()), "feature string, gain double")


@query("m2_time_series_cv")
def m2(spark, d):
    return X.time_series_cv(_items(spark, d), FEATURES, "y", ["l_orderkey", "l_linenumber"]).metrics


@query("m3_classifiers")
def m3(spark, d):
    """Gain importances of each kind of classifier, the additive one included."""
    df = X.assembled(_items(spark, d).withColumn("cls", F.col("cls").cast("double")), FEATURES)
    rows = [(kind, c, float(v)) for kind in ("rf", "catboost", "ebm") for c, v in sorted(X.gain_importance(X._fit(X.CLASSIFIERS, kind, df, "cls", {}), FEATURES).items())]
    return spark.createDataFrame(rows, "kind string, feature string, gain double")


@query("m4_classifier_cv")
def m4(spark, d):
    return X.classification_cv(_items(spark, d), FEATURES, "cls")[0]


@query("m5_shapley_importance")
def m5(spark, d):
    df = _items(spark, d).withColumn("dear", F.col("l_quantity") * (1 - 5 * F.col("l_discount")))
    return X.importance(X._fit(X.REGRESSORS, "tree", X.assembled(df, FEATURES), "dear", {}), df, FEATURES)


@query("m5_additive_contributions", """WITH s AS (SELECT regr_slope(l_extendedprice / 1000, l_quantity) AS slope, avg(l_quantity) AS m FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT 'l_quantity' AS feature, round(avg(abs(slope * (l_quantity - m))), 6) AS importance FROM lineitem, s""")
def m5b(spark, d):
    df, m = _line(spark, d)
    return rounded(m.importance(df))


@query("m6_additive_terms")
def m6(spark, d):
    df = _items(spark, d)
    return X.AdditiveBins("y", FEATURES, 8).fit(df).terms(df)


@query("m7_rules")
def m7(spark, d):
    return X.rules(_items(spark, d).withColumn("dear", (F.col("l_quantity") * (1 - 5 * F.col("l_discount")) > 20).cast("int")), FEATURES, "dear", penalty=0.0001)


@query("m8_logistic")
def m8(spark, d):
    model = X.logistic_pipeline(_items(spark, d), FEATURES, "cls")
    return spark.createDataFrame([(c, float(v)) for c, v in zip(FEATURES, model.stages[-1].coefficients, strict=True)], "feature string, coefficient double")


@query("ts1_tree_scores")
def ts1(spark, d):
    s = W.chronological_split(_items(spark, d), ["l_orderkey", "l_linenumber"])
    return X.tree_scores(s.train, s.valid, FEATURES, "y", drifting=["l_tax"])[0]


@query("n1_probe_selection")
def n1(spark, d):
    return X.ProbeSelector().fit(_items(spark, d), "y", FEATURES).trace


@query("n2_shapley_selection")
def n2(spark, d):
    df = _items(spark, d).withColumn("dear", F.col("l_quantity") * (1 - 5 * F.col("l_discount")))
    return X.ProbeSelector(probes=3, mode="shap", params={"maxIter": 20}).fit(df, "dear", FEATURES).trace


_KINDS = " UNION ALL ".join(f"SELECT '{c}' AS target, CASE WHEN typeof(any_value({e})) IN ('VARCHAR', 'BOOLEAN') OR (typeof(any_value({e})) IN ('INTEGER', 'BIGINT') AND count(DISTINCT {e}) <= 20) THEN 'classification' ELSE 'regression' END AS task FROM lineitem" for c, e in {"grp": "l_returnflag", "l_linenumber": "l_linenumber", "l_orderkey": "l_orderkey", "y": "l_extendedprice"}.items())


@query("n4_task_types", _KINDS)
def n4(spark, d):
    df = _items(spark, d)
    return spark.createDataFrame([(c, X.task_type(df, c)) for c in ("grp", "l_linenumber", "l_orderkey", "y")], "target string, task string")


_OLS = "WITH s AS (SELECT regr_slope(l_extendedprice / 1000, l_quantity) AS slope, avg(l_extendedprice / 1000) AS bias, avg(l_quantity) AS m, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem)"


def _line(spark, d):
    """The additive regressor without knots, penalty and groups: a line, which SQL can fit too."""
    df = _items(spark, d)
    return df, G.HierarchicalAdditiveRegressor(["l_quantity"], "y", None, "none", knots=0, ridge=0.0).fit(df)


def _folder(spark):
    return f"{shared_folder(spark)}/quernel/{spark.sparkContext.applicationId}"


@query("x1_encoder_plug_in", "SELECT p_partkey, length(p_name)::DOUBLE AS p_name__length FROM part")
def x1(spark, d):
    from quernel.operators import encoders as E

    def fit(rows, column):
        return E.Fitted(column, [f"{column}__length"], rows.select("category", F.length("category").cast("double").alias("v0")).distinct(), [0.0])

    E.register_encoder("length_of_text", fit)
    try:
        part = table(spark, d, "part")
        return E.CategoricalEncoder("length_of_text").fit(part, None, ["p_name"]).transform(part, ["p_partkey"])
    finally:
        del E.REGISTRY["length_of_text"]


@query("x2_probe_plug_in", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def x2(spark, d):
    R.probe("rows_by_status")(lambda df: R.ProbeResult("rows_by_status", "Rows by status", df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))))
    try:
        return R.run("rows_by_status", table(spark, d, "orders")).table
    finally:
        del R.PROBES["rows_by_status"]


@query("x3_metric_plug_in", "SELECT max(abs(l_extendedprice / 1000 - l_quantity)) AS worst FROM lineitem")
def x3(spark, d):
    from quernel.operators import metrics as M

    M.metric("worst")(lambda y, p: F.max(F.abs(y - p)))
    try:
        return M.evaluate(_items(spark, d), "y", "l_quantity", ("worst",))
    finally:
        del M.METRICS["worst"]


@query("x4_reader_plug_in", "SELECT r_regionkey, r_name FROM region")
def x4(spark, d):
    S.register_reader(".tables")(lambda session, path: session.read.parquet(path.removesuffix(".tables")))
    try:
        return S.from_path(spark, f"{d}/region.parquet.tables").select("r_regionkey", "r_name")
    finally:
        del S.READERS[".tables"]


_FLAGS = "SELECT CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS \"group\", count(*) AS n FROM lineitem GROUP BY 1"


@query("x5_group_mapper", _FLAGS)
def x5(spark, d):
    df = _items(spark, d)
    group = G.group_column(df, lambda t: F.when(t["l_quantity"] > 25, "many").otherwise("few"))
    return df.groupBy(group.alias("group")).agg(F.count("*").alias("n"))


@query("g2_group_labels", "SELECT '__global__' AS \"group\", count(*) AS n FROM lineitem UNION ALL SELECT l_returnflag, count(*) FROM lineitem GROUP BY 1 UNION ALL SELECT l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 1")
def g2(spark, d):
    df = _items(spark, d)
    parts = [df.groupBy(G.group_column(df, g).alias("group")).agg(F.count("*").alias("n")) for g in (None, "grp", {"l_quantity": "l_linenumber", "l_tax": "l_linenumber"})]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("g6_losses", f"{_OLS} SELECT 'mse' AS term, round(avg((l_extendedprice / 1000 - bias - slope * (l_quantity - m)) ** 2), 5) AS value FROM lineitem, s UNION ALL SELECT 'contribution_l1', 0.0::DOUBLE")
def g6(spark, d):
    df, m = _line(spark, d)
    return m.losses(df).where("term in ('mse', 'contribution_l1')").select("term", r("value", 5).alias("value"))


@query("g6_losses_of_groups")
def g6b(spark, d):
    df, m = _additive(spark, d, "residual")
    return m.losses(df, {"centre": 0.1, "orthogonality": 0.01})


@query("h7_selector_overrides")
def h7(spark, d):
    got = H.HSICLasso()(_items(spark, d).groupBy("l_linenumber", "grp").agg(F.avg("l_quantity").alias("a"), F.avg("l_tax").alias("b"), F.avg("y").alias("y")), ["a", "b"], "y", lam=1e-6)
    return spark.createDataFrame(sorted(got["coefficients"].items()), "feature string, coefficient double")


@query("v1_line_table", "SELECT l_linenumber AS x, round(avg(l_quantity), 6) AS y FROM lineitem GROUP BY 1")
def v1b(spark, d):
    return rounded(R.line_table(table(spark, d, "lineitem"), "l_linenumber", "l_quantity"))


@query("v1_icc_bars", f"""SELECT "Type" AS label, "ICC" AS value FROM ({SQL["i1_icc_one_way"]})""")
def v1c(spark, d):
    return rounded(R.icc_bars(I.icc_one_way(table(spark, d, "events"), "event_type", "value")))


@query("v2_violin_table", """WITH s AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 30 AS w FROM lineitem), k AS (SELECT l_returnflag AS g, least(floor((l_quantity - a) / w), 29) AS k, a, w FROM lineitem, s)
SELECT g AS "group", round(any_value(a) + k * any_value(w), 6) AS low, round(any_value(a) + (k + 1) * any_value(w), 6) AS high, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY g), 6) AS share FROM k GROUP BY g, k""")
def v2b(spark, d):
    return rounded(R.violin_table(table(spark, d, "lineitem"), "l_quantity", "l_returnflag"))


@query("v2_scatter_table")
def v2c(spark, d):
    return R.scatter_table(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


def _additive(spark, d, head):
    df = _items(spark, d)
    return df, G.HierarchicalAdditiveRegressor(FEATURES, "y", "grp", head).fit(df)


@query("g4_affine_head", """WITH c AS (SELECT s_suppkey, s_nationkey % 3 AS g, s_acctbal / 1000 AS z FROM supplier)
SELECT s_suppkey, round(CASE g WHEN 0 THEN z * 1.5 + 1 WHEN 1 THEN z * 0.5 - 1 ELSE z END, 6) AS adjusted FROM c""")
def g4(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).cast("string").alias("group"), (F.col("s_acctbal") / 1000).alias("contrib_z"))
    params = spark.createDataFrame([("0", "z", 0.5, 1.0), ("1", "z", -0.5, -1.0)], "group string, feature string, scale double, shift double")
    return G.affine_head(s, params, ["z"]).select("s_suppkey", r("contrib_z").alias("adjusted"))


@query("g7_additive_affine")
def g7(spark, d):
    df, m = _additive(spark, d, "affine")
    return m.predict(df).groupBy("grp").agg(F.avg("y").alias("y"), F.avg("prediction").alias("prediction"))


@query("g8_contributions_sum", f"{_OLS} SELECT l_orderkey, l_linenumber, round(slope * (l_quantity - m), 5) AS contribution, round(bias + slope * (l_quantity - m), 5) AS prediction, true AS exact FROM lineitem, s")
def g8(spark, d):
    """Contributions and their sum: of a line, which SQL can fit; exact: whether those of the residual head sum up too."""
    df, line = _line(spark, d)
    _, m = _additive(spark, d, "residual")
    keys = ["l_orderkey", "l_linenumber"]
    out = m.predict_and_contributions(line.predict_and_contributions(df).select(*df.columns, F.col("contrib_l_quantity").alias("contribution"), F.col("prediction").alias("by_line")))
    exact = F.abs(sum((F.col(f"contrib_{f}") for f in FEATURES), F.col("bias")) - F.col("prediction")) < 1e-9
    return out.select(*keys, r("contribution", 5).alias("contribution"), r("by_line", 5).alias("prediction"), exact.alias("exact"))


@query("g9_importance", f"{_OLS} SELECT 'l_quantity' AS feature, round(avg(abs(slope * (l_quantity - m))), 6) AS importance FROM lineitem, s")
def g9(spark, d):
    df, m = _line(spark, d)
    return rounded(m.importance(df))


@query("g10_shape_curve", f"{_OLS} SELECT round(low + k * (high - low) / 49, 6) AS x, round(slope * (low + k * (high - low) / 49 - m), 6) AS contribution FROM s, range(0, 50) t(k)")
def g10(spark, d):
    _, m = _line(spark, d)
    return rounded(m.shape_curve(spark, "l_quantity", None, 50))


@query("g10_group_shape_curve")
def g10b(spark, d):
    _, m = _additive(spark, d, "affine")
    return m.shape_curve(spark, "l_quantity", "R", 50)


@query("g11_search")
def g11(spark, d):
    s = W.chronological_split(_items(spark, d), ["l_orderkey", "l_linenumber"])
    return G.search(s.train, s.valid, {"knots": [2, 4, 8, 16], "ridge": [0.01, 0.1, 1.0, 10.0], "group_ridge": [5.0, 50.0, 500.0], "scaler": ["standard", "robust"]}, features=FEATURES, target="y")[1]


@query("pr1_residual_by_time", """WITH f AS (SELECT date_trunc('day', min(ts)) AS day0, max(ts) AS last FROM events), spine AS (SELECT day0 + to_days((7 * k)::INT) AS bucket FROM f, range(0, 1000) t(k) WHERE day0 + to_days((7 * k)::INT) <= last)
SELECT bucket, round(avg(value - 10), 6) AS mean, round(stddev_samp(value - 10), 6) AS std, count(value) AS n FROM spine LEFT JOIN events ON ts >= bucket AND ts < bucket + INTERVAL 7 DAY GROUP BY bucket""")
def pr1(spark, d):
    e = table(spark, d, "events").withColumn("res", F.col("value") - 10)
    return rounded(R.run("residual_by_time", e, "ts", "res").table)


@query("pr2_importance_stability", """WITH g AS (SELECT l_linenumber AS fold, abs(regr_slope(l_extendedprice / 1000, l_quantity)) AS l_quantity, abs(regr_slope(l_extendedprice / 1000, l_tax)) AS l_tax FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS feature, round(avg(l_quantity), 6) AS gain, (SELECT round(stddev_samp(l_quantity), 6) FROM lineitem) AS permutation FROM g UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), NULL FROM g""")
def pr2(spark, d):
    """Slopes of each fold as the importances, so that SQL can make them from the table too."""
    df = _items(spark, d)
    slopes = df.groupBy("l_linenumber").agg(*[F.abs(F.regr_slope("y", c)).alias(c) for c in ("l_quantity", "l_tax")])
    gain = slopes.select(F.lit("l_quantity").alias("feature"), F.col("l_quantity").alias("gain")).unionByName(slopes.select(F.lit("l_tax").alias("feature"), F.col("l_tax").alias("gain")))
    return rounded(R.run("importance_stability", gain, df.agg(F.lit("l_quantity").alias("feature"), F.stddev_samp("l_quantity").alias("mean")), 1.0).table)


@query("pr3_drift_importance", f"""SELECT *, CASE WHEN ks >= 0.001 THEN 'ks>0.001' ELSE 'ok' END AS note, CASE WHEN ks >= 0.001 THEN 'high' ELSE 'low' END AS risk_level, CASE WHEN feature = 'l_tax' THEN 0.3::DOUBLE END AS importance,
  feature = 'l_tax' AND ks >= 0.001 AS critical FROM ({NUMERIC_DRIFT.replace("l_extendedprice", "l_tax")})""")
def pr3(spark, d):
    t = table(spark, d, "lineitem")
    cut = F.lit(CUT).cast("timestamp_ntz")
    drift = D.DriftAnalyzer({"ks": 0.001}).table(t.where(F.col("l_shipdate") < cut), t.where(F.col("l_shipdate") >= cut), ["l_quantity", "l_tax"])
    return drift_digits(R.run("drift_importance_matrix", drift, spark.createDataFrame([("l_tax", 0.3)], "feature string, importance double")).table)


@query("pr4_icc_top", f"""SELECT "Type", "ICC", CASE "Type" WHEN 'ICC1' THEN 'one-way random, absolute agreement' WHEN 'ICC2' THEN 'two-way random, absolute agreement' ELSE 'two-way mixed, consistency' END AS "Description"
FROM ({SQL["i1_icc_one_way"]}) ORDER BY "ICC" DESC, "Type" LIMIT 1""")
def pr4(spark, d):
    """The values are rounded before they are ordered, so that what rounds alike is a tie, and the type decides."""
    return R.run("icc_group_stability", rounded(I.icc_one_way(table(spark, d, "events"), "event_type", "value"))).table


@query("pr5_target_curve", "SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def pr5(spark, d):
    return R.run("target_feature_curve", table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").table


@query("pr5_lowess")
def pr5b(spark, d):
    return R.lowess(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", points=20)


@query("v1_box_table", 'SELECT event_type AS "group", min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY 1')
def v1(spark, d):
    return rounded(R.box_table(table(spark, d, "events"), "value", "event_type"))


@query("v2_density_table")
def v2(spark, d):
    return R.density_table(table(spark, d, "lineitem"), "l_extendedprice")


@query("io9_encoder_round_trip", f"SELECT p_partkey, v0 AS value, true AS same FROM ({SQL['e3_target'].replace('80.0::DOUBLE', '10.0::DOUBLE')})")
def io9(spark, d):
    from quernel.operators.encoders import CategoricalEncoder
    from quernel.plans.statistics import _part

    part = _part(spark, d)
    enc = CategoricalEncoder("target").fit(part, "p_retailprice", ["p_brand"])
    path = f"{_folder(spark)}/encoder-{uuid.uuid4().hex}"
    enc.save(path)
    a = enc.transform(part, ["p_partkey"]).withColumnRenamed("p_brand__target_mean", "a")
    b = CategoricalEncoder.load(path).transform(part, ["p_partkey"]).withColumnRenamed("p_brand__target_mean", "b")
    return a.join(b, "p_partkey").select("p_partkey", r("b").alias("value"), (F.col("a") == F.col("b")).alias("same"))
