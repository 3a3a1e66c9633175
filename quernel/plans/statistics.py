"""Queries for drift, ICC, kernel dependence, encoders and preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import drift as D
from quernel.operators import encoders as E
from quernel.operators import hsic as H
from quernel.operators import icc as I
from quernel.operators import preprocess as P
from quernel.operators import splits as W
from quernel.plans.registry import SQL, query, r, rounded, table
from quernel.plans.relational import CUT, PART, _part

NUM = ["l_quantity", "l_extendedprice"]


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "lineitem")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return t.where(F.col("l_shipdate") < cut), t.where(F.col("l_shipdate") >= cut)


_LONG = f"""l AS (SELECT feature, v, side FROM (
  SELECT 'l_quantity' AS feature, l_quantity AS v, (l_shipdate >= TIMESTAMP '{CUT}')::INT AS side FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice, (l_shipdate >= TIMESTAMP '{CUT}')::INT FROM lineitem))"""
_CDF = f"""{_LONG}, c AS (SELECT feature, v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM l GROUP BY 1, 2),
f AS (SELECT *, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS fb, lead(v) OVER (PARTITION BY feature ORDER BY v) AS nxt FROM c WINDOW w AS (PARTITION BY feature ORDER BY v))"""


@query("d1_ks", f"WITH {_CDF} SELECT feature, round(max(abs(fa - fb)), 8) AS ks FROM f GROUP BY 1")
def d1(spark, d):
    return D.two_sample(*_sides(spark, d), NUM).select("feature", r("ks", 8).alias("ks"))


@query("d2_cvm", f"""WITH {_LONG}, k AS (SELECT feature, side, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rk, row_number() OVER (PARTITION BY feature, side ORDER BY v) AS i FROM l),
s AS (SELECT feature, sum(CASE WHEN side = 0 THEN (rk - i) ** 2 ELSE 0 END) AS sa, sum(CASE WHEN side = 1 THEN (rk - i) ** 2 ELSE 0 END) AS sb, count(*) FILTER (side = 0)::DOUBLE AS n, count(*) FILTER (side = 1)::DOUBLE AS m FROM k GROUP BY 1)
SELECT feature, round((n * sa + m * sb) / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)), 5) AS cvm FROM s""")
def d2(spark, d):
    return D.two_sample(*_sides(spark, d), NUM).select("feature", r("cvm", 5).alias("cvm"))


def _psi_sql() -> str:
    at = "[" + ", ".join(f"{i}/20.0::DOUBLE" for i in range(21)) + "]"
    return f"""WITH {_LONG}, q AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {at}))) AS e FROM l WHERE side = 0 GROUP BY 1),
b AS (SELECT l.feature, side, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS bin FROM l JOIN q ON l.feature = q.feature WHERE v >= e[1] AND v <= e[len(e)]),
c AS (SELECT feature, bin, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM b GROUP BY 1, 2),
p AS (SELECT feature, a / sum(a) OVER (PARTITION BY feature) AS p, b / sum(b) OVER (PARTITION BY feature) AS q FROM c)
SELECT feature, round(sum((p - q) * ln((p + 1e-6) / (q + 1e-6))), 8) AS psi FROM p GROUP BY 1"""


@query("d3_psi", _psi_sql().replace("i/20.0", "i/20.0"))
def d3(spark, d):
    return D.psi_numeric(*_sides(spark, d), NUM).select("feature", r("psi", 8).alias("psi"))


@query("d4_wasserstein", f"WITH {_CDF} SELECT feature, round(sum(abs(fa - fb) * (nxt - v)), 6) AS wasserstein FROM f WHERE nxt IS NOT NULL GROUP BY 1")
def d4(spark, d):
    return D.two_sample(*_sides(spark, d), NUM).select("feature", r("wasserstein").alias("wasserstein"))


_SHAPE = f"""WITH {_LONG}, e AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM l WHERE side = 0 GROUP BY 1),
b AS (SELECT l.feature, side, least(floor((v - lo) / ((hi - lo) / 20)), 19) AS bin, (hi - lo) / 20 AS w FROM l JOIN e ON l.feature = e.feature WHERE v >= lo AND v <= hi),
c AS (SELECT feature, bin, any_value(w) AS w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM b GROUP BY 1, 2),
p AS (SELECT feature, w, a / sum(a) OVER (PARTITION BY feature) AS p, b / sum(b) OVER (PARTITION BY feature) AS q FROM c)"""


@query("d5_js", f"{_SHAPE} SELECT feature, round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2, 8) AS js FROM p GROUP BY 1")
def d5(spark, d):
    return D.shape_numeric(*_sides(spark, d), NUM).select("feature", r("js", 8).alias("js"))


@query("d6_tv", f"{_SHAPE} SELECT feature, round(sum(abs(p - q) / w) / 2, 10) AS tv, round(sum(abs(p - q)) / 2, 8) AS tv_prob FROM p GROUP BY 1")
def d6(spark, d):
    return D.shape_numeric(*_sides(spark, d), NUM).select("feature", r("tv", 10).alias("tv"), r("tv_prob", 8).alias("tv_prob"))


_CAT = """WITH l AS (SELECT o_orderpriority AS v, (o_totalprice >= 200000)::INT AS side FROM orders),
c AS (SELECT v, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM l GROUP BY 1),
p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q, a FROM c), s AS (SELECT p, q, q / sum(q) OVER () AS r FROM p WHERE a > 0)"""


@query("d7_categorical", f"{_CAT} SELECT 'o_orderpriority' AS feature, round(sum((p - q) * ln((p + 1e-9) / (q + 1e-9))), 8) AS psi, round(sum(p * ln(p / r) + r * ln(r / p)), 8) AS js, round(sum(abs(p - q)) / 2, 8) AS tv FROM s")
def d7(spark, d):
    o = table(spark, d, "orders")
    return rounded(D.categorical(o.where("o_totalprice < 200000"), o.where("o_totalprice >= 200000"), ["o_orderpriority"]), 8)


@query("d8_risk", f"""WITH {_CDF}, k AS (SELECT feature, max(abs(fa - fb)) AS ks FROM f GROUP BY 1) SELECT feature, CASE WHEN ks >= 0.004 THEN 'ks>0.004' ELSE 'ok' END AS note, CASE WHEN ks >= 0.004 THEN 'high' ELSE 'low' END AS risk_level FROM k""")
def d8(spark, d):
    return D.with_risk(D.two_sample(*_sides(spark, d), NUM).select("feature", "ks"), {"ks": 0.004, "psi": 0}).select("feature", "note", "risk_level")


#: Numeric features in one table, from the queries of the single metrics.
NUMERIC_DRIFT = "SELECT feature, ks, cvm, psi, wasserstein, js, tv FROM " + " JOIN ".join(f"({SQL[n]}) AS {n}{' USING (feature)' if n != 'd1_ks' else ''}" for n in ("d1_ks", "d2_cvm", "d3_psi", "d4_wasserstein", "d5_js", "d6_tv"))
_FLAG = f"""(WITH c AS (SELECT l_returnflag, count(*) FILTER (l_shipdate < TIMESTAMP '{CUT}') AS a, count(*) FILTER (l_shipdate >= TIMESTAMP '{CUT}') AS b FROM lineitem GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q, a FROM c)
SELECT round(sum((p - q) * ln((p + 1e-9) / (q + 1e-9))), 8) AS psi, round(sum(p * ln(p / q) + q * ln(q / p)), 8) AS js, round(sum(abs(p - q)) / 2, 10) AS tv FROM s)"""


def drift_digits(table: DataFrame) -> DataFrame:
    digits = {"ks": 8, "cvm": 5, "psi": 8, "wasserstein": 6, "js": 8, "tv": 10}
    return table.select(*[r(c, digits[c]).alias(c) if c in digits else c for c in table.columns])


@query("d9_drift_report", f"""WITH t AS ({NUMERIC_DRIFT} UNION ALL SELECT 'l_returnflag', NULL, NULL, psi, NULL, js, tv FROM {_FLAG}),
n AS (SELECT *, concat_ws(', ', CASE WHEN psi >= 0.002 THEN 'psi>0.002' END, CASE WHEN ks >= 0.1 THEN 'ks>0.1' END) AS hits FROM t)
SELECT feature, ks, cvm, psi, wasserstein, js, tv, CASE WHEN hits = '' THEN 'ok' ELSE hits END AS note, CASE WHEN hits = '' THEN 'low' ELSE 'high' END AS risk_level FROM n""")
def d9(spark, d):
    return drift_digits(D.DriftAnalyzer({"psi": 0.002, "ks": 0.1}).table(*_sides(spark, d), [*NUM, "l_returnflag"]))


@query("d10_quality_table", "SELECT feature, count(*) AS n, count(*) FILTER (v IS NULL) AS nulls, count(DISTINCT v) AS \"distinct\", min(v) AS low, max(v) AS high FROM (SELECT 'p_brand' AS feature, p_brand AS v FROM %s UNION ALL SELECT 'p_type', p_type FROM %s) GROUP BY 1" % (PART, PART))
def d10(spark, d):
    return D.quality_table(_part(spark, d), ["p_brand", "p_type"])


_ICC = """WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM events GROUP BY 1),
s AS (SELECT sum(n * (m - t) ** 2) / greatest(count(*) - 1, 1) AS b, sum(w) / greatest(sum(n) - count(*), 1) AS w, avg(n) AS k FROM g, (SELECT avg(value) AS t FROM events))"""


@query("i1_icc_one_way", f"""{_ICC} SELECT 'ICC1' AS "Type", round((b - w) / (b + (k - 1) * w + 1e-6), 6) AS "ICC" FROM s UNION ALL SELECT 'ICC2', round(CASE WHEN b > w THEN (b - w) / (b + (k - 1) * w) ELSE 0 END, 6) FROM s UNION ALL SELECT 'ICC3', round(CASE WHEN b = 0 THEN 0 ELSE (b - w) / b END, 6) FROM s""")
def i1(spark, d):
    return I.icc_one_way(table(spark, d, "events"), "event_type", "value").select("Type", r("ICC").alias("ICC"))


_TWO = "(SELECT l_returnflag AS t, l_linenumber AS r, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)"


@query("i2_icc_two_way", f"""WITH c AS {_TWO}, x AS (SELECT count(DISTINCT t) AS n, count(DISTINCT r) AS k, var_pop(v) * count(*) AS ss FROM c),
a AS (SELECT var_pop(m) AS vt FROM (SELECT avg(v) AS m FROM c GROUP BY t)), b AS (SELECT var_pop(m) AS vr FROM (SELECT avg(v) AS m FROM c GROUP BY r)),
s AS (SELECT n, k, vt * n * k / (n - 1) AS b, (ss - vt * n * k) / (n * (k - 1)) AS w, vr * n * k / (k - 1) AS j, (ss - vt * n * k - vr * n * k) / ((n - 1) * (k - 1)) AS e FROM x, a, b)
SELECT 'ICC1' AS "Type", round((b - w) / (b + (k - 1) * w), 6) AS "ICC" FROM s UNION ALL SELECT 'ICC2', round((b - e) / (b + (k - 1) * e + k * (j - e) / n), 6) FROM s UNION ALL SELECT 'ICC3', round((b - e) / (b + (k - 1) * e), 6) FROM s
UNION ALL SELECT 'ICC1k', round((b - w) / b, 6) FROM s UNION ALL SELECT 'ICC2k', round((b - e) / (b + (j - e) / n), 6) FROM s UNION ALL SELECT 'ICC3k', round((b - e) / b, 6) FROM s""")
def i2(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("t"), F.col("l_linenumber").alias("r")).agg(F.avg("l_extendedprice").alias("v"))
    return rounded(I.icc_two_way(c, "t", "r", "v"))


@query("i3_icc_residual", """WITH e AS (SELECT event_type AS g, value - 10.0::DOUBLE AS v FROM events) SELECT g AS "group", round(avg(v), 6) AS mean_value, round(stddev_samp(v), 6) AS std_value, count(v) AS count, round(1.96 * stddev_samp(v) / sqrt(count(v)), 6) AS ci95 FROM e GROUP BY 1""")
def i3(spark, d):
    e = table(spark, d, "events").withColumn("pred", F.lit(10.0))
    return rounded(I.evaluate_icc(e, "event_type", "value", "pred", "ts").group_summary)


@query("h1_linear_hsic", "SELECT feature, round(covar_samp(x, y) * covar_samp(x, y), 2) AS hsic FROM (SELECT 'l_quantity' AS feature, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem UNION ALL SELECT 'l_discount', l_discount * 100, l_extendedprice / 1000 FROM lineitem) GROUP BY 1")
def h1(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("l_discount"), (F.col("l_extendedprice") / 1000).alias("y"))
    return H.linear_hsic(t, NUM[:1] + ["l_discount"], "y").select("feature", r("hsic", 2).alias("hsic"))


_RBF = "(SELECT s_suppkey AS i, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier)"


@query("h2_rbf_hsic", f"""WITH a AS {_RBF}, p AS (SELECT a.i, exp(-power(a.x - b.x, 2) / 8) AS k, exp(-power(a.y - b.y, 2) / 50) AS l FROM a, a b), s AS (SELECT i, sum(k) AS k, sum(l) AS l, sum(k * l) AS kl FROM p GROUP BY 1)
SELECT round((sum(kl) - 2.0::DOUBLE / count(*) * sum(k * l) + sum(k) * sum(l) / (count(*)::DOUBLE * count(*))) / ((count(*) - 1)::DOUBLE * (count(*) - 1)), 8) AS hsic FROM s""")
def h2(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return rounded(H.rbf_hsic(s, "x", "y", 2.0, 5.0), 8)


@query("h2_rbf_hsic_median", f"""WITH a AS {_RBF}, d AS (SELECT a.i, b.i AS j, (a.x - b.x) ** 2 AS dx, (a.y - b.y) ** 2 AS dy FROM a, a b), m AS (SELECT greatest(quantile_cont(dx, 0.5), 1e-12) AS sx, greatest(quantile_cont(dy, 0.5), 1e-12) AS sy FROM d WHERE i < j),
s AS (SELECT i, sum(exp(-dx / (2 * sx))) AS k, sum(exp(-dy / (2 * sy))) AS l, sum(exp(-dx / (2 * sx)) * exp(-dy / (2 * sy))) AS kl FROM d, m GROUP BY 1)
SELECT round((sum(kl) - 2.0::DOUBLE / count(*) * sum(k * l) + sum(k) * sum(l) / (count(*)::DOUBLE * count(*))) / ((count(*) - 1)::DOUBLE * (count(*) - 1)), 8) AS hsic FROM s""")
def h2b(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return rounded(H.rbf_hsic(s, "x", "y"), 8)


@query("h3_impute_standardize", """WITH a AS (SELECT p_partkey, coalesce(CASE WHEN p_size <= 40 THEN p_size END, (SELECT quantile_cont(p_size, 0.5) FROM part WHERE p_size <= 40))::DOUBLE AS x FROM part)
SELECT p_partkey, round((x - (SELECT avg(x) FROM a)) / (SELECT stddev_pop(x) FROM a), 6) AS x FROM a""")
def h3(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size").cast("double")).alias("x"))
    return H.standardized(H.impute(p, ["x"]), ["x"]).select("p_partkey", r("x").alias("x"))


_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in ("p_size", "p_partkey", "p_retailprice"))
_D2 = "SELECT a.i, b.i AS j, (a.p_size - b.p_size) ** 2 AS d0, (a.p_partkey - b.p_partkey) ** 2 AS d1, (a.p_retailprice - b.p_retailprice) ** 2 AS dy FROM z a, z b"


@query("h4_hsic_relevance", f"""WITH z AS (SELECT p_partkey AS i, {_Z} FROM part), d AS ({_D2}), m AS (SELECT quantile_cont(d0, 0.5) AS s0, quantile_cont(d1, 0.5) AS s1, quantile_cont(dy, 0.5) AS sy FROM d WHERE i < j),
k AS (SELECT i, exp(-d0 / (2 * s0)) AS k0, exp(-d1 / (2 * s1)) AS k1, exp(-dy / (2 * sy)) AS l FROM d, m),
s AS (SELECT i, sum(k0) AS k0, sum(k1) AS k1, sum(l) AS l, sum(k0 * l) AS kl0, sum(k1 * l) AS kl1 FROM k GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS n FROM s)
SELECT 'p_size' AS feature, round((sum(kl0) - 2 / any_value(n) * sum(k0 * l) + sum(k0) * sum(l) / any_value(n * n)) / any_value((n - 1) * (n - 1)), 6) AS hsic FROM s, t
UNION ALL SELECT 'p_partkey', round((sum(kl1) - 2 / any_value(n) * sum(k1 * l) + sum(k1) * sum(l) / any_value(n * n)) / any_value((n - 1) * (n - 1)), 6) FROM s, t""")
def h4(spark, d):
    got = H.relevance(table(spark, d, "part"), ["p_size", "p_partkey"], "p_retailprice")
    return spark.createDataFrame(got, "feature string, hsic double").select("feature", r("hsic").alias("hsic"))


_LASSO = ["p_size", "p_partkey", "brand", "name_length"]


def _lasso_frame(spark, d):
    part = table(spark, d, "part")
    return part.select("p_size", "p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("brand"), F.length("p_name").alias("name_length"), "p_retailprice")


@query("h5_hsic_lasso")
def h5(spark, d):
    m = H.HSICLasso().fit(_lasso_frame(spark, d), _LASSO, "p_retailprice")
    return spark.createDataFrame([(c, b, c in m.selected) for c, b in m.coefficients.items()], "feature string, coefficient double, selected boolean")


@query("h6_hsic_lasso_path")
def h6(spark, d):
    m = H.HSICLasso(lam=None, target=(1, 2)).fit(_lasso_frame(spark, d), _LASSO, "p_retailprice")
    return spark.createDataFrame([(c, b, c in m.selected) for c, b in m.coefficients.items()], "feature string, coefficient double, selected boolean")


def _encoded(spark, d, strategy, column="p_brand", y="p_retailprice", names=None, order_by=None, **params):
    df = _part(spark, d).withColumn("hot", (F.col("p_size") > 25).cast("int"))
    enc = E.CategoricalEncoder(strategy, {strategy: params}).fit(df, y, [column], order_by)
    out = enc.transform(df, ["p_partkey"])
    got = enc.get_feature_names()
    if names == "long":
        cells = F.array(*[F.struct(F.lit(n).alias("name"), r(F.col(f"`{n}`"), 8).alias("value")) for n in got])
        return out.select("p_partkey", F.explode(cells).alias("c")).select("p_partkey", "c.name", "c.value").where("value <> 0")
    return out.select("p_partkey", *[r(F.col(f"`{n}`"), 6).alias(f"v{i}") for i, n in enumerate(got)])


_P = f"p AS (SELECT *, (p_size > 25)::INT AS hot FROM {PART})"
_S = f"{_P}, g AS (SELECT avg(p_retailprice) AS mean FROM p), c AS (SELECT p_brand, count(p_retailprice) AS n, avg(p_retailprice) AS m, sum(p_retailprice) AS s FROM p GROUP BY 1)"
_J = "FROM p JOIN c ON p.p_brand IS NOT DISTINCT FROM c.p_brand, g"


@query("e1_onehot", f"WITH {_P} SELECT p_partkey, 'p_type__' || p_type AS name, 1.0::DOUBLE AS value FROM p WHERE p_type IS NOT NULL")
def e1(spark, d):
    return _encoded(spark, d, "onehot", "p_type", names="long")


@query("e2_ordinal", f"WITH {_P}, c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM p WHERE p_brand IS NOT NULL)) SELECT p_partkey, coalesce(k, -1)::DOUBLE AS v0 FROM p LEFT JOIN c ON p.p_brand = c.p_brand")
def e2(spark, d):
    return _encoded(spark, d, "ordinal")


@query("e3_target", f"WITH {_S} SELECT p_partkey, round(mean * (1 - 1 / (1 + exp(-(n - 80.0::DOUBLE)))) + m / (1 + exp(-(n - 80.0::DOUBLE))), 6) AS v0 {_J}")
def e3(spark, d):
    return _encoded(spark, d, "target", smoothing=80.0)


@query("e4_leave_one_out", f"WITH {_S} SELECT p_partkey, round(CASE WHEN n <= 1 THEN mean ELSE (s - mean) / (n - 1 + 1e-6) END, 6) AS v0 {_J}")
def e4(spark, d):
    return _encoded(spark, d, "leave_one_out")


@query("e4_leave_one_out_exact", f"WITH {_S} SELECT p_partkey, round((s - p_retailprice) / (n - 1), 6) AS v0 {_J}")
def e4b(spark, d):
    return E.leave_one_out_exact(_part(spark, d), "p_brand", "p_retailprice").select("p_partkey", r("p_brand__loo_exact").alias("v0"))


@query("e5_catboost", f"""WITH {_P}, o AS (SELECT p_brand, (coalesce(sum(p_retailprice) OVER w, 0) + 0.5) / (count(*) OVER w + 1) AS v FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT p_brand, avg(v) AS v FROM o GROUP BY 1) SELECT p_partkey, round(v, 6) AS v0 FROM p JOIN c ON p.p_brand IS NOT DISTINCT FROM c.p_brand""")
def e5(spark, d):
    return _encoded(spark, d, "catboost", order_by="p_partkey")


@query("e6_james_stein", f"WITH {_S} SELECT p_partkey, round((mean * 5 + m * n) / (5 + n), 6) AS v0 {_J}")
def e6(spark, d):
    return _encoded(spark, d, "james_stein")


@query("e7_woe", f"WITH {_P}, c AS (SELECT p_brand, count(*) FILTER (hot = 1)::DOUBLE AS a, count(*) FILTER (hot = 0)::DOUBLE AS b FROM p GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c) SELECT p_partkey, round(ln(((a + 1) / (ta + 1)) / ((b + 1) / (tb + 1))), 6) AS v0 FROM p JOIN c ON p.p_brand IS NOT DISTINCT FROM c.p_brand, t")
def e7(spark, d):
    return _encoded(spark, d, "woe", y="hot")


@query("e8_count", f"WITH {_P}, c AS (SELECT p_brand, count(*)::DOUBLE AS v0 FROM p GROUP BY 1) SELECT p_partkey, v0 FROM p JOIN c ON p.p_brand IS NOT DISTINCT FROM c.p_brand")
def e8(spark, d):
    return _encoded(spark, d, "count")


@query("e9_frequency", f"WITH {_P}, c AS (SELECT p_brand, round(count(*) / (SELECT count(*) FROM p), 6) AS v0 FROM p GROUP BY 1) SELECT p_partkey, v0 FROM p JOIN c ON p.p_brand IS NOT DISTINCT FROM c.p_brand")
def e9(spark, d):
    return _encoded(spark, d, "frequency")


@query("e10_hashing", f"WITH {_P}, t AS (SELECT p_partkey, md5(coalesce(p_name, '__nan__')) AS h FROM p) SELECT p_partkey, 'p_name__hash_' || (('0x' || substr(h, 1, 8))::BIGINT % 32) AS name, CASE WHEN ('0x' || substr(h, 9, 1))::INT < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS value FROM t")
def e10(spark, d):
    return _encoded(spark, d, "hashing", "p_name", names="long")


@query("e11_binary", f"WITH {_P}, c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM p WHERE p_type IS NOT NULL)) SELECT p_partkey, (coalesce(k, 0) >> 2 & 1)::DOUBLE AS v0, (coalesce(k, 0) >> 1 & 1)::DOUBLE AS v1, (coalesce(k, 0) & 1)::DOUBLE AS v2 FROM p LEFT JOIN c ON p.p_type = c.p_type")
def e11(spark, d):
    return _encoded(spark, d, "binary", "p_type")


@query("e12_helmert", f"WITH {_P}, c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT p_type FROM p WHERE p_type IS NOT NULL)) SELECT p_partkey, 'p_type__helmert_' || i AS name, round(CASE WHEN j < i THEN -1.0::DOUBLE / (i + 1) ELSE (n - i - 1)::DOUBLE / (i + 1) END, 8) AS value FROM p JOIN c ON p.p_type = c.p_type, range(0, 100) t(i) WHERE i < n - 1 AND j <= i")
def e12(spark, d):
    return _encoded(spark, d, "helmert", "p_type", names="long")


@query("e13_rare_grouping", f"WITH {_P}, c AS (SELECT p_brand, count(*) / (SELECT count(*) FROM p) >= 0.04 AS kept FROM p GROUP BY 1) SELECT p_partkey, CASE WHEN kept THEN 'p_brand__top_' || coalesce(p.p_brand, 'None') ELSE 'p_brand__rare' END AS name, 1.0::DOUBLE AS value FROM p JOIN c ON p.p_brand IS NOT DISTINCT FROM c.p_brand")
def e13(spark, d):
    return _encoded(spark, d, "rare_grouping", min_freq=0.04, names="long")


@query("e14_embedding", f"WITH {_P}, c AS (SELECT b, row_number() OVER (ORDER BY count(*) DESC, b) - 1 AS k FROM (SELECT coalesce(p_brand, '__nan__') AS b FROM p) GROUP BY 1) SELECT p_partkey, 'p_brand__embed_' || k AS name, 1.0::DOUBLE AS value FROM p JOIN c ON coalesce(p_brand, '__nan__') = b WHERE k < 4")
def e14(spark, d):
    return _encoded(spark, d, "embedding", names="long")


@query("e15_multi_hash", f"WITH {_P}, x AS (SELECT p_partkey, p_retailprice AS y, h, ('0x' || substr(md5(coalesce(p_name, '__nan__') || ':' || h), 1, 8))::BIGINT % 64 AS b FROM p, range(0, 2) t(h)), s AS (SELECT h, b, sum(y) AS s FROM x GROUP BY 1, 2) SELECT p_partkey, round(max(CASE WHEN x.h = 0 THEN s END), 4) AS v0, round(max(CASE WHEN x.h = 1 THEN s END), 4) AS v1 FROM x JOIN s ON x.h = s.h AND x.b = s.b GROUP BY 1")
def e15(spark, d):
    return rounded(_encoded(spark, d, "multi_hash", "p_name", dim=1, init_scale=0.0), 4)


@query("e16_auto_strategy", f"""WITH l AS (SELECT 'p_brand' AS feature, p_brand AS v FROM {PART} UNION ALL SELECT 'p_type', p_type FROM {PART} UNION ALL SELECT 'p_name', p_name FROM {PART}), c AS (SELECT feature, v, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS share FROM l GROUP BY 1, 2),
s AS (SELECT feature, count(v) AS k, count(v) / sum(n) AS u, coalesce(sum(CASE WHEN share < 0.01 THEN share END), 0) AS rare, coalesce(sum(CASE WHEN v IS NULL THEN share END), 0) AS miss FROM c GROUP BY 1)
SELECT feature, CASE WHEN rare > 0.02 THEN 'rare_grouping' WHEN u > 0.9 THEN 'multi_hash' WHEN miss > 0.2 THEN 'catboost' WHEN k <= 12 THEN 'onehot' WHEN k <= 60 THEN 'catboost' WHEN k <= 200 THEN 'target' ELSE 'multi_hash' END AS strategy FROM s""")
def e16(spark, d):
    from quernel.operators.aggregates import column_survey

    got = [(x["feature"], E.choose(x.asDict(), True)[0]) for x in column_survey(_part(spark, d), ["p_brand", "p_type", "p_name"]).collect()]
    return spark.createDataFrame(got, "feature string, strategy string")


@query("e17_explicit_strategies", f"""SELECT p_partkey, e.v0 AS p_brand__target_mean, c.v0 AS p_type__count FROM ({SQL["e3_target"]}) e JOIN (SELECT p_partkey, v0 FROM {PART} p JOIN (SELECT p_type, count(*)::DOUBLE AS v0 FROM {PART} GROUP BY 1) t ON p.p_type IS NOT DISTINCT FROM t.p_type) c USING (p_partkey)""".replace("80.0::DOUBLE", "10.0::DOUBLE"))
def e17(spark, d):
    df = _part(spark, d)
    return rounded(E.CategoricalEncoder({"p_brand": "target", "p_type": "count"}).fit(df, "p_retailprice", ["p_brand", "p_type"]).transform(df, ["p_partkey"]))


@query("e0_target_by_priority", """WITH g AS (SELECT avg(o_totalprice) AS mean FROM orders), c AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(mean * (1 - 1 / (1 + exp(-(n - 10.0::DOUBLE)))) + m / (1 + exp(-(n - 10.0::DOUBLE))), 4) AS encoded FROM c, g""")
def e0(spark, d):
    o = table(spark, d, "orders")
    enc = E.CategoricalEncoder("target").fit(o, "o_totalprice", ["o_orderpriority"])
    return enc.transform(o, ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_orderpriority__target_mean"), 4).alias("encoded"))


_FOLD = "(SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, CASE WHEN k < (n % 5) * (n // 5 + 1) THEN k // (n // 5 + 1) ELSE n % 5 + (k - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders))"


@query("pp3_out_of_fold", f"""WITH f AS {_FOLD}, b AS (SELECT c, fold, count(*) AS rows, count(y) AS n, sum(y) AS s FROM f GROUP BY 1, 2), o AS (SELECT c, rows, (sum(s) OVER (PARTITION BY c) - s) / (sum(n) OVER (PARTITION BY c) - n) AS oof FROM b)
SELECT c AS category, round(sum(oof * rows) / sum(rows), 4) AS value FROM o GROUP BY 1""")
def pp3(spark, d):
    folded = W.kfold_labels(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 5)
    return rounded(P.oof_mapping(folded, "o_orderpriority", "o_totalprice", "fold"), 4)


@query("pp4_robust_scale", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, round((o_totalprice - m) / (b - a), 6) AS x FROM orders, q")
def pp4(spark, d):
    return P.robust_scaled(table(spark, d, "orders"), ["o_totalprice"]).select("o_orderkey", r("o_totalprice").alias("x"))


@query("pp5_standard_scale", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS x, round(o_totalprice, 2) AS back FROM orders, s")
def pp5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    s = P.Scaler("standard").fit(o, ["o_totalprice"])
    z = s.transform(o).withColumn("x", F.col("o_totalprice"))
    return s.inverse(z).select("o_orderkey", r("x").alias("x"), r("o_totalprice", 2).alias("back"))


@query("pp6_impute_standardize", """WITH a AS (SELECT coalesce(CASE WHEN p_size <= 40 THEN p_size END, (SELECT avg(p_size) FROM part WHERE p_size <= 40))::DOUBLE AS x FROM part) SELECT round((x - (SELECT avg(x) FROM a)) / (SELECT stddev_pop(x) FROM a), 6) AS x FROM a""")
def pp6(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") <= 40, F.col("p_size").cast("double")).alias("x"))
    return rounded(P.impute_and_standardize(p, ["x"]))


def _oof(column: str) -> str:
    return f"""(SELECT c, round(sum(oof * rows) / sum(rows), 4) AS value FROM (SELECT c, rows, (sum(s) OVER (PARTITION BY c) - s) / (sum(n) OVER (PARTITION BY c) - n) AS oof FROM (
  SELECT {column} AS c, fold, count(*) AS rows, count(y) AS n, sum(y) AS s FROM f GROUP BY 1, 2)) GROUP BY 1)"""


_SCALED = ", ".join(f"round(({c} - quantile_cont({c}, 0.5) OVER ()) / (quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ()), 6) AS {c}" for c in ("o_custkey", "o_orderkey"))


@query("pp1_preprocessor", f"""WITH f AS {_FOLD.replace("o_orderpriority AS c, ", "o_custkey, o_orderstatus, o_orderpriority, ").replace("o_orderdate, o_orderkey", "o_orderkey")}
SELECT {_SCALED}, a.value AS o_orderstatus_te, b.value AS o_orderpriority_te FROM f JOIN {_oof("o_orderstatus")} a ON f.o_orderstatus = a.c JOIN {_oof("o_orderpriority")} b ON f.o_orderpriority = b.c""")
def pp1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    pre = P.Preprocessor().fit(o.select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey"), "o_totalprice", ["o_orderkey"])
    out = pre.transform(o)
    return out.select(*[r(c, 4 if c.endswith("_te") else 6).alias(c) for c in out.columns])


_G1 = "SELECT event_id, coalesce(k, n) AS idx FROM events LEFT JOIN (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS k FROM events WHERE event_type <> 'click' GROUP BY 1) g ON events.event_type = g.event_type, (SELECT count(DISTINCT event_type) AS n FROM events WHERE event_type <> 'click')"


@query("g1_group_index", _G1)
def g1(spark, d):
    from quernel.operators.additive import GroupIndex

    e = table(spark, d, "events")
    gi = GroupIndex().fit(e.where("event_type <> 'click'"), "event_type", "event_id")
    return gi.transform(e, "event_type", "idx").select("event_id", F.col("idx").cast("long").alias("idx"))
