"""Queries for projections, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions import scalars as S
from quernel.functions.ordered import exact_quantiles, positions
from quernel.operators import aggregates as A
from quernel.operators import metrics as M
from quernel.operators import preprocess as P
from quernel.operators import splits as W
from quernel.operators.hsic import kernel_row_sums
from quernel.plans.registry import query, r, rounded, table

CUT = "1996-01-01"
CUT2 = "1997-06-01"


def _part(spark: SparkSession, d: str) -> DataFrame:
    """part with nulls: brand 'Brand#13' and every seventh type are null."""
    return table(spark, d, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#13"))).withColumn("p_type", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")))


PART = "(SELECT p_partkey, p_name, nullif(p_brand, 'Brand#13') AS p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS p_type, p_size, p_retailprice FROM part)"


@query("pf1_project", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def pf1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("pf2_date_ranges", f"""SELECT part, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '{CUT}' THEN 'train' WHEN l_shipdate < TIMESTAMP '{CUT2}' THEN 'valid' ELSE 'test' END AS part, l_quantity FROM lineitem) GROUP BY part""")
def pf2(spark, d):
    parts = S.between_dates(table(spark, d, "lineitem"), "l_shipdate", CUT, CUT2)
    out = None
    for name, p in zip(("train", "valid", "test"), parts, strict=True):
        one = p.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).select(F.lit(name).alias("part"), "n", "quantity").where("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


@query("pf3_type_partition", "SELECT event_id, event_type, value FROM events WHERE upper(event_type) = 'CLICK'")
def pf3(spark, d):
    return S.partition_rows(table(spark, d, "events"), "Click", "event_type").select("event_id", "event_type", "value")


@query("pf4_drop_nulls", f"SELECT p_partkey, p_brand, p_type FROM {PART} WHERE p_brand IS NOT NULL AND p_type IS NOT NULL")
def pf4(spark, d):
    return _part(spark, d).na.drop(subset=["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")


_NULLED = "(SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_size::DOUBLE END AS v FROM part)"


@query("pf5_fill_nulls", f"""SELECT p_partkey, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM {_NULLED})) AS by_median,
  round(coalesce(v, (SELECT avg(v) FROM {_NULLED})), 6) AS by_mean, coalesce(v, 0) AS by_zero, coalesce(v::INT::VARCHAR, '__nan__') AS by_token FROM {_NULLED}""")
def pf5(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size").cast("double")).alias("v"))
    fill = rows.agg(F.avg("v").alias("a")).crossJoin(exact_quantiles(rows, "v", [0.5]).select(F.get("q", F.lit(0)).alias("m")))  # one row each
    v = F.col("v")
    return rows.crossJoin(F.broadcast(fill)).select("p_partkey", F.coalesce(v, "m").alias("by_median"), r(F.coalesce(v, "a")).alias("by_mean"), F.coalesce(v, F.lit(0.0)).alias("by_zero"), F.coalesce(v.cast("int").cast("string"), F.lit("__nan__")).alias("by_token"))


@query("pf6_missing_ratio", f"""SELECT feature, round(ratio, 6) AS ratio, ratio > 0.1 AS dropped FROM (
  SELECT 'p_brand' AS feature, avg((p_brand IS NULL)::INT) AS ratio FROM {PART} UNION ALL SELECT 'p_type', avg((p_type IS NULL)::INT) FROM {PART}
  UNION ALL SELECT 'p_size', avg((p_size IS NULL)::INT) FROM {PART})""")
def pf6(spark, d):
    t = P.missing_ratios(_part(spark, d), ["p_brand", "p_type", "p_size"])
    return t.select("feature", r("ratio").alias("ratio"), (F.col("ratio") > 0.1).alias("dropped"))


@query("pf7_constant_columns", f"""SELECT feature, n, n <= 1 AS dropped FROM (SELECT 'p_brand' AS feature, count(DISTINCT p_brand) + max((p_brand IS NULL)::INT) AS n FROM {PART}
  UNION ALL SELECT 'p_size', count(DISTINCT p_size) + max((p_size IS NULL)::INT) FROM {PART} UNION ALL SELECT 'one', 1)""")
def pf7(spark, d):
    t = P.distinct_with_null(_part(spark, d).withColumn("one", F.lit(1)), ["p_brand", "p_size", "one"])
    return t.select("feature", "n", (F.col("n") <= 1).alias("dropped"))


@query("pf8_vif", """WITH g AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_extendedprice) AS ab, sum(l_extendedprice * l_extendedprice) AS bb FROM lineitem)
SELECT 'l_quantity' AS feature, round(aa * bb / (aa * bb - ab * ab), 4) AS vif FROM g UNION ALL SELECT 'l_extendedprice', round(aa * bb / (aa * bb - ab * ab), 4) FROM g""")
def pf8(spark, d):
    v = P.vif_table(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame(sorted(v.items()), "feature string, vif double").select("feature", r("vif", 4).alias("vif"))


@query("pf10_binary_columns", """SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS n, false AS binary_target FROM lineitem
  UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), count(DISTINCT l_linenumber) <= 2 FROM lineitem
  UNION ALL SELECT 'quality', count(DISTINCT quality), count(DISTINCT quality) <= 2 FROM labels""")
def pf10(spark, d):
    out = None
    for name, column in (("lineitem", "l_returnflag"), ("lineitem", "l_linenumber"), ("labels", "quality")):
        df = table(spark, d, name)
        text = df.schema[column].dataType.simpleString() == "string"
        one = df.agg(F.countDistinct(column).alias("n")).select(F.lit(column).alias("feature"), "n", (F.lit(not text) & (F.col("n") <= 2)).alias("binary_target"))
        out = one if out is None else out.unionByName(one)
    return out


@query("pf11_class_weights", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM lineitem")
def pf11(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.class_weight((F.col("l_returnflag") == "R").cast("int"), 3, 1).alias("weight"))


@query("pf12_threshold", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS label FROM lineitem")
def pf12(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.above(F.col("l_discount"), 0.05).alias("label"))


@query("pf13_residual", "SELECT o_orderkey, round(o_totalprice - o_custkey * 10.0::DOUBLE, 4) AS residual FROM orders")
def pf13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r(F.col("o_totalprice") - F.col("o_custkey") * 10.0, 4).alias("residual"))


@query("pf14_group_key", "SELECT l_returnflag || '_' || l_linestatus AS key, count(*) AS n FROM lineitem GROUP BY 1")
def pf14(spark, d):
    return table(spark, d, "lineitem").groupBy(S.group_key("l_returnflag", "l_linestatus").alias("key")).agg(F.count("*").alias("n"))


@query("pf15_bins", """WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, [quantile_cont(p_retailprice, q) FOR q IN [0.2]] AS _u, quantile_cont(p_retailprice, 0.2) AS a, quantile_cont(p_retailprice, 0.4) AS b, quantile_cont(p_retailprice, 0.6) AS c, quantile_cont(p_retailprice, 0.8) AS e FROM part)
SELECT p_partkey, least(floor((p_retailprice - lo) / ((hi - lo) / 5)), 4)::BIGINT AS even_bin, CASE WHEN p_retailprice <= a THEN 0 WHEN p_retailprice <= b THEN 1 WHEN p_retailprice <= c THEN 2 WHEN p_retailprice <= e THEN 3 ELSE 4 END::BIGINT AS quantile_bin,
  ((row_number() OVER (ORDER BY p_partkey) - 1) * 5 // count(*) OVER ())::BIGINT AS position_bin FROM part, s""".replace("[quantile_cont(p_retailprice, q) FOR q IN [0.2]] AS _u, ", ""))
def pf15(spark, d):
    part = table(spark, d, "part")
    s = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    q = exact_quantiles(part, "p_retailprice", [x / 5 for x in range(6)]).first()["q"]
    n = part.count()
    rows = positions(part, ["p_partkey"], "pos").crossJoin(F.broadcast(s))
    return rows.select("p_partkey", S.equal_width_bin(F.col("p_retailprice"), F.col("lo"), F.col("hi"), 5).alias("even_bin"), S.bin_by_breaks(F.col("p_retailprice"), q).alias("quantile_bin"), F.floor((F.col("pos") - 1) * 5 / n).alias("position_bin"))


@query("pf16_to_time", """SELECT t, try_cast(t AS TIMESTAMP) AS ts FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'no time' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS t FROM orders)""")
def pf16(spark, d):
    t = F.when(F.col("o_orderkey") % 5 == 0, "no time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select(t.alias("t")).select("t", S.to_time(F.col("t")).cast("timestamp_ntz").alias("ts"))


@query("pf17_sample")
def pf17(spark, d):
    return S.sampled(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 5000)[0]


@query("pf18_fingerprint")
def pf18(spark, d):
    return S.fingerprint(table(spark, d, "orders"))


@query("pf19_keys", "SELECT s_suppkey, md5('{\"s_suppkey\":' || s_suppkey || ',\"s_nationkey\":' || s_nationkey || '}') AS json_key, s_suppkey || '|' || s_nationkey AS cache_key FROM supplier")
def pf19(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.json_md5("s_suppkey", "s_nationkey").alias("json_key"), S.cache_key("s_suppkey", "s_nationkey").alias("cache_key"))


@query("j1_left_join", """WITH drift AS (SELECT event_type AS feature, avg(value) AS psi FROM events GROUP BY 1), imp AS (SELECT event_type AS feature, max(value) AS importance FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT drift.feature, round(psi, 6) AS psi, round(importance, 6) AS importance FROM drift LEFT JOIN imp ON drift.feature = imp.feature""")
def j1(spark, d):
    e = table(spark, d, "events")
    drift = e.groupBy(F.col("event_type").alias("feature")).agg(r(F.avg("value")).alias("psi"))
    imp = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("feature")).agg(r(F.max("value")).alias("importance"))
    return drift.join(imp, "feature", "left")


@query("j2_map_lookup", f"""WITH m AS (SELECT p_brand, avg(p_retailprice) AS v FROM {PART} WHERE p_size < 25 GROUP BY 1)
SELECT p_partkey, round(coalesce(v, -1.0::DOUBLE), 6) AS v FROM {PART} p LEFT JOIN m ON p.p_brand IS NOT DISTINCT FROM m.p_brand""")
def j2(spark, d):
    part = _part(spark, d)
    m = part.where("p_size < 25").groupBy(F.col("p_brand").alias("b")).agg(F.avg("p_retailprice").alias("v"))
    return part.join(m, F.col("p_brand").eqNullSafe(F.col("b")), "left").select("p_partkey", r(F.coalesce("v", F.lit(-1.0))).alias("v"))


@query("j3_semi_flag", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS flag FROM customer")
def j3(spark, d):
    keys = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).distinct()
    return table(spark, d, "customer").join(keys, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("flag"))


@query("j4_aligned_join", "WITH a AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) SELECT a.p, a.n, coalesce(b.n, 0) AS m FROM a LEFT JOIN b ON a.p = b.p")
def j4(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    b = o.where("o_totalprice > 400000").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("m"))
    return a.join(b, "p", "left").select("p", "n", F.coalesce("m", F.lit(0)).alias("m"))


@query("j5_column_concat", "SELECT s_suppkey, s_nationkey, round(s_acctbal / 2, 4) AS half, s_nationkey % 2 AS odd FROM supplier")
def j5(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", r(F.col("s_acctbal") / 2, 4).alias("half"), (F.col("s_nationkey") % 2).alias("odd"))


@query("j6_kernel_pairs", "SELECT a.s_nationkey AS g, round(sum(exp(-power(a.s_acctbal - b.s_acctbal, 2) / 2e6)), 4) AS k FROM supplier a, supplier b GROUP BY 1")
def j6(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("x"))
    sums = kernel_row_sums(s, ["x"], [1e6]).select(F.get("v", F.lit(0)).alias("x"), F.get("k", F.lit(0)).alias("k"))
    return s.join(sums, "x").groupBy("g").agg(r(F.sum("k"), 4).alias("k"))


_TOP = "(SELECT l_linenumber AS fold, l_partkey AS item FROM (SELECT l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_linenumber ORDER BY sum(l_quantity) DESC, l_partkey) AS k FROM lineitem GROUP BY 1, 2) WHERE k <= 500)"


@query("j7_fold_jaccard", f"""WITH t AS {_TOP}, p AS (SELECT a.fold AS a, b.fold AS b, count(*) AS n FROM t a JOIN t b ON a.item = b.item AND a.fold < b.fold GROUP BY 1, 2), s AS (SELECT fold, count(*) AS n FROM t GROUP BY 1), f AS (SELECT count(*) AS k FROM s)
SELECT round(sum(p.n / (x.n + y.n - p.n)::DOUBLE) / any_value(k * (k - 1) / 2), 6) AS jaccard FROM p JOIN s x ON p.a = x.fold JOIN s y ON p.b = y.fold, f""")
def j7(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_linenumber", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    top = sums.withColumn("k", F.row_number().over(Window.partitionBy("l_linenumber").orderBy(F.desc("q"), "l_partkey"))).where("k <= 500")
    return rounded(A.jaccard_mean(top, "l_linenumber", "l_partkey"))


@query("ag1_column_survey", f"""WITH l AS (SELECT 'p_brand' AS feature, p_brand AS value FROM {PART} UNION ALL SELECT 'p_type', p_type FROM {PART} UNION ALL SELECT 'p_name', p_name FROM {PART}),
c AS (SELECT feature, value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS share FROM l GROUP BY 1, 2)
SELECT feature, count(value) AS cardinality, round(count(value) / sum(n), 6) AS unique_ratio, round(coalesce(sum(CASE WHEN share < 0.02 THEN share END), 0), 6) AS rare_share,
  round(coalesce(sum(CASE WHEN value IS NULL THEN share END), 0), 6) AS missing_rate, round(max(share), 6) AS most_common_freq FROM c GROUP BY 1""")
def ag1(spark, d):
    return rounded(A.column_survey(_part(spark, d), ["p_brand", "p_type", "p_name"], 0.02))


@query("ag2_group_stats", f"SELECT p_brand, round(avg(p_retailprice), 4) AS mean, count(p_retailprice) AS n, round(sum(p_retailprice), 2) AS total FROM {PART} GROUP BY 1")
def ag2(spark, d):
    return A.group_stats(_part(spark, d), "p_brand", "p_retailprice").select("p_brand", r("mean", 4).alias("mean"), "n", r("total", 2).alias("total"))


@query("ag3_value_counts", f"SELECT p_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {PART} GROUP BY 1")
def ag3(spark, d):
    return rounded(A.value_counts(_part(spark, d), "p_type"))


@query("ag4_group_summary", 'SELECT event_type AS "group", round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value, count(value) AS count, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci95 FROM events GROUP BY 1')
def ag4(spark, d):
    return rounded(A.group_summary(table(spark, d, "events"), "event_type", "value"))


@query("ag5_group_coverage", f"""SELECT "group", split, count, round_even(count / sum(count) OVER (PARTITION BY split), 4) AS share FROM (SELECT l_returnflag AS "group", CASE WHEN l_shipdate < TIMESTAMP '{CUT}' THEN 'train' WHEN l_shipdate < TIMESTAMP '{CUT2}' THEN 'valid' ELSE 'test' END AS split, count(*) AS count FROM lineitem GROUP BY 1, 2)""")
def ag5(spark, d):
    a, b, c = S.between_dates(table(spark, d, "lineitem"), "l_shipdate", CUT, CUT2)
    return A.group_coverage({"train": a, "valid": b, "test": c}, "l_returnflag")


@query("ag7_time_buckets", """WITH f AS (SELECT date_trunc('day', min(ts)) AS day0, max(ts) AS last FROM events), spine AS (SELECT day0 + to_days(7 * k) AS bucket, k FROM f, range(0, 1000) t(k) WHERE day0 + to_days((7 * k)::INT) <= last)
SELECT bucket, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM spine, f LEFT JOIN events ON ts >= bucket AND ts < bucket + INTERVAL 7 DAY GROUP BY bucket""".replace("to_days(7 * k)", "to_days((7 * k)::INT)").replace("spine, f LEFT", "spine LEFT"))
def ag7(spark, d):
    return rounded(A.time_buckets(table(spark, d, "events"), "ts", "value", 7))


@query("ag8_top_groups", 'SELECT user_id AS "group", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 10')
def ag8(spark, d):
    return rounded(A.top_groups(table(spark, d, "events"), "user_id", "value"))


@query("ag9_histogram", "SELECT k AS bin, (k * 10)::DOUBLE AS low, (k * 10 + 10)::DOUBLE AS high, count(l_quantity) AS n, round(count(l_quantity) / sum(count(l_quantity)) OVER () / 10, 8) AS density FROM range(0, 4) t(k) LEFT JOIN lineitem ON l_quantity >= k * 10 AND (l_quantity < k * 10 + 10 OR (k = 3 AND l_quantity = 40)) GROUP BY k")
def ag9(spark, d):
    return rounded(A.histogram(table(spark, d, "lineitem"), "l_quantity", [0, 10, 20, 30, 40], True), 8)


@query("ag10_quantiles", "SELECT feature, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90 FROM (SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1")
def ag10(spark, d):
    q = A.quantiles(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], [0.25, 0.5, 0.9])
    return rounded(q.select("feature", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q90"))]))


_BIN = "(SELECT (l_returnflag = 'R')::INT AS y, (l_discount >= 0.05)::INT AS p, l_extendedprice / 1000 AS s FROM lineitem)"


def _binary(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("p"), (F.col("l_extendedprice") / 1000).alias("s"))


@query("ag11_confusion", f"""WITH c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM {_BIN})
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def ag11(spark, d):
    return rounded(M.confusion(_binary(spark, d), "y", "p"))


@query("ag12_auc", f"""WITH k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM {_BIN})
SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)), 8) AS auc FROM k""")
def ag12(spark, d):
    return rounded(M.auc(_binary(spark, d), "y", "s"), 8)


@query("ag12_roc_points", """WITH c AS (SELECT l_discount AS threshold, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1)
SELECT threshold, round(sum(n) OVER w / sum(n) OVER (), 8) AS fpr, round(sum(p) OVER w / sum(p) OVER (), 8) AS tpr FROM c WINDOW w AS (ORDER BY threshold DESC)""")
def ag12b(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_discount")
    return M.roc_points(df, "y", "l_discount").select("threshold", r("fpr", 8).alias("fpr"), r("tpr", 8).alias("tpr"))


_REG = "(SELECT l_returnflag AS stage, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"


def _regression(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


@query("ag13_regression_metrics", f"SELECT round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 8) AS r2, round(quantile_cont(abs(y - p), 0.5), 4) AS medae FROM {_REG}")
def ag13(spark, d):
    e = M.evaluate(_regression(spark, d), "y", "p")
    return e.select(r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"), r("r2", 8).alias("r2"), r("medae", 4).alias("medae"))


@query("ag14_stage_metrics", f"SELECT stage, round(avg((y - p) ** 2), 1) AS mse, round(avg(p - y), 4) AS bias FROM {_REG} GROUP BY 1")
def ag14(spark, d):
    e = M.evaluate(_regression(spark, d), "y", "p", ("mse", "bias"), ["stage"])
    return e.select("stage", r("mse", 1).alias("mse"), r("bias", 4).alias("bias"))


@query("ag15_spearman", """WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 8) AS spearman FROM k""")
def ag15(spark, d):
    return rounded(M.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 8)


@query("ag16_jaccard_one_fold", """WITH f AS (SELECT s_nationkey AS fold, count(*) AS n FROM supplier GROUP BY 1), t AS (SELECT DISTINCT s_nationkey % 5 AS fold, s_nationkey AS item FROM supplier WHERE s_nationkey % 5 = 3),
p AS (SELECT a.fold AS i, b.fold AS j, (SELECT count(*) FROM t x JOIN t y USING (item) WHERE x.fold = a.fold AND y.fold = b.fold)::DOUBLE / (SELECT count(DISTINCT item) FROM t WHERE fold IN (a.fold, b.fold)) AS s FROM (SELECT DISTINCT fold FROM t) a JOIN (SELECT DISTINCT fold FROM t) b ON a.fold < b.fold)
SELECT coalesce(avg(s), CASE WHEN (SELECT count(DISTINCT fold) FROM t) = 1 THEN 1.0::DOUBLE END) AS jaccard, (SELECT count(*) FROM t) AS items FROM p""")
def ag16(spark, d):
    t = table(spark, d, "supplier").where("s_nationkey % 5 = 3").select((F.col("s_nationkey") % 5).alias("fold"), F.col("s_nationkey").alias("item")).distinct()
    return A.jaccard_mean(t, "fold", "item").crossJoin(t.agg(F.count("*").alias("items")))  # one row each


@query("ag17_mean_abs", "SELECT feature, round(avg(abs(v)), 6) AS importance FROM (SELECT 'c_acctbal' AS feature, c_acctbal AS v FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey - 12 FROM customer) GROUP BY 1")
def ag17(spark, d):
    return rounded(A.mean_abs(table(spark, d, "customer").select("c_acctbal", (F.col("c_nationkey") - 12).alias("c_nationkey")), ["c_acctbal", "c_nationkey"]))


@query("ag18_ranges", "SELECT feature, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM (SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1")
def ag18(spark, d):
    return rounded(A.column_ranges(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]))


@query("ag18_largest_groups", 'SELECT o_orderpriority AS "group", count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4')
def ag18b(spark, d):
    return A.largest_groups(table(spark, d, "orders"), "o_orderpriority")


@query("ag19_describe", "SELECT event_type AS feature, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def ag19(spark, d):
    return rounded(A.describe_importance(table(spark, d, "events"), "event_type", "value"))


@query("ag20_fold_means", "SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1")
def ag20(spark, d):
    return rounded(A.fold_means(table(spark, d, "events").select(F.col("event_type").alias("metric"), "value")))


@query("w2_chronological_split", "SELECT split, count(*) AS n, min(o_orderkey) AS lo, round(sum(o_totalprice), 2) AS total FROM (SELECT *, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders)) GROUP BY 1")
def w2(spark, d):
    rows = W.chronological_labels(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"])
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("w3_kfold", "SELECT o_orderkey, CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1) ELSE n % 7 + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END::INT AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)")
def w3(spark, d):
    return W.kfold_labels(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 7).select("o_orderkey", "fold")


@query("w4_expanding_folds", "SELECT o_orderkey, CASE WHEN k < n - 5 * (n // 6) THEN 0 ELSE 1 + (k - (n - 5 * (n // 6))) // (n // 6) END::INT AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)")
def w4(spark, d):
    return W.expanding_labels(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "fold")


@query("pf17_sample_size", "SELECT least(count(*), 5000) AS n, count(*) > 5000 AS sampled FROM lineitem")
def pf17b(spark, d):
    rows, cut = S.sampled(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), 5000)
    return rows.agg(F.count("*").alias("n"), F.lit(cut).alias("sampled"))


@query("pf9_matching_columns", "SELECT column_name AS name FROM (DESCRIBE lineitem) WHERE lower(column_name) LIKE '%date%' OR lower(column_name) LIKE '%key%'")
def pf9(spark, d):
    columns = table(spark, d, "lineitem").columns
    return spark.createDataFrame([(c,) for c in [*S.matching_columns(columns, "DATE"), *S.matching_columns(columns, "Key")]], "name string")


@query("sp4_split_sizes", """SELECT o_orderstatus, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part, count(*) AS n
FROM (SELECT o_orderstatus, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)) GROUP BY 1, 2""")
def sp4b(spark, d):
    train, test = W.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.distinct().groupBy("o_orderstatus", "part").agg(F.count("*").alias("n"))


@query("w5_stratified_folds", "SELECT l_returnflag, (k % 5)::INT AS fold, count(*) AS n FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS k FROM lineitem) GROUP BY 1, 2")
def w5(spark, d):
    return W.stratified_folds(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag").groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"))


@query("w5_group_folds")
def w5b(spark, d):
    return W.group_folds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query("sp4_stratified_split")
def sp4(spark, d):
    train, test = W.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("w6_share_of_total", "SELECT o_orderstatus, o_orderpriority, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2")
def w6(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return n.select("o_orderstatus", "o_orderpriority", r(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus"))).alias("share"))


@query("w7_average_ranks", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rk FROM lineitem")
def w7(spark, d):
    from quernel.functions.ordered import average_ranks

    return average_ranks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "rk").select("l_orderkey", "l_linenumber", "rk")


@query("t1_sorted", "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier")
def t1(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (-F.col("s_acctbal")).alias("_d"))
    return positions(s, ["_d", "s_suppkey"], "k").select("s_suppkey", "s_acctbal", "k").orderBy("k")


@query("t2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def t2(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("t4_bottom_percent", "SELECT p_name, m, k <= greatest(1, ceil(0.1 * n)) AS removed FROM (SELECT p_name, round(avg(p_retailprice), 4) AS m, row_number() OVER (ORDER BY avg(p_retailprice), p_name) AS k, count(*) OVER () AS n FROM part GROUP BY 1)")
def t4(spark, d):
    m = table(spark, d, "part").groupBy("p_name").agg(F.avg("p_retailprice").alias("x"))
    n = m.count()
    return positions(m, ["x", "p_name"], "k").select("p_name", r("x", 4).alias("m"), (F.col("k") <= max(1, -(-n // 10))).alias("removed"))


@query("u1_union_all", "SELECT 'customer' AS side, c_nationkey AS nation, round(c_acctbal, 2) AS bal FROM customer UNION ALL SELECT 'supplier', s_nationkey, round(s_acctbal, 2) FROM supplier")
def u1(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"), r("c_acctbal", 2).alias("bal"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation"), r("s_acctbal", 2).alias("bal"))
    return a.unionByName(b)


@query("u2_difference", "SELECT DISTINCT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A'")
def u2(spark, d):
    t = table(spark, d, "lineitem")
    return t.where("l_returnflag = 'R'").select("l_partkey", "l_quantity").distinct().subtract(t.where("l_returnflag = 'A'").select("l_partkey", "l_quantity"))
