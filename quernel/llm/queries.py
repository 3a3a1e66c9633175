"""One query per operator over its whole table, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.cap_filters import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.simhash_trie import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernel.llm.kdtree_topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_count_min_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.substring_dedup import dedup_windows

    return dedup_windows(_table(spark, sf_dir, "documents"))


def op7_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernel.llm.line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.source_mixing import mix_digest

    return mix_digest(_table(spark, sf_dir, "documents"))


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.bm25_packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernel.llm.ordinal_quality import grade, scored, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), grade().alias("grade"))
    return scored(docs, train(docs, ratings)).select("doc_id", "expected_grade", "tail_probability", "keep")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.license_scan import document_paths, scan

    return scan(document_paths(_table(spark, sf_dir, "documents")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernel.llm.html_text import page_texts

    return page_texts(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

#: Windows of three content lines, or of one or two with 50 words; a line goes if a window over it stands at an earlier position too.
_OP7 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
content AS (
  SELECT *, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT doc_id, i, trim(line, {_BLANK}) AS t FROM lines) WHERE t <> ''),
near AS (
  SELECT doc_id, i, t, n, lead(i, 1) OVER w AS i1, lead(t, 1) OVER w AS t1, lead(n, 1) OVER w AS n1,
         lead(i, 2) OVER w AS i2, lead(t, 2) OVER w AS t2
  FROM content WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
windows AS (
  SELECT doc_id, i AS first, i AS last, t AS whole FROM near WHERE n >= 50
  UNION ALL
  SELECT doc_id, i, i1, t || chr(10) || t1 FROM near WHERE n + n1 >= 50
  UNION ALL
  SELECT doc_id, i, i2, t || chr(10) || t1 || chr(10) || t2 FROM near WHERE i2 IS NOT NULL),
later AS (
  SELECT doc_id, first, last FROM (
    SELECT *, row_number() OVER (PARTITION BY whole ORDER BY doc_id, first) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, md5(k.text) AS kept_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _op2() -> str:
    from quernel.llm.license_scan import COPYRIGHT, THRESHOLD, line_caps, template_rows

    caps = line_caps()
    values = ", ".join(f"({i}, '{name}', '{t}', {n}, {caps[i]})" for i, name, t, n in template_rows())
    split = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    ends = ", ".join(f"max(j) OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {cap} FOLLOWING) - 1" for cap in sorted(set(caps)))
    return f"""
WITH templates(template, license, term, n, cap) AS (VALUES {values}),
files AS (
  SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || (doc_id // 100) AS dir, text FROM documents),
paths AS (SELECT *, dir || '/' || doc_id || '.txt' AS path FROM files),
raw AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS body
  FROM files WHERE text IS NOT NULL),
lines AS (
  SELECT *, coalesce(sum(len(terms)) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT doc_id, line, terms, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS j
        FROM (SELECT doc_id, line, {split.format("body")} AS terms FROM raw WHERE NOT regexp_matches(lower(body), '{COPYRIGHT}')
              UNION ALL SELECT DISTINCT doc_id, 1000000000, ['end'] FROM raw)
        WHERE len(terms) > 0)),
runs AS (
  SELECT doc_id, line, j, unnest([0, {", ".join(map(str, sorted(set(caps))))}]) AS cap, greatest(j, unnest([j, {ends}])) AS e
  FROM lines QUALIFY line < 1000000000),
started AS (SELECT DISTINCT l.doc_id, l.j, t.cap FROM (SELECT doc_id, j, unnest(terms) AS term FROM lines) l JOIN templates t ON l.term = t.term),
units AS (
  SELECT r.doc_id, r.cap, r.line, last.line AS last, l.terms
  FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.j BETWEEN r.j AND r.e JOIN lines last ON last.doc_id = r.doc_id AND last.j = r.e
  WHERE r.cap = 0 OR (r.doc_id, r.j, r.cap) IN (SELECT (doc_id, j, cap) FROM started)
  UNION ALL
  SELECT doc_id, 0, 0, 0, terms FROM lines WHERE line < 1000000000),
counts AS (SELECT doc_id, cap, line, last, term, count(*) AS n FROM (SELECT doc_id, cap, line, last, unnest(terms) AS term FROM units) GROUP BY ALL),
total AS (SELECT count(*) AS files FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({split.format("text")}) AS term FROM files WHERE text IS NOT NULL) GROUP BY term),
idf AS (
  SELECT t.term, ln((files + 1) / (coalesce(df, 0) + 1)::DOUBLE) + 1 AS idf
  FROM (SELECT DISTINCT term FROM templates) t LEFT JOIN df ON t.term = df.term, total),
tw AS (
  SELECT template, license, cap, t.term, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY template)) AS tw
  FROM templates t JOIN idf ON t.term = idf.term),
weighted AS (
  SELECT c.*, idf, n * coalesce(idf, ln(files + 1.0::DOUBLE) + 1) AS w
  FROM counts c LEFT JOIN idf ON c.term = idf.term, total),
norms AS (SELECT doc_id, cap, line, last, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY ALL),
dots AS (
  SELECT doc_id, weighted.cap, line, last, template, license, sum(w * tw) AS dot
  FROM weighted JOIN tw ON weighted.term = tw.term AND (weighted.cap = 0 OR weighted.cap = tw.cap) GROUP BY ALL),
matches AS (
  SELECT d.doc_id, d.line, d.last, template, license, round(dot / norm, 6) AS cosine
  FROM dots d JOIN norms m ON d.doc_id = m.doc_id AND d.cap = m.cap AND d.line = m.line AND d.last = m.last WHERE round(dot / norm, 6) >= {THRESHOLD}),
best AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id, line, last ORDER BY cosine DESC, template) = 1),
own AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, line, last) = 1),
of_dir AS (
  SELECT dir, path, license, cosine FROM best JOIN paths USING (doc_id) WHERE line = 0
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
heirs AS (
  SELECT p.doc_id, o.license, o.cosine, o.path FROM paths p JOIN of_dir o ON p.dir = o.dir OR starts_with(p.dir, o.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY length(o.dir) DESC) = 1)
SELECT p.doc_id, p.path, coalesce(own.license, h.license) AS license,
       CASE WHEN own.license IS NOT NULL THEN 'notice' WHEN h.license IS NOT NULL THEN 'inherited' END AS origin,
       coalesce(own.cosine, h.cosine) AS cosine,
       CASE WHEN own.license IS NOT NULL THEN p.path ELSE h.path END AS found_in
FROM paths p LEFT JOIN own ON p.doc_id = own.doc_id LEFT JOIN heirs h ON p.doc_id = h.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _op2(), "op7_line_winnowing": _OP7}
