import numpy as np

import corpus_pipeline as cp
from quernel.llm import queries as q
from quernel.llm.bm25_packing import Encoder, public_files
from tests.llm.test_operators import DOCS, brute_lines, odd_rows
from tests.llm.test_slices import brute_similar


def test_stages_follow_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    lined = cp.STAGES[1][1](spark, kept, sf)
    want = sorted(((d, t) for d, t, _, gone in brute_lines(rows) if gone == 0 or t.split()), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in lined.collect()), key=str) == want
    near = cp.STAGES[2][1](spark, lined, sf)
    assert sorted(r["doc_id"] for r in near.collect()) == brute_similar(want)  # five words, similarity 0.8: the stage's rule
    mixed = cp.STAGES[3][1](spark, near, sf)
    assert mixed.columns == docs.columns
    words, taken = (sum(len(r["text"].encode().split()) for r in x.collect()) for x in (near, mixed))
    assert abs(taken - 1.5 * words) < 0.02 * words
    pieces = cp.STAGES[4][1](spark, mixed, sf).toPandas()
    encode = Encoder(*public_files())
    assert pieces.length.sum() == sum(len(encode(r["text"])) for r in mixed.collect())
    total = pieces.groupby("sequence_id").length.sum().to_numpy()
    assert total.max() <= 1024 and (np.bitwise_count(total) == 1).all()


def _odd(spark):
    """Nulls in every column, empty, blank, long and repeated texts, and columns whose names the stages use themselves."""
    rows = [(i, t, None if k % 5 == 0 else "en", s, None if t is None else len(t), 7, "x") for k, (i, t, s) in enumerate(odd_rows())]
    return spark.createDataFrame(rows, DOCS + ", key_ long, component_id string")


def test_stages_on_odd_rows(spark, sf):
    odd = _odd(spark)
    columns = list(cp.COLUMNS)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    kept = cp.quality(spark, odd, sf)
    assert kept.columns == columns and kept.count() <= odd.count()
    lined = cp.lines(spark, odd, sf)
    want = sorted(((d, t) for d, t, _, gone in brute_lines(rows) if gone == 0 or t.split()), key=str)
    assert lined.columns == columns and sorted(((r["doc_id"], r["text"]) for r in lined.collect()), key=str) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lined.collect())
    near = cp.near_duplicates(spark, odd, sf)
    known = [(d, t) for d, t in rows if d is not None]
    ids = [r["doc_id"] for r in near.collect()]
    assert near.columns == columns and sorted({d for d in ids if d is not None}) == brute_similar(known) and len(set(ids)) == len(ids)
    mixed = cp.mixing(spark, odd, sf)
    words = lambda df: sum(len((r["text"] or "").encode().split()) for r in df.collect())
    sources = odd.select("source").distinct().count()
    assert mixed.columns == columns and abs(words(mixed) - 1.5 * words(odd)) <= 64 * sources
    pieces = cp.packing(spark, odd, sf).toPandas()
    encode = Encoder(*public_files())
    assert pieces.length.sum() == sum(len(encode(t or "")) for _, t in rows)


def test_stages_on_an_empty_table(spark, sf):
    nothing = _odd(spark).limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, nothing, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == list(cp.COLUMNS))


def test_quality_without_ratings_keeps_all(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = _odd(spark)
    assert cp.quality(spark, odd, str(tmp_path)).count() == odd.count()


def test_run_and_names(spark, sf):
    assert cp.run(spark, sf).count() > 0
    assert [n.split("_")[0] for n in sorted(q.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]
    assert cp.ORACLE_SQL is None and 4 <= len(cp.STAGES) <= 5
