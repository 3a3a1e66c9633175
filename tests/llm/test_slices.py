import numpy as np
import pytest

import corpus_pipeline as cp
from quernel.llm.common import unite
from quernel.llm import simhash_slices as SS
from quernel.llm.simhash_slices import keep_similar


def brute_similar(rows, least=0.8):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, label = [shingles(t) for _, t in rows], np.arange(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b) - 1e-9:
                unite(label, np.array([i]), np.array([j]))
    return sorted({min(rows[j][0] for j in np.flatnonzero(label == x)) for x in label})


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_near_duplicates_have_a_jaccard_similarity(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    got = cp.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == brute_similar([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_short_and_planted_near_duplicates(spark):
    rng = np.random.default_rng(11)
    rows = []
    for n in (6, 10, 14, 20, 40, 100, 400):
        for k in range(20):
            words = [f"v{x}" for x in rng.integers(0, 10**6, n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, *(f"u{k}{x}" for x in range((n - 4) // 4 + k % 2))]).upper())]
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "two words"), (1004, "Two\tWORDS")]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for chunk in (512, 2):
        got = {r["doc_id"] for r in keep_similar(docs, chunk=chunk).collect()}
        want = set(brute_similar(rows))
        assert got >= want and len(got - want) <= 0.01 * (len(rows) - len(want))


@pytest.mark.parametrize("cross", [False, True])
def test_tries_are_walked_and_find_all_near_fingerprints(cross, monkeypatch):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2, (3, 150, 256), dtype=np.uint8)
    near = (seeds ^ (rng.random(seeds.shape) < rng.uniform(0.05, 0.4, (3, 150, 1)))).astype(np.uint8)  # some beyond the limits
    bits = np.concatenate([seeds, near], axis=1).reshape(-1, 256)
    heads = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    node = np.repeat(np.arange(3), 300)
    side = rng.integers(0, 2, len(node)) if cross else np.zeros(len(node), int)
    start, label, want, seen = np.arange(3) * 300, np.arange(len(node)), np.arange(len(node)), []
    walk = SS.walk
    monkeypatch.setattr(SS, "walk", lambda path, nodes, *a, **b: (seen.append(len(nodes)), walk(path, nodes, *a, **b)))
    SS.walk_tries(heads, start, start + 300, np.full(3, cross), side, label)
    differ = (bits[:, None] != bits[None]).astype(np.int32)
    fit = (differ[:, :, :64].sum(2) <= SS.LOOSE[0]) & (differ.sum(2) <= SS.LOOSE[1]) & (node[:, None] == node[None])
    if cross:
        fit &= side[:, None] != side[None]
    unite(want, *np.nonzero(fit))
    assert seen == [3] and 0 < (want != np.arange(len(want))).sum() < 450
    assert sorted(map(tuple, {x: np.flatnonzero(label == x).tolist() for x in label}.values())) == sorted(map(tuple, {x: np.flatnonzero(want == x).tolist() for x in want}.values()))
