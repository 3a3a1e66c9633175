import numpy as np
import pytest

from quernel.llm import cap_filters as cf


@pytest.mark.parametrize("cosine", [0.93, 0.935, 0.97])
@pytest.mark.parametrize("count", [10**4, 27_000, 10**5, 10**6, 10**7, 4 * 10**7, 10**8])
def test_recall_and_passes_of_large_labels(count, cosine):
    rng = np.random.default_rng(3)
    a, b = cf._units(rng.normal(size=(300, 64))), rng.normal(size=(300, 64))
    b = cf._units(b - (a * b).sum(axis=1, keepdims=True) * a)
    codes = cf.codes_for(64, count, 20.0, 48)
    b, met, passed = cosine * a + np.sqrt(1 - cosine**2) * b, np.zeros(300, bool), 0
    for code in codes:
        (i, f), (j, g) = code.decode(a), code.decode(b)
        common = set(zip(i.tolist(), f.tolist(), strict=True)) & set(zip(j.tolist(), g.tolist(), strict=True))
        met[[x for x, _ in common]] = True
        passed += len(i) / 300
    assert met.mean() >= 0.9 and passed >= 16


def test_earlier_filters_in_parts():
    """Links are counted once, however many filters members have besides."""
    rng = np.random.default_rng(1)
    unit = cf._units(np.repeat(rng.normal(size=(1, 8)), 40, axis=0) + rng.normal(size=(40, 8)) * 0.01)
    lists = [np.unique(np.append(rng.integers(0, 10**6, 300), 10**6 + 5)) for _ in range(40)]
    lists[3], lists[7] = np.append(17, lists[3][lists[3] > 17]), np.append(17, lists[7][lists[7] > 17])
    linked, label = cf._bucket_links(unit, None, np.ones(40, np.int64), lists, 10**6 + 5, 0.93)
    common = np.array([[len(np.intersect1d(a[a < 10**6], b[b < 10**6])) > 0 for b in lists] for a in lists])
    assert common[3, 7] and (linked == (~common).sum(axis=1)).all() and (label == 0).all()


def test_links_of_a_whole_table_and_planted_ones(spark):
    rng, rows = np.random.default_rng(2), []
    for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect():
        rows.append((r["vec_id"], r["embedding"], r["label"]))
        if r["vec_id"] % 3 == 0:  # near vectors at cosines from 0.9 to 1
            a, c = cf._units(np.array([r["embedding"]]))[0], rng.uniform(0.9, 1)
            b = rng.normal(size=len(a))
            b = cf._units((b - (a @ b) * a)[None])[0]
            rows.append((10**6 + r["vec_id"], (c * a + np.sqrt(1 - c * c) * b).astype(np.float32).tolist(), r["label"]))
    x, label = cf._units(np.array([v for _, v, _ in rows], np.float64)), np.array([-1 if k is None else k for *_, k in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & (label[:, None] >= 0)
    np.fill_diagonal(near, False)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in cf.near_vectors(df).collect()}
    want = {i: int(n) for (i, *_), n in zip(rows, near.sum(axis=1), strict=True)}
    assert sum(want.values()) > 800 and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.98 * sum(want.values())
