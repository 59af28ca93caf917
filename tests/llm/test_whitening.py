import numpy as np
import pytest

from demandlake.llm import whitening as W

from ..conftest import SF_SMALL, SF_MID

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)


def brute(vectors):
    """n, S, components by falling variance, variances, trace of the covariance over distinct x vectors."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, v[:, ::-1], e[::-1], e.sum()


def check(rows, vectors, k):
    x, n, s, v, e, trace = brute([r for _, r in vectors])
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert len(rows) == len(vectors) * k
    by_id = {}
    for i, (vec_id, _) in enumerate(vectors):
        by_id.setdefault(vec_id, []).append(i)
    for c in range(k):
        want, have = [], []
        for vec_id, own in by_id.items():
            want += sorted(abs((x[i] - s / n) @ v[:, c] / np.sqrt(e[c])) for i in own)
            have += sorted(abs(r.whitened) for r in got[vec_id, c + 1])
        assert np.allclose(want, have, rtol=1e-6, atol=1e-6)
    for vec_id, own in by_id.items():
        assert sorted(int(((n * x[i] - s) ** 2).sum()) for i in own) == sorted(r.deviation for r in got[vec_id, 1])
    for r in rows:
        assert r.n == n and abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9


def test_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    check(W.op11_embedding_whitening(spark, SF_MID).collect(), [(r.vec_id, r.embedding) for r in df.collect()], 16)


def test_repeated_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    good += [good[3], (3, good[4][1]), (None, good[5][1]), *[(100 + i, good[0][1]) for i in range(200)]]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [float("nan")] * 5), (904, [float("inf"), 1.0, 2.0, 3.0, 4.0]), (905, [1.0] * 4)]
    df = frame(spark, good + bad)
    model = W.fit(df, components=3)
    check(W.transform(df, model).collect(), good, 3)
    assert model.n == 60 and model.passes >= W.LEAST_PASSES


def test_no_variance_and_dependent_columns(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(80, 3))
    rows = [(i, [*b, b[0], 0.25, -b[1]]) for i, b in enumerate((np.floor(64 * base) / 64).tolist())]  # three directions only
    df = frame(spark, rows)
    model = W.fit(df)
    assert (model.variances > 0).sum() == 3 and model.identity_error < 1e-9
    got = W.transform(df, model).collect()
    assert {r.component for r in got if r.whitened is not None} == {1, 2, 3} and {r.explained for r in got if r.component > 3} == {0.0}
    one = frame(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])
    flat = W.transform(one, W.fit(one)).collect()
    assert len(flat) == 4 and all(r.whitened is None and r.deviation == 0 and r.n == 1 for r in flat)


def test_scales_far_apart(spark):
    """Columns whose spreads differ by 50,000 times keep their small directions: one Gram pass would not."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * [1e4, 1.0, 30.0, 0.2]).tolist()) for i in range(300)]
    check(W.transform(frame(spark, rows), W.fit(frame(spark, rows))).collect(), rows, 4)


def test_deviation_beyond_a_long_and_empty(spark, tmp_path):
    rows = [(i, [float(i % 2) * 3e9, 0.0]) for i in range(3)]
    df = frame(spark, rows)
    assert all(r.deviation is None or r.deviation >= 0 for r in W.transform(df, W.fit(df)).collect())
    frame(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert W.op11_embedding_whitening(spark, str(tmp_path)).count() == 0
    assert W.op11_embedding_whitening(spark, SF_SMALL).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_factor_of_a_singular_matrix():
    g = np.ones((3, 3))
    r = W.factor(g, 10, shifted=False)
    assert np.allclose(r.T @ r, g, atol=1e-10) and np.allclose(r, np.triu(r))
    a = np.random.default_rng(0).normal(size=(3, 7))
    assert np.allclose(r.T @ W.substitute(a, r), a)


@pytest.mark.parametrize("parts", [1, 9])
def test_partitions_do_not_matter(spark, parts):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    a, b = W.fit(df), W.fit(df.repartition(parts))
    assert a.n == b.n and np.allclose(a.variances, b.variances, rtol=1e-10)
