import hashlib

import numpy as np
import pytest

from demandlake.llm import centroids as C

from ..conftest import SF_SMALL, SF_MID

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, ids string"


def brute(vectors, k=8, rounds=10, seed=3):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by plain loops over whole tables."""
    order = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~", v, i) for i, v in vectors), key=lambda t: (t[0], t[1]))
    x = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64)
    cent = np.floor(1024 * np.array([v for _, v, _ in order[:k]], np.float32).astype(float)).astype(np.int64)

    def nearest():
        d = ((x[:, None, :] - cent[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = nearest()
        cent = np.array([x[own == c].sum(0) // (own == c).sum() if (own == c).any() else cent[c] for c in range(len(cent))])
    own, dist = nearest()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent.tolist()]
    return sorted((str(i), int(c), int(d), int(dist[own == c].sum()), int(dist.sum()), digests[c]) for (i, _), c, d in zip(vectors, own, dist))


def as_rows(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert as_rows(C.op12_centroid_clustering(spark, sf)) == brute([(r.vec_id, r.embedding) for r in rows])


def write(spark, path, rows):
    spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_hostile_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    vec = lambda: rng.normal(size=64).astype(np.float32).tolist()
    good = [(i, vec()) for i in range(50)]
    good += [good[7], (8, vec()), (None, vec()), (None, vec()), *[(200 + i, good[0][1]) for i in range(100)], (500, [1000.0] * 64)]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("-inf")] * 64)]
    assert as_rows(C.op12_centroid_clustering(spark, write(spark, tmp_path, good + bad))) == brute(good)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, tmp_path, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    got = as_rows(C.op12_centroid_clustering(spark, write(spark, tmp_path, rows)))
    assert got == (brute(rows) if n else [])


def test_ties_go_to_the_smaller_number(spark, tmp_path):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]  # equal centroids
    got = as_rows(C.op12_centroid_clustering(spark, write(spark, tmp_path, rows)))
    assert got == brute(rows) and len({r[1] for r in got}) == 2


def test_beyond_the_bound_and_small_blocks(spark):
    rows = [(i, [1e30 if i == 3 else float(i)] * 4) for i in range(30)]
    df = spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], SCHEMA)
    for block in (1, 7, 4096):
        held = C.blocks(df, dims=4, block_rows=block)
        model = C.fit(held, C.start(df, "vec_id", "embedding", 4, 3, 3))
        got = sorted(map(tuple, C.assign(held, model).collect()))
        assert block == 1 or got == last
        last = got
    assert len(got) == 30 and max(d for _, _, d in got) >= 0
