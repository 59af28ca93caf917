import itertools
import random
import re

import numpy as np
import xxhash

from demandlake.llm import simhash as S
from demandlake.llm.components import components

from . import util


def brute_fp(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + size]).encode(), 42) for k in range(max(1, len(words) - size + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, bits=2):
    """Component label of each (id, fingerprint) row."""
    fps = sorted({f for _, f in pairs})
    at, root = np.array(fps, np.uint64), {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(at ^ at[k]) <= bits):
            a, b = find(f), find(fps[j])
            root[max(a, b)] = min(a, b)
    low = {}
    for i, f in pairs:
        r = find(f)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return [low[find(f)] for _, f in pairs]


def test_query_equals_brute_force(spark, tmp_path):
    got = S.op3_simhash_near_dedup(spark, util.write_tables(spark, tmp_path)).collect()
    data = util.rows()
    pairs = [(r[0], brute_fp(r[1])) for r in data]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_long_text_in_pieces(monkeypatch):
    text = util.rows()[-2][1].encode()
    whole = S.simhash(text)
    monkeypatch.setattr(S, "PIECE_WORDS", 1000)
    assert S.simhash(text) == whole


def test_anchors_cover():
    rng = random.Random(3)
    x = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64).view(np.int64)
    home, idx, near = S.anchors(x, 2)
    for k in range(len(x)):
        own = set(near[idx == k].tolist())
        assert len(own) == (idx == k).sum()  # no anchor twice
        assert home[k] in own
    for flips in [(), (0,), (63,), (1, 22), (23, 45), (4, 30), (50, 60), (7, 63)]:
        y = x.view(np.uint64) ^ np.uint64(sum(1 << b for b in flips))
        y_home = S.anchors(y.view(np.int64), 0)[0]
        assert all(y_home[k] in near[idx == k] for k in range(len(x)))


def test_every_link_is_found(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 64, 7), 2)} | {rng.getrandbits(64) for _ in range(300)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = {(r.a, r.b) for r in S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want


def test_replicas_are_not_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/nodes")
    found = S.links(spark.read.parquet(f"{tmp_path}/nodes"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keep_one(spark):
    docs, data = util.docs(spark), util.rows()
    got = S.keep_one(docs)
    assert got.columns == docs.columns
    label = brute_components([(r[0], brute_fp(r[1])) for r in data])
    kept = [r.doc_id for r in got.collect()]
    named = {c for c in label if c is not None}
    assert sorted(i for i in kept if i is not None) == sorted(named)
    assert sum(i is None for i in kept) == len({brute_fp(r[1]) for r, c in zip(data, label) if c is None})
    assert S.keep_one(util.empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
