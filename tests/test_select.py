"""Selection of ranks by counting, against plain sorting."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import order as OR
from demandlake.operators import profiles as PR
from demandlake.operators import select as SE


@pytest.mark.parametrize("few, accuracy", [(SE.FEW, SE.ACCURACY), (3, 10)])
def test_values_at_ranks(spark, monkeypatch, few, accuracy):
    """Small bounds force many refinements; heavy values and ties must not stall them."""
    monkeypatch.setattr(SE, "FEW", few)
    monkeypatch.setattr(SE, "ACCURACY", accuracy)
    rng = np.random.default_rng(0)
    cols = {"a": rng.normal(size=800), "b": np.where(rng.random(800) < 0.6, 7.0, rng.integers(0, 20, 800)), "c": np.full(800, 3.5), "d": np.concatenate([[np.inf, -np.inf], rng.random(798)])}
    rows = [tuple(float(cols[c][i]) if (c != "a" or i % 10) else None for c in cols) for i in range(800)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    ranks = lambda n: [0, 1, n // 3, n // 2, n - 2, n - 1, n, -1]
    got = SE.values_at(df, {c: F.col(c) for c in cols}, dict.fromkeys(cols, ranks))
    for j, c in enumerate(cols):
        want = sorted(r[j] for r in rows if r[j] is not None)
        n, at = got[c]
        assert n == len(want) and set(at) == {r for r in ranks(n) if 0 <= r < n}
        assert all(at[r] == (want[r], sum(v < want[r] for v in want)) for r in at), c


def test_longs_beyond_doubles_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(SE, "FEW", 2)
    base = 2**62
    df = spark.createDataFrame([(base + i % 40,) for i in range(200)], "h long")
    _, at = SE.values_at(df, {"h": F.col("h")}, {"h": lambda n: [0, 57, n - 1]})["h"]
    assert [at[r][0] - base for r in (0, 57, 199)] == [0, 11, 39]
    assert SE.values_at(df.limit(0), {"h": F.col("h")}, {"h": lambda n: [0, 1]})["h"] == (0, {})


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "int"])
def test_keys_of_ordered_rows(spark, kind):
    times = [None if i % 11 == 0 else dt.datetime(2020, 1, 1) + dt.timedelta(days=i % 7) for i in range(120)]
    df = spark.createDataFrame([(t, i, f"k{i:03d}") for i, t in enumerate(times)], "t timestamp_ntz, i long, s string")
    df = df.withColumn("t", F.dayofyear("t") if kind == "int" else F.col("t").cast(kind)).repartition(4)
    for tie in ("i", "s"):
        want = [r[1] for r in sorted(((-1 if t is None else t.toordinal()), (i if tie == "i" else f"k{i:03d}")) for i, t in enumerate(times))]
        assert [r[tie] for r in OR.head_slice(df, ["t", tie], 30).collect()] == want[:30]
        assert [r[tie] for r in OR.tail_slice(df, ["t", tie], 30).collect()] == want[-30:]
    for n in (0, 120, 500):
        assert OR.head_slice(df, ["t", "i"], n).count() == OR.tail_slice(df, ["t", "i"], n).count() == min(n, 120)


def test_no_row_level_exchange(spark):
    df = spark.range(0, 10_000).select((F.col("id") * 7919 % 10_007).alias("k"), (F.col("id") % 97 / 3).alias("x"))
    plan = OR.tail_slice(df, ["k"], 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "Scan ExistingRDD" not in plan  # the final order of 50 rows
    q = PR.describe_long(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in q and "hashpartitioning" not in q


def test_sample_nests_and_is_exact(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    small, large = ({r.k for r in OR.exact_sample(df, "k", n=n, seed=3).collect()} for n in (100, 400))
    assert len(small) == 100 and len(large) == 400 and small < large
    assert OR.exact_sample(df, "k", fraction=0.25, seed=3).count() == 250 and OR.exact_sample(df.limit(0), "k", n=5).count() == 0


def test_nan_is_skipped_like_null(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (2.0, nan), (nan, 3.0), (4.0, 5.0), (None, 9.0)], "x double, y double")
    r = PR.describe_long(df, ["x"]).first()
    x = np.array([1.0, 2.0, 4.0])
    assert (r["count"], r["min"], r["max"]) == (3, 1.0, 4.0) and r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(ddof=1))
    assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(list(np.percentile(x, [25, 50, 75])))
    corr = {(c.row, c.col): c["corr"] for c in PR.correlation_matrix(df, ["x", "y"]).collect()}
    assert corr["y", "x"] == pytest.approx(1.0) and corr["x", "x"] == 1.0  # the two rows with both
    m = PR.target_moments(df.select(F.col("x").alias("cnt"))).first()
    assert (m["mean"], m["median"], m["max"]) == (pytest.approx(7 / 3), 2.0, 4.0)
    assert {b["bin"]: b["count"] for b in PR.histogram(df, "x", 3).collect()} == {1: 1, 2: 1, 3: 1}
    assert PR.box_stats(df, ["x"]).first()["median"] == 2.0
    none = PR.describe_long(df.where("false"), ["x"]).first()
    assert none["count"] == 0 and none["p50"] is None and not math.isnan(none["mean"] or 0.0)


def test_running_aggregates_of_a_null_key(spark):
    rows = [(None if i % 3 else 1, i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(6)
    got = OR.running_agg(df, ["k"], ["i"], [("n", "sum", F.lit(1), True), ("m", "max", F.col("v"), False)], num_partitions=8)
    seen = {}
    for r in sorted(got.collect(), key=lambda r: r.i):
        n, m = seen.get(r.k, (0, None))
        assert (r.n, r.m) == (n + 1, m)
        seen[r.k] = (n + 1, r.v)
    assert seen[None][0] == 200


def test_early_stop_and_feed_of_a_null_job(spark):
    from demandlake.operators import runs as RU

    log = spark.createDataFrame([(j, e, 1.0 + e) for j in (None, 5) for e in range(30)], "job_id long, epoch int, val_loss double")
    for r in RU.early_stop(log, patience=4, num_partitions=6).groupBy("job_id").agg(F.max("epoch").alias("last"), F.sum(F.col("stopped").cast("int")).alias("s")).collect():
        assert (r.last, r.s) == (4, 1)
    ts = dt.datetime(2020, 1, 1)
    ev = spark.createDataFrame([(j, s, ts + dt.timedelta(seconds=s), "done" if s == 3 else "epoch") for j in (None, 5) for s in range(6)], "job_id long, seq long, ts timestamp_ntz, event string")
    assert {r.job_id: r["count"] for r in RU.progress_feed(ev).groupBy("job_id").count().collect()} == {None: 4, 5: 4}
