"""Hand-computed edge cases on small inline frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from demandlake.functions import rules as R
from demandlake.operators import evaluate as EV
from demandlake.operators import order as OR
from demandlake.operators import profiles as PR
from demandlake.operators import runs as RU
from demandlake.sources.csv_source import parse_datetime


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (1, 5.0)], "a int, b double")
    rows = {(r.row, r.col): r.corr for r in PR.correlation_matrix(df, ["a", "b"]).collect()}
    assert rows[("b", "a")] is None and rows[("a", "a")] is None and rows[("b", "b")] == 1.0


def test_moments_bias_corrected(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "cnt int")
    r = PR.target_moments(df).first()
    assert r.skewness == pytest.approx(1.763633, abs=1e-5)
    assert r.kurtosis == pytest.approx(3.228, abs=1e-3)
    two = PR.target_moments(spark.createDataFrame([(1,), (2,)], "cnt int")).first()
    assert two.skewness is None and two.kurtosis is None


def test_quartiles_interpolate_like_pandas(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = df.agg(PR.quantiles("x", [0.25, 0.5, 0.75]).alias("q")).first().q
    assert r == [1.75, 2.5, 4.75]
    rq = PR.rank_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    assert [rq.q0, rq.q1, rq.q2] == [1.75, 2.5, 4.75]


def test_metrics_degenerate_cases(spark):
    zeros = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "y_true double, y_pred double")
    r = EV.regression_metrics(zeros).first()
    assert r.r2 == 1.0 and r.mape == 0.0
    off = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "y_true double, y_pred double")
    r = EV.regression_metrics(off).first()
    assert r.r2 == 0.0 and r.mape == 0.0 and r.mse == 0.5


def test_split_too_small_raises(spark):
    df = spark.createDataFrame([(dt.datetime(2011, 1, 1), 1), (dt.datetime(2011, 1, 2), 2)],
                               "datetime timestamp_ntz, event_id long")
    with pytest.raises(Exception, match="Invalid split sizes"):
        OR.time_split(df, ["datetime", "event_id"], 0.5, 0.5).collect()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_row_index_independent_of_partitioning(spark, parts):
    base = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("k"), F.lit(1).alias("v"))
    ix = OR.with_row_index(base.repartition(parts), ["k"], "idx", num_partitions=5)
    got = {r.k: r.idx for r in ix.collect()}
    assert got == {k: k for k in range(500)}


def test_running_min_hot_key_matches_brute_force(spark):
    rows = [(0 if i % 3 else i % 5, i, float((i * 37) % 101)) for i in range(900)]
    df = spark.createDataFrame(rows, "job long, epoch long, v double")
    got = {(r.job, r.epoch): r.m for r in OR.running_agg(df, ["job"], ["epoch"], [("m", "min", F.col("v"), True)],
                                                         num_partitions=6).collect()}
    best = {}
    for job, epoch, v in sorted(rows, key=lambda t: (t[0], t[1])):
        best[job] = min(best.get(job, math.inf), v)
        assert got[(job, epoch)] == best[job]


def test_early_stop_delta_matches_python(spark):
    vals = [5.0, 4.0, 3.99995, 3.99990, 3.0] + [3.5] * 12
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "job_id long, epoch int, val_loss double")
    out = RU.early_stop_delta(df, patience=10, min_delta=1e-4).orderBy("epoch").collect()
    best, counter, expect = math.inf, 0, []
    for v in vals:
        if v < best - 1e-4:
            best, counter = v, 0
        else:
            counter += 1
        expect.append((best, counter))
        if counter >= 10:
            break
    assert [(r.best_loss, r.patience_counter) for r in out] == expect
    assert out[-1].stopped


def test_job_status_first_terminal_wins(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [(1, 1, ts, "epoch"), (1, 2, ts + dt.timedelta(1), "done"), (1, 3, ts + dt.timedelta(2), "cancelled"),
            (2, 4, ts, "status"), (3, 5, ts, "error")]
    df = spark.createDataFrame(rows, "job_id long, seq long, ts timestamp_ntz, event string")
    got = {r.job_id: r.status for r in RU.job_status(df).collect()}
    assert got == {1: "completed", 2: "running", 3: "failed"}


def test_datetime_forms_and_bad_values(spark):
    df = spark.createDataFrame([("2011-07-15T08:00:00",), ("2011-07-15 08:00:00",), ("not a date",)], "s string")
    got = [r.t for r in df.select(parse_datetime(F.col("s")).alias("t")).collect()]
    assert got[0] == got[1] == dt.datetime(2011, 7, 15, 8) and got[2] is None


def test_bround_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,)], "y double")
    clamped, rounded = R.clamp_round("y")
    got = [(r.c, r.r) for r in df.select(clamped.alias("c"), rounded.alias("r")).collect()]
    assert got == [(0.5, 0), (1.5, 2), (2.5, 2), (0.0, 0)]


def test_validate_rows_names_violations(spark):
    from demandlake.operators.quality import validate_rows

    df = spark.createDataFrame([(5, 0, 1, 1, 60.0, 10.0, 50.0, 10.0), (1, 0, 1, 1, 20.0, 10.0, None, 10.0)],
                               "season int, holiday int, workingday int, weather int, temp double, atemp double, "
                               "humidity double, windspeed double")
    got = [r.violations for r in validate_rows(df).collect()]
    assert got == [["season", "temp"], ["humidity"]]


def test_missing_values_counts_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2)], "a double, b int")
    got = {r.column: r.missing for r in PR.missing_values(df).collect()}
    assert got == {"a": 1, "b": 1}


def test_top_groups_ties_to_smaller_key(spark):
    df = spark.createDataFrame([(9, 5.0), (8, 5.0), (7, 5.0), (6, 5.0)], "hour int, mean double")
    assert [r.hour for r in PR.top_groups(df, "hour", 3).orderBy("rank").collect()] == [6, 7, 8]


def test_recommendations_default_pair(spark):
    df = spark.createDataFrame([(0.85, 15.0, 10.0)], "r2 double, rmse double, t double")
    text = df.select(R.recommendations("r2", "rmse", "t").alias("x")).first().x
    assert text == "\n".join(R.REC_DEFAULT)


def test_histogram_max_in_last_bin_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    got = {r.bin: r["count"] for r in PR.histogram(df, "x", 5).collect()}
    assert got == {1: 1, 3: 1, 5: 1}
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r.bin, r["count"]) for r in PR.histogram(const, "x", 5).collect()] == [(1, 2)]
