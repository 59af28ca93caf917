"""Ingest by header, artifacts, run histories with NaN, fixed output orders, zones and partition counts."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import order as OR
from demandlake.operators import profiles as PR
from demandlake.operators import runs as RU
from demandlake.plans import fixtures as FX

from .conftest import SF_SMALL

HEADER = "datetime,season,holiday,workingday,weather,temp,atemp,humidity,windspeed,casual,registered,count"


def test_csv_is_bound_by_each_files_header(spark, tmp_path):
    from demandlake.sources.csv_source import read_demand_csv

    (tmp_path / "a.csv").write_text(f"{HEADER}\n2011-01-01 00:00:00,1,0,0,1,9.84,14.395,81,0,3,13,16\n")
    (tmp_path / "b.csv").write_text('count,"temp",date,season\r\n7,"1.5",2011-01-02,2\r\n8,,2011-01-03T05:00:00,x\r\n')
    (tmp_path / "c.csv").write_text("season,count\n4,1\n4,2\n\n4,3\n")
    got = {(r.source_file[-5], r.cnt): r for r in read_demand_csv(spark, str(tmp_path)).collect()}
    assert len(got) == 6
    assert got["a", 16].temp == 9.84 and got["a", 16].datetime == dt.datetime(2011, 1, 1) and got["a", 16].parse_errors == []
    assert got["b", 7].temp == 1.5 and got["b", 7].datetime == dt.datetime(2011, 1, 2) and got["b", 7].weather is None
    assert got["b", 8].temp is None and got["b", 8].parse_errors == ["season"] and got["b", 8].datetime.hour == 5
    assert [got["c", n].datetime for n in (1, 2, 3)] == [dt.datetime(2011, 1, 1, h) for h in (0, 1, 2)]


def test_times_do_not_depend_on_the_session_zone(spark):
    from demandlake.sources.csv_source import parse_datetime

    df = spark.createDataFrame([("2011-03-13 02:30:00",), ("2011-03-13T02:30:00.5",), ("2011-03-13",), ("13.3.2011",)], "s string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in df.select(parse_datetime(F.col("s"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.datetime(2011, 3, 13, 2, 30), dt.datetime(2011, 3, 13, 2, 30, 0, 500000), dt.datetime(2011, 3, 13), None]


def test_landing_gate_reasons(spark, tmp_path):
    from demandlake.sources.csv_source import landing_gate

    (tmp_path / "good one.csv").write_text("a,b\n1,2\n\"x,y\",2\n")
    (tmp_path / "ragged.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "blank.csv").write_text("\n1,2\n")
    (tmp_path / "note.txt").write_text("a,b\n")
    (tmp_path / "big.csv").write_text("a\n" + "1\n" * 100)
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.reason for r in landing_gate(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"good one.csv": None, "ragged.csv": "a line has more fields than the header", "blank.csv": "no header", "note.txt": "not a .csv file",
                   "big.csv": "file larger than 100 bytes"}


def test_ingest_rejects_files_without_columns_and_survives_a_rerun(spark, tmp_path):
    from demandlake.streaming.scoring import ingest_stream

    land = tmp_path / "land"
    land.mkdir()
    paths = [str(tmp_path / x) for x in ("ok", "bad", "ckpt")]
    (land / "a.csv").write_text(f"{HEADER}\n2011-01-01 00:00:00,1,0,0,1,9.84,14.395,81,0,3,13,16\n2011-01-01 01:00:00,9,0,0,1,9.84,14.395,81,0,3,13,17\n")
    ingest_stream(spark, str(land), *paths)
    (land / "b.csv").write_text("datetime,count\n2011-01-01 02:00:00,5\n")
    for _ in range(2):
        ingest_stream(spark, str(land), *paths)
    ok = [(r.cnt, r.season) for r in spark.read.parquet(paths[0]).collect()]
    bad = {r.cnt: r for r in spark.read.parquet(paths[1]).collect()}
    assert ok == [(16, 1)] and set(bad) == {17, 5}
    assert bad[17].violations == ["season"] and "weather" in bad[5].missing


def test_reference_shaped_artifact(spark, tmp_path):
    from demandlake.sources.sinks import artifact_metrics

    body = {"y_true": [1.0, 2.0], "y_pred": [1.0, 2.5], "metadata": {"model_type": "lstm", "training_time": 2.5, "metrics": {"r2": 0.5, "rmse": 3.0}}}
    (tmp_path / "a.json").write_text(json.dumps(body, indent=2))
    r = artifact_metrics(spark, str(tmp_path / "a.json")).first()
    assert (r.model_type, r.r2, r.mape, r.training_time, r.n_samples) == ("lstm", 0.5, None, 2.5, 2)
    (tmp_path / "b.json").write_text(json.dumps({"y_true": [1.0], "y_pred": [1.0], "metrics": {"mae": 1.0}}))
    r = artifact_metrics(spark, str(tmp_path / "b.json")).first()
    assert (r.model_type, r.mae, r.n_samples) == ("mlp", 1.0, 1)


def test_nan_and_null_losses_are_never_best(spark):
    nan = math.nan
    rows = [(1, i, v) for i, v in enumerate([nan, 5.0, None, 4.0, nan, 4.0, 3.0])] + [(2, 0, None), (2, 1, nan)]
    df = spark.createDataFrame(rows, "job_id long, epoch int, val_loss double")
    got = {(r.job_id, r.epoch): (r.best_val_loss, r.is_best) for r in RU.best_so_far(df).collect()}
    assert [got[1, i] for i in range(7)] == [(None, False), (5.0, True), (5.0, False), (4.0, True), (4.0, False), (4.0, False), (3.0, True)]
    assert got[2, 1] == (None, False)
    stop = {(r.job_id, r.epoch): (r.patience_counter, r.stopped) for r in RU.early_stop(df, patience=2).collect()}
    assert stop == {(1, 0): (1, False), (1, 1): (0, False), (1, 2): (1, False), (1, 3): (0, False), (1, 4): (1, False), (1, 5): (2, True), (2, 0): (1, False), (2, 1): (2, True)}


def test_stream_early_stop_keeps_digits_and_gaps(spark, tmp_path):
    from demandlake.streaming.progress import OUT_SCHEMA, early_stop_stream, land

    losses = [0.5617283945061725, math.pi, 0.1 + 0.2, None, 1 / 3, 1 / 7]
    df = spark.createDataFrame([(1, i, 0.0, v) for i, v in enumerate(losses)], "job_id long, epoch int, train_loss double, val_loss double")
    dirs = [str(tmp_path / x) for x in ("land", "sink", "ckpt")]
    for part in ([4, 5], [1], [1, 4], [0, 2], [3]):
        land(df.filter(F.col("epoch").isin(part)), dirs[0], files=1)
        early_stop_stream(spark, *dirs, patience=20)
    got = {r.epoch: r for r in spark.read.schema(OUT_SCHEMA).parquet(dirs[1]).collect()}
    assert [got[i].val_loss for i in range(6)] == losses
    assert [got[i].best_val_loss for i in range(6)] == [losses[0], losses[0], 0.1 + 0.2, 0.1 + 0.2, 0.1 + 0.2, 1 / 7]


def test_progress_stream_keeps_late_events(spark, tmp_path):
    from demandlake.streaming.progress import land, progress_stream

    ev = FX.job_events(spark, SF_SMALL)
    dirs = [str(tmp_path / x) for x in ("land", "sink", "ckpt")]
    for late in (False, True):  # the newest half first
        land(ev.filter((F.day("ts") > 15) != F.lit(late)), dirs[0], files=2)
        progress_stream(spark, *dirs)
    assert spark.read.parquet(dirs[1]).count() == ev.count()


@pytest.mark.parametrize("n", [3, 1500])
def test_head_and_tail_are_in_time_order(spark, n):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k")).repartition(5)
    assert [r.k for r in OR.head_slice(df, ["k"], n).collect()] == list(range(n))
    assert [r.k for r in OR.tail_slice(df, ["k"], n).collect()] == list(range(2000 - n, 2000))


def test_boundary_labels_equal_indexed_labels(spark):
    d = FX.demand(spark, SF_SMALL).select("event_id", "datetime")
    by = ["datetime", "event_id"]
    want = {r.event_id: r.split for r in OR.time_split(d, by, 0.15, 0.15).collect()}
    assert {r.event_id: r.split for r in OR.label_split(d, by, 0.15, 0.15).collect()} == want
    want = {r.event_id: (r.test_fold, r.train_from_fold) for r in OR.ts_folds(d, by, 5).collect()}
    assert {r.event_id: (r.test_fold, r.train_from_fold) for r in OR.label_folds(d, by, 5).collect()} == want
    for few in (0.0, 1.0):
        assert set(r.split for r in OR.label_split(d, by, few and 0.5, 0.0).collect()) == ({"train", "test"} if few else {"train"})
    with pytest.raises(Exception, match="Invalid split sizes"):
        OR.label_split(d.limit(2), by, 0.5, 0.5).collect()


def test_column_quantiles(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (3.0, 4.0), (10.0, 7.0)], "x double, y double")
    r = PR.column_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75]).first()
    assert (r.x__q, r.y__q) == ([1.75, 2.5, 4.75], [4.0, 4.0, 5.5])


def test_network_does_not_depend_on_partitions(spark):
    from demandlake.operators.mlp import fit_mlp, gradient_importance
    from demandlake.operators.models import Splits, prepare_splits

    with prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        fits = [fit_mlp(Splits(s.train.repartition(n), s.val, s.test), hidden=(8,), epochs=2, shards=4) for n in (1, 8)]
        assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(fits[0].weights, fits[1].weights))
        assert gradient_importance(fits[0], s.test).count() == 24


def test_search_with_failures(spark, tmp_path):
    from demandlake.operators.models import compare_models, final_validation, load_bundle, prepare_splits, save_bundle, tune_model
    from demandlake.operators.mlp import fit_mlp

    with prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        board = {r.model: r for r in compare_models(s, {"linear": {}, "gbt": {"maxDepth": 99}}).collect()}
        assert board["Linear Regression"].error is None and board["Gradient Boosting"].r2 is None and board["Gradient Boosting"].error
        bad = tune_model(s, "gbt", {"maxDepth": [99]}, n_trials=1)
        with pytest.raises(ValueError, match="no trial"):
            final_validation(s, "gbt", bad)
        trials = tune_model(s, "mlp", {"hidden": [[8]], "epochs": [1]}, n_trials=1, timeout_s=0.0)
        r = trials.first()
        assert math.isfinite(r.r2) and r.timed_out and final_validation(s, "mlp", trials).first().n > 0
        net = fit_mlp(s, hidden=(4,), epochs=1)
        model, scaler, kind, names = load_bundle(spark, save_bundle(str(tmp_path / "b"), net, s.scaler, "mlp"))
        assert kind == "mlp" and len(names) == 24 and all((a == b).all() for a, b in zip(model.weights, net.weights)) and scaler.count() == 1
        with pytest.raises(FileNotFoundError):
            load_bundle(spark, str(tmp_path / "none"))


def test_no_cache_is_left(spark):
    from demandlake.operators.models import prepare_splits

    jsc = spark.sparkContext._jsc
    before = len(jsc.getPersistentRDDs())
    with prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        s.train.count()
        assert len(jsc.getPersistentRDDs()) == before + 1
    assert len(jsc.getPersistentRDDs()) == before


def test_checkpoint_folder_must_be_shared_off_local():
    from demandlake.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *a):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
