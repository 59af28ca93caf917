"""Published versions, pinned models and streams that lose nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandlake.plans import fixtures as FX
from demandlake.sources import manifest

from .conftest import SF_SMALL


def test_a_failed_publish_leaves_nothing_visible(spark, tmp_path):
    from demandlake.sources.sinks import publish_dataset, read_dataset

    root = str(tmp_path / "sets")
    with pytest.raises(FileNotFoundError):
        manifest.current(spark, root, "a")
    publish_dataset(spark.range(3), root, "a")
    first = read_dataset(spark, root, "a")
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        publish_dataset(bad, root, "a")
    assert read_dataset(spark, root, "a").count() == 3 and manifest.entries(spark, root).count() == 1
    publish_dataset(spark.range(7), root, "a")
    publish_dataset(spark.range(1), root, "b")
    assert (first.count(), read_dataset(spark, root, "a").count(), read_dataset(spark, root, "b").count()) == (3, 7, 1)
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, root, "none")


def test_a_retried_batch_scores_with_its_own_model(spark, tmp_path):
    """The pin of a micro-batch outlives a newer model: replaying the batch gives the same scores."""
    from demandlake.operators.mlp import fit_mlp
    from demandlake.operators.models import fit_model, prepare_splits, publish_bundle
    from demandlake.streaming import scoring as SC

    base = str(tmp_path)
    with prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        req = FX.demand(spark, SF_SMALL).limit(60).select("event_id", "datetime", "season", "holiday", "workingday", "weather", "temp", "atemp", F.col("humidity").cast("double"), "windspeed")
        req.write.parquet(f"{base}/landing")
        first = publish_bundle(f"{base}/models", "m", fit_mlp(s, hidden=(8,), epochs=2), s.scaler, "mlp")
        SC.score_stream(spark, f"{base}/landing", f"{base}/models", "m", f"{base}/out", f"{base}/bad", f"{base}/cp")
        before = {r.event_id: r["count"] for r in spark.read.parquet(f"{base}/out").collect()}
        second = publish_bundle(f"{base}/models", "m", fit_model("linear", s.train)[0], s.scaler, "linear")
    assert manifest.current(spark, f"{base}/models", "m") == second != first
    # the same batch again, as after a crash before its commit
    assert SC._pinned(spark, f"{base}/models", "m", f"{base}/cp-pins", 0) == first
    assert SC._pinned(spark, f"{base}/models", "m", f"{base}/cp-pins", 1) == second
    import shutil

    shutil.rmtree(f"{base}/cp/commits")
    SC.score_stream(spark, f"{base}/landing", f"{base}/models", "m", f"{base}/out", f"{base}/bad", f"{base}/cp")
    rows = spark.read.parquet(f"{base}/out").collect()
    assert before and {r.event_id: r["count"] for r in rows} == before and {r.model_version for r in rows} == {first}


def test_hourly_stream_equals_batch_with_late_rows(spark, tmp_path):
    """Every window is right after each run, the newest included; late rows are counted, not dropped."""
    from demandlake.streaming.hourly import hourly_counts, hourly_stream, hourly_totals

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts", "value")
    landing, sink, cp = (str(tmp_path / x) for x in ("landing", "sink", "cp"))
    assert hourly_totals(spark, sink).count() == 0
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    new = seconds > ev.agg(F.percentile_approx(seconds, 0.5)).first()[0]
    key = lambda df: {(r.window_start, r.window_end): (r.n_events, round(r.total_value, 6)) for r in df.collect()}
    landed = None
    for part in (ev.where(new), ev.where(~new)):  # the newer half first: all of the older half is late
        part.repartition(2).write.mode("append").parquet(landing)
        landed = part if landed is None else landed.unionAll(part)
        hourly_stream(spark, ev.schema, landing, sink, cp, files_per_batch=2)
        assert key(hourly_totals(spark, sink)) == key(hourly_counts(landed))
    late = hourly_totals(spark, sink).agg(F.sum("n_late")).first()[0]
    newest = ev.where(new).agg(F.max("ts")).first()[0]
    assert late == ev.where(~new).where(F.col("ts") < F.lit(newest - dt.timedelta(hours=1))).count() > 0
