"""Sources, sinks, models and plan-shape checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.plans import fixtures as FX

from .conftest import SF_MID, SF_SMALL


def test_landing_checks(spark, tmp_path):
    from demandlake.sources.csv_source import landing_gate, missing_columns

    good = tmp_path / "up" / "good.CSV"
    good.parent.mkdir()
    good.write_text("datetime,season,holiday,workingday,weather,temp,atemp,humidity,windspeed,count\n2011-01-01 00:00:00,1,0,0,1,9.8,14.4,81,0,16\n")
    (tmp_path / "up" / "bad.csv").write_text("date,season\n2011-01-01,1\n")
    (tmp_path / "up" / "notes.txt").write_text("hello\n")
    gate = {r.path.rsplit("/", 1)[-1]: r.accepted for r in landing_gate(spark, str(tmp_path / "up")).collect()}
    assert gate == {"good.CSV": True, "bad.csv": True, "notes.txt": False}
    miss = {r.file_path.rsplit("/", 1)[-1]: r.missing for r in
            missing_columns(spark, str(tmp_path / "up" / "*.[cC][sS][vV]")).collect()}
    assert miss["good.CSV"] == []
    assert miss["bad.csv"] == sorted(["atemp", "count", "datetime", "holiday", "humidity", "temp", "weather",
                                      "windspeed", "workingday"])


def test_ridge_matches_closed_form(spark):
    from demandlake.operators.models import fit_model
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2)) * [3.0, 1.0]
    y = 2.0 + x @ [1.5, -2.0] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model, _ = fit_model("ridge", df, alpha=10.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(2), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)


def test_models_reach_planted_signal(spark):
    from demandlake.operators.models import fit_and_evaluate, prepare_splits

    s = prepare_splits(FX.demand(spark, SF_MID))
    lin = fit_and_evaluate("linear", s).first().r2
    gbt = fit_and_evaluate("gbt", s, maxIter=10, maxDepth=5, stepSize=0.3).first().r2
    assert lin >= 0.7 and gbt >= 0.95


def test_model_roundtrip_identical(spark, tmp_path):
    from demandlake.operators.models import fit_model, model_roundtrip, prepare_splits

    s = prepare_splits(FX.demand(spark, SF_SMALL))
    model, _ = fit_model("linear", s.train)
    out = model_roundtrip(model, s.scaler, "linear", str(tmp_path / "m"), s.test)
    assert out.filter(~F.col("same")).count() == 0 and out.count() > 0


def test_mlp_learns(spark):
    from demandlake.operators.mlp import fit_mlp
    from demandlake.operators.models import prepare_splits

    s = prepare_splits(FX.demand(spark, SF_MID))
    res = fit_mlp(s, hidden=(32, 16), epochs=10, lr=1e-2)
    assert res.metrics(s.test).first().r2 > 0.7
    assert len(res.history) == 10


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_index_never_single_partition(spark):
    from demandlake.operators.order import with_row_index

    d = FX.demand(spark, SF_SMALL).select("event_id", "datetime")
    plan = _plan(with_row_index(d, ["datetime", "event_id"]))
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_scaler_is_broadcast(spark):
    from demandlake.operators.scaling import scale_numeric

    d = FX.demand(spark, SF_SMALL).select("temp", "atemp")
    plan = _plan(scale_numeric(d, ["temp", "atemp"]))
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastExchange" in plan


def test_scan_prunes_columns(spark):
    d = FX.demand(spark, SF_SMALL).select("event_id", "cnt")
    plan = _plan(d)
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "event_type" in read_schema and "props" not in read_schema


def test_search_keys_keep_full_settings():
    from demandlake.operators.mlp import Trial
    from demandlake.plans import catalog

    assert [512, 256, 128, 64] in catalog.TUNE_SPACE["hidden"] and catalog.TUNE_SPACE["epochs"] == [30, 50, 100] and catalog.TUNE_SPACE["lr"] == [0.0001, 0.001, 0.01]
    assert (Trial().hidden, Trial().epochs, Trial().lr, Trial().batch_size, Trial().patience) == ((512, 256, 128, 64), 30, 1e-3, 64, 20)


def test_search_and_refit_run(spark):
    from demandlake.plans import catalog

    trials = catalog.QUERIES["tune_model"](spark, SF_SMALL).collect()
    assert len(trials) == 20 and all(r.error is None and math.isfinite(r.r2) for r in trials) and {r.phase for r in trials} == {"explore", "refine"}
    (final,) = catalog.QUERIES["final_validation"](spark, SF_SMALL).collect()
    assert final.params == max(trials, key=lambda r: (r.r2, -r.trial_id)).params and final.r2 > 0.5


def test_learning_curve_runs(spark):
    from demandlake.plans import catalog

    rows = catalog.QUERIES["learning_curve"](spark, SF_SMALL).collect()
    assert len(rows) == 10 and {r["size"] for r in rows} == {0.1, 0.25, 0.5, 0.75, 1.0}
    n = {(r.model, r["size"]): r.n_train for r in rows}
    assert all(n["mlp", s] == n["linear", s] for s in (0.1, 0.25, 0.5, 0.75, 1.0))


def _small(spark, hidden=(16, 8), **kw):
    from demandlake.operators.mlp import Trial

    return Trial(hidden=hidden, epochs=4, lr=1e-2, **kw)


def test_many_networks_equal_single_fits(spark):
    import numpy as np

    from demandlake.operators import mlp
    from demandlake.operators.models import prepare_splits

    with prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        trials = [_small(spark), _small(spark, batch_size=32), _small(spark, hidden=(8,), patience=1), _small(spark, hidden=("x",)), _small(spark, seed=7)]
        for shards, fan in ((1, mlp.FAN), (9, 2)):
            old, mlp.FAN = mlp.FAN, fan
            packed = mlp.pack_splits(s, shards=shards)
            many = mlp.fit_many(packed, trials)
            for t, r in zip(trials, many):
                (one,) = mlp.fit_many(packed, [t])
                assert (one.error is None) == (r.error is None) == (t.hidden != ("x",))
                if r.error is None:
                    assert all(np.allclose(a, b, rtol=1e-5, atol=1e-6) for a, b in zip(one.weights, r.weights)) and len(one.history) == len(r.history)
            mlp.FAN = old
            good = [i for i, r in enumerate(many) if r.error is None]
            scored = mlp.score_many(packed, [trials[i] for i in good], [many[i] for i in good])
            for i, own in zip(good, scored):
                want = many[i].metrics(s.val).first()
                assert own["held"][0] == want.n and abs(own["held"][1] - want.r2) < 1e-4
        seen = []
        mlp.fit_mlp(s, hidden=(8,), epochs=3, on_epoch_end=seen.append)
        assert [e["epoch"] for e in seen] == [0, 1, 2]


def test_forest_does_not_depend_on_partitions(spark):
    from demandlake.operators.models import fit_model, prepare_splits, score

    d = FX.demand(spark, SF_SMALL)
    got = []
    for frame in (d.repartition(1), d.repartition(7)):
        with prepare_splits(frame) as s:
            model, _ = fit_model("forest", s.train, numTrees=5)
            got.append({r.event_id: r.y_pred for r in score(model, s.test).select("event_id", "y_pred").collect()})
    assert got[0] == got[1]
