"""Linear models from summed products against fits of each row set by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import gram
from demandlake.operators import models as M
from demandlake.operators.order import label_folds
from demandlake.functions.features import feature_table
from demandlake.plans import fixtures as FX
from demandlake.schema import FEATURE_COLS

from .conftest import SF_MID, SF_SMALL


def _least_squares(x, y):
    """On standardised columns, directions below the library's rank tolerance left out."""
    mean, sd = x.mean(0), x.std(0)
    used = sd > 1e-12 * np.maximum(1, abs(mean))
    w = np.linalg.lstsq((x - mean)[:, used] / sd[used], y - y.mean(), rcond=gram.RANK_TOLERANCE ** 0.5)[0]
    return lambda z: y.mean() + ((z - mean)[:, used] / sd[used]) @ w


def _r2(y, guess):
    return 1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_folds_equal_fits_of_each_fold(spark):
    demand = FX.demand(spark, SF_MID)
    folded = label_folds(feature_table(demand, keep=["event_id", "datetime"]), ["datetime", "event_id"], 5).toPandas()
    x, y = folded[FEATURE_COLS].fillna(0).to_numpy(float), folded["cnt"].to_numpy(float)
    got = {f: r2 for f, r2 in M.cross_validate(demand, "linear").first()["scores"]}
    ridge = {f: r2 for f, r2 in M.cross_validate(demand, "ridge", alpha=3.0).first()["scores"]}
    assert sorted(got) == list(range(5))
    for f in range(5):
        train, test = (folded["train_from_fold"] <= f).to_numpy(), (folded["test_fold"] == f).to_numpy()
        assert got[f] == pytest.approx(_r2(y[test], _least_squares(x[train], y[train])(x[test])), abs=1e-9)
        mean, c = x[train].mean(0), x[train] - x[train].mean(0)
        w = np.linalg.solve(c.T @ c + 3.0 * np.eye(len(mean)), c.T @ (y[train] - y[train].mean()))
        assert ridge[f] == pytest.approx(_r2(y[test], y[train].mean() + (x[test] - mean) @ w), abs=1e-9)


def test_lasso_equals_the_single_fit(spark):
    with M.prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        model, _ = M.fit_model("lasso", s.train, tol=1e-10)
        curve = M.learning_curve(s, "lasso", sizes=(0.5, 1.0)).orderBy("size").collect()
        single = M.EV.regression_metrics(M.score(model, s.val)).first()["r2"]
        n = s.train.count()
    assert [r["n_train"] for r in curve] == [n // 2, n]
    assert curve[1]["val_r2"] == pytest.approx(single, abs=1e-4)


def test_curve_equals_fits_of_each_subset(spark):
    from demandlake.operators.order import exact_sample

    with M.prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        curve = {r["size"]: r for r in M.learning_curve(s, "linear", sizes=(0.25, 0.5, 1.0)).collect()}
        for size in (0.25, 0.5):
            own = s.train.join(exact_sample(s.train.select("event_id"), "event_id", fraction=size, seed=42), "event_id", "left_semi").toPandas()
            x, y = np.stack([v.toArray() for v in own["features"]]), own["label"].to_numpy()
            assert curve[size]["n_train"] == len(own)
            assert curve[size]["train_r2"] == pytest.approx(_r2(y, _least_squares(x, y)(x)), abs=1e-9)


def test_sums_do_not_depend_on_partitions_and_skip_what_is_missing(spark):
    rows = [(g, None if i % 7 == 0 else 1e6 + i, float("nan") if i % 11 == 0 else i * 0.5, None if i % 13 == 0 else 3.0 * i) for i in range(200) for g in ((i % 3) or None,)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    one, many = (gram.group_sums(df.repartition(p), ["a", "b"], "y", "g") for p in (1, 23))
    kept = [(g, a or 0.0, 0.0 if b != b else b, y) for g, a, b, y in rows if g is not None and y is not None]
    assert sorted(one) == sorted(many) == [1, 2]
    for g in (1, 2):
        z = np.array([r[1:] for r in kept if r[0] == g])
        for got in (one[g], many[g]):
            mean, cov = got.covariance()
            assert got.n == len(z) and np.allclose(mean, z.mean(0), rtol=1e-9) and np.allclose(cov, np.cov(z.T, bias=True), rtol=1e-7)


def test_empty_constant_and_doubled_columns(spark):
    assert gram.group_sums(spark.createDataFrame([], "g int, a double, y double"), ["a"], "y", "g") == {}
    df = spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("a"), (F.col("id") * 2).alias("twice"), F.lit(7).alias("same"), (F.col("id") * 3 + 1).alias("y"))
    sums = gram.group_sums(df, ["a", "twice", "same"], "y", "g")[1]
    line = gram.solve("linear", sums)
    assert line.r2(sums) == pytest.approx(1.0) and line.weights[2] == 0
    assert gram.solve("lasso", sums, alpha=1e9).weights.tolist() == [0, 0, 0]
    flat = gram.group_sums(df.withColumn("y", F.lit(5.0)), ["a"], "y", "g")[1]
    assert gram.solve("linear", flat).r2(flat) == 1.0 and gram.Line(np.zeros(1), 4.0).r2(flat) == 0.0
    with pytest.raises(ValueError):
        gram.solve("forest", sums)


def test_rows_without_labels_are_no_crash(spark):
    demand = FX.demand(spark, SF_SMALL).withColumn("cnt", F.lit(None).cast("int"))
    with pytest.raises(ValueError, match="no labelled rows"):
        M.cross_validate(demand, "linear")
