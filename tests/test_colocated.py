"""Tables written by row key pair and average where they lie."""

import os

from pyspark.sql import functions as F

from demandlake.operators import evaluate as EV
from demandlake.plans import catalog
from demandlake.plans import fixtures as FX
from demandlake.sources.sinks import LEAST_BUCKETS, _table_name, read_colocated, write_colocated, write_like

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairing_and_ensemble_move_no_row(spark, tmp_path):
    preds = FX.predictions(spark, SF_SMALL)
    path = write_colocated(preds, str(tmp_path / "p"))
    own = read_colocated(spark, path)
    assert own.exceptAll(preds).count() == 0 == preds.exceptAll(own).count()
    truth = preds.where("model = 'rule'").select("event_id", "y_true")
    paths = write_like(truth, str(tmp_path / "t"), path)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables
    try:
        paired = EV.pair_predictions(read_colocated(spark, paths), own, "event_id", ["rule", "flat"])
        for df in (EV.ensemble_mean(own), paired):
            assert "Exchange" not in _plan(df)
        assert "Exchange" in _plan(EV.ensemble_mean(preds))
        assert paired.count() == truth.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in _plan(catalog.QUERIES["colocated_predictions"](spark, SF_SMALL)).replace("BroadcastExchange", "")


def test_buckets_outlive_the_catalog_entry_and_are_replaced(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([(None, "a", 1.0), (1, "a", None), (1, "a", None), (2, "b", float("nan"))], "event_id long, model string, `y pred` double")
    write_colocated(rows, path)
    spark.sql(f"DROP TABLE {_table_name(path)}")  # as for another session; the files stay
    again = read_colocated(spark, path)
    assert again.count() == 4 and again.where("event_id IS NULL").count() == 1
    assert "Exchange" not in _plan(again.groupBy("event_id").agg(F.count(F.lit(1))))
    assert len([f for f in os.listdir(f"{path}/rows") if f.endswith(".parquet")]) <= LEAST_BUCKETS
    write_colocated(rows.limit(0), path)
    assert read_colocated(spark, path).count() == 0
