"""Test/benchmark inputs derived from the driver's parquet tables.

Every fixture is a pure DataFrame over the base tables, so its size grows
with the scale factor and Catalyst prunes the columns it does not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def demand_covariates(spark: SparkSession, sf_dir: str, cap_wind: bool = True) -> DataFrame:
    """F1 `fx`: one demand record per event (no target yet)."""
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    weather = (F.when(F.col("event_type").isin("view", "click"), 1)
               .when(F.col("event_type") == "purchase", 2)
               .when(F.col("event_type") == "signup", 3)
               .otherwise(4))
    holiday = eid % 33 == 0
    return e.select(
        eid.alias("event_id"),
        F.col("ts").alias("datetime"),
        (F.lit(1) + uid % 4).cast("int").alias("season"),
        holiday.cast("int").alias("holiday"),
        ((F.weekday("ts") < 5) & ~holiday).cast("int").alias("workingday"),
        weather.cast("int").alias("weather"),
        ((eid * 7919) % 4100).cast("double") / 100,
        (((eid * 7919) % 4100) + (uid * 37) % 500).cast("double") / 100,
        F.get_json_object("props", "$.k").cast("int").alias("humidity"),
        (F.least(F.col("value"), F.lit(57.0)) if cap_wind else F.col("value")).alias("windspeed"),
        ((eid * 31) % 11).cast("int").alias("noise"),
    ).toDF("event_id", "datetime", "season", "holiday", "workingday", "weather",
           "temp", "atemp", "humidity", "windspeed", "noise")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 `demand`: covariates plus the planted target `cnt`."""
    fx = demand_covariates(spark, sf_dir)
    h = F.hour("datetime")
    season_f = (F.when(F.col("season") == 1, 0.8).when(F.col("season") == 2, 1.2)
                .when(F.col("season") == 3, 1.3).otherwise(1.0))
    hour_f = (F.when(h.between(7, 9), 1.8).when(h.between(17, 19), 1.6)
              .when(h.between(10, 16), 1.2).otherwise(0.4))
    weather_f = (F.when(F.col("weather") == 1, 1.0).when(F.col("weather") == 2, 0.8)
                 .when(F.col("weather") == 3, 0.5).otherwise(0.2))
    temp_f = F.least(F.greatest(1.0 - F.abs(F.col("temp") - 25.0) / 50.0, F.lit(0.2)), F.lit(1.0))
    cnt = F.floor(F.lit(50.0) * season_f * hour_f * weather_f * temp_f * 2.0).cast("int") + F.col("noise")
    return fx.withColumn("cnt", cnt)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """long predictions of three naive forecasters."""
    d = demand(spark, sf_dir)
    y_true = F.greatest(F.col("cnt") - 5, F.lit(0)).cast("double")
    h = F.hour("datetime")
    preds = F.array(
        F.struct(F.lit("rule").alias("model"), (F.col("cnt") - F.col("noise")).cast("double").alias("y_pred")),
        F.struct(F.lit("flat").alias("model"), F.lit(60.0).alias("y_pred")),
        F.struct(F.lit("hour").alias("model"), F.when(h.between(7, 19), 85.0).otherwise(25.0).alias("y_pred")),
    )
    # one scan, three rows per event (inline of a literal array, no union re-scan)
    return (d.select("event_id", y_true.alias("y_true"), F.inline(preds))
            .select("event_id", "model", "y_true", "y_pred"))


def epoch_log(spark: SparkSession, sf_dir: str, with_data: bool = False) -> DataFrame:
    """per-job epoch history (epoch numbered within the job)."""
    from ..operators.order import running_agg

    e = table(spark, sf_dir, "events")
    extra = ["props"] if with_data else []
    base = e.select(F.col("user_id").alias("job_id"), "ts", "event_id", "value", *extra)
    # epoch = position within the job; a running count over range chunks instead of a
    # window partitioned by job, so one very long job does not land in a single task
    numbered = running_agg(base, ["job_id"], ["ts", "event_id"], [("_n", "sum", F.lit(1), True)])
    return numbered.select(
        "job_id",
        (F.col("_n") - 1).cast("int").alias("epoch"),
        (F.col("value") * 0.9).alias("train_loss"),
        F.col("value").alias("val_loss"),
        *([F.col("props").alias("data")] if with_data else []),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job lifecycle feed."""
    e = table(spark, sf_dir, "events")
    ev = (F.when(F.col("event_type").isin("view", "click"), "epoch")
          .when(F.col("event_type") == "signup", "status")
          .when(F.col("event_type") == "purchase", "done")
          .otherwise("error"))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts",
                    ev.alias("event"), F.col("props").alias("data"))


def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per-batch losses."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("job_id"), F.col("l_linenumber").alias("epoch"),
                     F.col("l_quantity").alias("loss"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tuning trials."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("trial_id"),
        F.when(F.col("p_size") % 2 == 0, "mlp").otherwise("lstm").alias("model_type"),
        F.col("p_type").alias("hidden"),
        ((F.col("p_size") % 4 + 1) / 10.0).alias("dropout"),
        (F.lit(32) * (1 + F.col("p_size") % 3)).cast("int").alias("batch_size"),
        ((F.col("p_retailprice") - 900) / 100.0).alias("r2"),
        F.col("p_size").cast("double").alias("training_time"),
        F.col("p_brand").alias("brand"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """training jobs."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "mlp").otherwise("lstm").alias("model_type"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
        .otherwise("pending").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 600000).alias("r2"),
    )
