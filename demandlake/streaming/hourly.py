"""Hourly demand counts from raw events: batch and streaming forms share one plan.

``hourly_stream`` loses no event, however late: a micro-batch writes the windows of its own rows as
corrections under its batch id (a retried batch replaces them), and ``hourly_totals`` adds the
corrections up per window. No state is kept, and every window, the newest included, is right after
each run. Rows that are later than the allowed delay are counted apart, not dropped.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, ts: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    """Tumbling 1-hour windows: event count and summed value per window.

    Watermarks need a TIMESTAMP (not NTZ) column, so the naive wall clock is
    read as an instant in UTC via epoch microseconds (independent of the
    session time zone) and the window bounds are turned back into NTZ.
    """
    ev = events.withColumn("_et", _ntz_to_utc_ts(F.col(ts)))
    if watermark:
        ev = ev.withWatermark("_et", watermark)
    agg = ev.groupBy(F.window("_et", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value"))
    return agg.select(_utc_ts_to_ntz(F.col("w.start")).alias("window_start"),
                      _utc_ts_to_ntz(F.col("w.end")).alias("window_end"), "n_events", "total_value")


_EPOCH_NTZ = "1970-01-01 00:00:00"


def _ntz_to_utc_ts(c):
    """NTZ wall clock -> TIMESTAMP at that instant in UTC (session-zone independent)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), c)
    return F.timestamp_micros(micros)


def _utc_ts_to_ntz(c):
    """TIMESTAMP -> NTZ wall clock in UTC (session-zone independent)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))


CORRECTION = "window_start timestamp_ntz, window_end timestamp_ntz, n_events long, total_value double, n_late long, newest timestamp_ntz"


def hourly_stream(spark: SparkSession, schema, landing: str, sink: str, checkpoint: str, delay: dt.timedelta = dt.timedelta(hours=1),
                  files_per_batch: int | None = None, ts: str = "ts", value: str = "value") -> None:
    """Count landed Parquet events into hourly corrections under ``sink``, a folder per micro-batch."""
    reader = spark.readStream.schema(schema)
    src = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(landing)

    def batch(df: DataFrame, batch_id: int) -> None:
        seen = _corrections(df.sparkSession, sink)
        newest = None if seen is None else seen.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else F.col(ts) < F.lit(newest - delay)
        late_rows = df.withColumn("_late", late.cast("long"))
        counts = hourly_counts(df, ts, value)
        hour = F.date_trunc("HOUR", F.col(ts)).cast("timestamp_ntz")
        extra = late_rows.groupBy(hour.alias("of")).agg(F.sum("_late").alias("n_late"), F.max(ts).alias("newest"))
        out = counts.join(extra, F.col("window_start") == F.col("of"), "left").select("window_start", "window_end", "n_events", "total_value", "n_late", "newest")
        out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _corrections(spark: SparkSession, sink: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{CORRECTION}, batch_id long").parquet(sink)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def hourly_totals(spark: SparkSession, sink: str) -> DataFrame:
    """Windows as of now: corrections added up per window, with the number of rows that came late."""
    got = _corrections(spark, sink)
    got = spark.createDataFrame([], f"{CORRECTION}, batch_id long") if got is None else got
    return got.groupBy("window_start", "window_end").agg(F.sum("n_events").alias("n_events"), F.sum("total_value").alias("total_value"), F.sum("n_late").alias("n_late"))
