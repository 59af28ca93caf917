"""Streaming scoring and landing ingest with foreachBatch (valid rows and quarantine).

Every micro-batch overwrites its own ``batch_id=...`` folder, so a retried batch replaces its output.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import assemble, engineer_features
from ..functions.rules import clamp_round
from ..operators.models import load_bundle
from ..operators.quality import validate_rows
from ..operators.scaling import apply_scaler
from ..schema import SCALED_COLS
from ..sources import manifest

REQUEST_SCHEMA = ("event_id long, datetime timestamp_ntz, season int, holiday int, workingday int, weather int, "
                  "temp double, atemp double, humidity double, windspeed double")


def _write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def _run(stream: DataFrame, batch, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def score_rows(requests: DataFrame, model, scaler: DataFrame, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Request rows -> ``keep``, count and count_rounded by a bundle's model (Spark ML or network) and scaler."""
    from ..operators.mlp import MLPResult

    ready = assemble(apply_scaler(engineer_features(requests), scaler, SCALED_COLS, as_float=True))
    if isinstance(model, MLPResult):
        pred = model.predict(ready.withColumn("label", F.lit(None).cast("double"))).withColumnRenamed("y_pred", "prediction")
    else:
        pred = model.transform(ready)
    clamped, rounded = clamp_round("prediction")
    return pred.select(*keep, clamped.alias("count"), rounded.alias("count_rounded"))


def _pinned(spark: SparkSession, models: str, name: str, pins: str, batch_id: int) -> str:
    """The model version of a micro-batch: the one its first attempt wrote down, else the current one, written down now."""
    path = f"{pins}/batch_id={batch_id}"
    try:
        return spark.read.schema("version string").json(path).first().version
    except (AnalysisException, AttributeError):  # no pin, or an attempt that ended before it was written
        version = manifest.current(spark, models, name)
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(path)
        return version


def score_stream(spark: SparkSession, landing: str, models: str, name: str, out: str, quarantine: str,
                 checkpoint: str, files_per_batch: int | None = None) -> None:
    """Score request rows as they land with the published bundle ``name`` under ``models``.

    A micro-batch takes the version that is current when it begins and writes it down beside the
    checkpoint first, so a retried batch scores alike after a newer model was published; rows carry
    the version.
    """
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    src = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(landing)

    def batch(df: DataFrame, batch_id: int) -> None:
        own = df.sparkSession
        version = _pinned(own, models, name, f"{checkpoint}-pins", batch_id)
        model, scaler, _, _ = load_bundle(own, manifest.version_path(models, version))
        checked = validate_rows(df).persist(StorageLevel.MEMORY_AND_DISK)
        _write_batch(checked.filter(~F.col("is_valid")).drop("is_valid"), quarantine, batch_id)
        ok = checked.filter("is_valid").drop("violations", "is_valid")
        _write_batch(score_rows(ok, model, scaler).withColumn("model_version", F.lit(version)), out, batch_id)
        checked.unpersist()

    _run(src, batch, checkpoint)


def ingest_stream(spark: SparkSession, landing: str, accepted: str, rejected: str, checkpoint: str,
                  files_per_batch: int | None = None) -> None:
    """Parse landed CSV files, columns bound by each file's header.

    Rows of files that lack required columns, rows with unparseable fields and rows that fail the
    range rules go to quarantine with the reasons.
    """
    from ..sources.csv_source import NUMERIC, bind_by_name, parse_demand_strings

    reader = spark.readStream
    lines = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).text(landing)
    src = lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start"))

    def batch(df: DataFrame, batch_id: int) -> None:
        tagged = df.withColumn("_pos", F.monotonically_increasing_id())
        named = bind_by_name(tagged, ["datetime", "date", *NUMERIC]).drop("_names", "_start", "_pos")
        parsed = validate_rows(parse_demand_strings(named)).persist(StorageLevel.MEMORY_AND_DISK)
        bad = ~F.col("is_valid") | (F.size("parse_errors") > 0) | (F.size("missing") > 0) | F.col("datetime").isNull()
        _write_batch(parsed.filter(bad), rejected, batch_id)
        _write_batch(parsed.filter(~bad).drop("violations", "is_valid", "parse_errors", "missing"), accepted, batch_id)
        parsed.unpersist()

    _run(src, batch, checkpoint)
