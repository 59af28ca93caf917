"""Sinks: dataset publish, predictions, result tables, artifacts, text reports."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest


def publish_dataset(df: DataFrame, root: str, dataset_id: str | None = None) -> str:
    """Write a dataset aside under a fresh 12-hex id and publish it in the manifest: readers see all of it or nothing."""
    dataset_id = dataset_id or uuid.uuid4().hex[:12]
    manifest.publish(df.sparkSession, root, dataset_id, lambda path: df.write.parquet(path))
    return dataset_id


def read_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """The published rows of a dataset; an id that was never published is an error."""
    return spark.read.parquet(manifest.version_path(root, manifest.current(spark, root, dataset_id)))


def write_predictions(preds: DataFrame, path: str) -> str:
    """Long predictions (key, model, y_true, y_pred) as parquet, partitioned by model."""
    preds.write.mode("overwrite").partitionBy("model").parquet(path)
    return path


BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 8, 1 << 16


def write_colocated(df: DataFrame, path: str, key: str = "event_id") -> str:
    """Rows as parquet under ``path``, bucketed and sorted by ``key``: a file per bucket.

    The number of buckets is a power of two for BUCKET_ROWS rows each, and written beside the rows;
    tables of the same number of buckets join on the key where they lie. A table of fewer rows takes
    the number of another one by ``write_like``.
    """
    n = max(1, df.count())
    return _write_buckets(df, path, key, min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (-(-n // BUCKET_ROWS) - 1).bit_length())))


def write_like(df: DataFrame, path: str, other: str) -> str:
    """``write_colocated`` with the key and the number of buckets of the table at ``other``."""
    about = df.sparkSession.read.schema(_ABOUT).json(f"{other}/about").first()
    return _write_buckets(df, path, about["key"], about["buckets"])


_ABOUT = "key string, buckets int"


def _write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> str:
    name = _table_name(path)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the entry of an earlier table at this path; its files are replaced
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/rows").saveAsTable(name)
    spark.createDataFrame([(key, buckets)], _ABOUT).coalesce(1).write.mode("overwrite").json(f"{path}/about")
    return path


def _table_name(path: str) -> str:
    return "colocated_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def read_colocated(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_colocated`` with its buckets, entered into the session's catalog if another session wrote it."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        about = spark.read.schema(_ABOUT).json(f"{path}/about").first()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{about['key']}`) SORTED BY (`{about['key']}`) INTO {about['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def predictions_artifact(preds: DataFrame, metrics: DataFrame, path: str, metadata: dict | None = None) -> str:
    """Every (event_id, y_true, y_pred) row as a Parquet dataset under ``path``/rows, and one JSON row
    {metadata: {..., metrics}, n_samples} under ``path``/metadata."""
    preds.select("event_id", "y_true", "y_pred").write.mode("overwrite").parquet(f"{path}/rows")
    n = preds.sparkSession.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("n_samples"))
    given = [F.lit(v).alias(k) for k, v in (metadata or {}).items()]
    meta = metrics.select(F.struct(*given, F.struct(*METRICS).alias("metrics")).alias("metadata"))
    meta.crossJoin(n).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")  # one row each
    return path


METRICS = ["r2", "rmse", "mae", "mse", "mape"]
_METRIC_MAP = "map<string,double>"
#: An artifact is one object: a metadata object, and metrics there or at the top. Arrays y_true and
#: y_pred, or the number of rows that were written apart from it.
ARTIFACT_SCHEMA = (f"metadata struct<model_type:string, training_time:double, metrics:{_METRIC_MAP}>, metrics {_METRIC_MAP}, "
                   "y_true array<double>, y_pred array<double>, n_samples bigint")


def artifact_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics from metadata.metrics, else top-level metrics; model_type default 'mlp'; n = rows of the artifact.

    ``path`` is a JSON file, indented or not, or a folder written by ``predictions_artifact``.
    """
    a = spark.read.schema(ARTIFACT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    metrics = F.coalesce("metadata.metrics", "metrics", F.create_map().cast(_METRIC_MAP))
    return a.select(F.coalesce("metadata.model_type", F.lit("mlp")).alias("model_type"),
                    *[F.try_element_at(metrics, F.lit(k)).alias(k) for k in METRICS],
                    F.col("metadata.training_time").alias("training_time"),
                    F.coalesce("n_samples", F.size("y_true").cast("long")).alias("n_samples"))


def write_result_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Result tables (leaderboards, trials, importances, histories) as CSV/JSON, a part per task."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))
    return path


def write_text_lines(df: DataFrame, text_col: str, path: str) -> str:
    """Report lines (insights, recommendations) as text, a part per task."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)
    return path
