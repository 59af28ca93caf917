"""Run analytics: epoch losses, running best, early stopping, job lifecycle, feeds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PENDING, RUNNING, TERMINAL_EVENTS, TERMINAL_STATUS
from ..session import ship_package
from .order import running_agg, with_row_index


def epoch_loss(batches: DataFrame, keys=("job_id", "epoch"), loss: str = "loss") -> DataFrame:
    """Epoch loss = unweighted mean of batch losses (a short last batch counts fully)."""
    return batches.groupBy(*keys).agg(F.avg(loss).alias("epoch_loss"), F.count(F.lit(1)).alias("n_batches"))


def _record(epoch: str, loss: str) -> Column:
    """(loss, epoch) of a comparable loss; null for a null or NaN loss, which never beats anything."""
    v = F.col(loss).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.struct(v.alias("loss"), F.col(epoch).alias("epoch")))


def _with_best(log: DataFrame, job: str, epoch: str, loss: str, num_partitions: int | None) -> DataFrame:
    """``_best`` = smallest (loss, epoch) so far: the best loss and the first epoch that had it, in one pass."""
    return running_agg(log, [job], [epoch], [("_best", "min", _record(epoch, loss), True)], num_partitions)


def _is_best(epoch: str) -> Column:
    return F.coalesce(F.col("_best.epoch") == F.col(epoch), F.lit(False))


def best_so_far(log: DataFrame, job: str = "job_id", epoch: str = "epoch", loss: str = "val_loss",
                num_partitions: int | None = None) -> DataFrame:
    """best_val_loss = running minimum; is_best = strictly below every earlier epoch (first epoch true).

    Null and NaN losses are never a best and leave the best as it is (null before the first one).
    """
    r = _with_best(log, job, epoch, loss, num_partitions)
    return r.withColumns({"best_val_loss": F.col("_best.loss"), "is_best": _is_best(epoch)}).drop("_best")


def _cut_at_stop(counted: DataFrame, patience: int, job: str, epoch: str) -> DataFrame:
    """Keep each job's rows up to its first one whose patience_counter reaches ``patience``."""
    stops = counted.filter(F.col("patience_counter") >= patience).groupBy(F.col(job).alias("_of")).agg(F.min(epoch).alias("stop_epoch"))
    out = counted.join(stops, F.col(job).eqNullSafe(F.col("_of")), "left").drop("_of")
    return (out.filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
            .withColumn("stopped", F.coalesce(F.col(epoch) == F.col("stop_epoch"), F.lit(False))))


def early_stop(log: DataFrame, patience: int = 20, job: str = "job_id", epoch: str = "epoch",
               loss: str = "val_loss", num_partitions: int | None = None) -> DataFrame:
    """Patience counter (epochs since the last best) and truncation at the stop epoch.

    The stop epoch is the first with counter >= patience; it is kept, later
    rows are dropped. Epochs are assumed consecutive from 0 per job. One range
    pass gives the best, its epoch and so the counter; the stop epochs, one row
    per job, are joined back (adaptive execution splits a hot job there).
    """
    r = _with_best(log, job, epoch, loss, num_partitions)
    since = F.col(epoch) - F.coalesce(F.col("_best.epoch"), F.lit(-1))
    c = r.withColumns({"best_val_loss": F.col("_best.loss"), "is_best": _is_best(epoch),
                       "patience_counter": since.cast("int")}).drop("_best")
    return _cut_at_stop(c, patience, job, epoch)


def _accepted(records: DataFrame, min_delta: float) -> DataFrame:
    """(job, epoch) of the records that beat the last accepted one by ``min_delta``.

    Records come sorted by job and epoch and are folded as they stream by; a
    task holds one Arrow batch and one number, however many records a job has.
    """
    def fold(batches):
        job, best, seen = None, float("inf"), False
        for b in batches:
            keep = []
            for j, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if not seen or j != job:
                    job, best, seen = j, float("inf"), True
                ok = v < best - min_delta
                best = v if ok else best
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    ship_package(records.sparkSession)
    types = records.schema
    schema = T.StructType([T.StructField("_job", types[0].dataType), T.StructField("_epoch", types[1].dataType)])
    job, epoch, _ = records.columns
    return records.repartition(job).sortWithinPartitions(job, epoch).mapInArrow(
        lambda it: (pa.RecordBatch.from_arrays(x.columns, names=["_job", "_epoch"]) for x in fold(it)), schema)


def early_stop_delta(log: DataFrame, patience: int = 10, min_delta: float = 1e-4, job: str = "job_id",
                     epoch: str = "epoch", loss: str = "val_loss", num_partitions: int | None = None) -> DataFrame:
    """Early stopping where a new best must beat the *accepted* best by min_delta.

    The accepted best depends on its own history, but an accepted best is always
    a strict running minimum, so only those records are folded in order; the
    counter then follows from a running maximum of the accepted epochs.
    """
    rows = log.select(F.col(job).cast("long").alias(job), F.col(epoch).cast("int").alias(epoch), F.col(loss).cast("double").alias(loss))
    strict = _with_best(rows, job, epoch, loss, num_partitions).filter(_is_best(epoch)).select(job, epoch, loss)
    marked = rows.join(_accepted(strict, min_delta), (F.col(job).eqNullSafe(F.col("_job"))) & (F.col(epoch) == F.col("_epoch")), "left").drop("_job")
    offer = F.when(F.col("_epoch").isNotNull(), F.struct(F.col(epoch).alias("epoch"), F.col(loss).alias("loss")))
    r = running_agg(marked, [job], [epoch], [("_last", "max", offer, True)], num_partitions)
    since = F.col(epoch) - F.coalesce(F.col("_last.epoch"), F.lit(-1))
    c = r.select(job, epoch, loss, F.col("_last.loss").alias("best_loss"), F.col("_epoch").isNotNull().alias("is_best"),
                 since.cast("int").alias("patience_counter"))
    return _cut_at_stop(c, patience, job, epoch).drop("stop_epoch")


def job_status(events: DataFrame, job: str = "job_id", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Fold a lifecycle feed to one status per job: first terminal event wins (by ts, seq).

    Without a terminal event a job is running once any event arrived. One
    algebraic aggregate per job (partial aggregation absorbs hot jobs).
    """
    terminal = F.col("event").isin(*TERMINAL_EVENTS)
    key = F.struct(F.col(ts), F.col(seq))
    agg = events.groupBy(job).agg(
        F.min_by(F.when(terminal, F.col("event")), F.when(terminal, key)).alias("terminal_event"),
        F.min(F.when(terminal, key)).alias("_tkey"),
        F.count(F.lit(1)).alias("n_events"))
    status_map = F.create_map(*[x for k, v in TERMINAL_STATUS.items() for x in (F.lit(k), F.lit(v))])
    status = F.coalesce(F.try_element_at(status_map, F.col("terminal_event")),
                        F.when(F.col("n_events") > 0, F.lit(RUNNING)).otherwise(F.lit(PENDING)))
    return agg.select(job, status.alias("status"), "terminal_event",
                      F.col("_tkey")[seq].alias("terminal_seq"), F.col("_tkey")[ts].alias("terminal_ts"))


def progress_feed(events: DataFrame, job: str = "job_id", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Batch twin of the live feed: each job's events (deduplicated) up to its first terminal event.

    The per-job terminal cut-off is a small aggregate joined back on the job
    key (AQE splits a hot job's partition in that join).
    """
    dedup = events.dropDuplicates([job, seq])
    # duplicates cannot move a minimum: the cut is folded from the raw feed (no second dedupe shuffle)
    cut = job_status(events, job, seq, ts).select(F.col(job).alias("_of"), "terminal_ts", "terminal_seq")
    joined = dedup.join(cut, F.col(job).eqNullSafe(F.col("_of")), "left").drop("_of")
    before = (F.col("terminal_ts").isNull() | (F.col(ts) < F.col("terminal_ts"))
              | ((F.col(ts) == F.col("terminal_ts")) & (F.col(seq) <= F.col("terminal_seq"))))
    return joined.filter(before).drop("terminal_ts", "terminal_seq")


def event_payload(rows: DataFrame, fields: list[str], schema: str) -> DataFrame:
    """Encode fields as a JSON payload and decode it back (round trip of the event envelope)."""
    enc = rows.withColumn("payload", F.to_json(F.struct(*fields)))
    return enc.withColumn("decoded", F.from_json("payload", schema))


def jobs_newest(jobs: DataFrame, created: str = "created_at", job: str = "job_id",
                num_partitions: int | None = None) -> DataFrame:
    """Jobs newest first as a dense position (ties: larger id first), no single-task sort."""
    return with_row_index(jobs, [F.col(created).desc(), F.col(job).desc()], "position", num_partitions)


def current_metrics(jobs: DataFrame, created: str = "created_at", job: str = "job_id",
                    started: str | None = None, finished: str | None = None) -> DataFrame:
    """Newest completed job that has metrics; duration finished-started with 0 -> null."""
    ok = jobs.filter((F.col("status") == "completed") & F.col("r2").isNotNull())
    key = F.struct(F.col(created), F.col(job))
    cols = [F.max_by(F.col(job), key).alias("job_id"), F.max_by(F.col("model_type"), key).alias("model_type"),
            F.max_by(F.col("r2"), key).alias("r2"), F.max(key)[created].alias("created_at")]
    if started and finished:
        dur = F.col(finished) - F.col(started)
        cols.append(F.max_by(F.when(dur != 0, dur), key).alias("training_time"))
    return ok.agg(*cols).filter(F.col("job_id").isNotNull())
