"""Structured Streaming twins of the run-history operators.

* ``progress_stream``: job events landed as JSON files -> dedupe on
  (job_id, seq) with keyed state -> parquet sink; the terminal cut of each
  job's feed is the batch fold over the sink (``runs.progress_feed``).
* ``early_stop_stream``: per-job running best / patience counter as epochs
  arrive, with ``applyInPandasWithState`` (duplicates dropped, gaps held
  until the missing epoch lands).
All queries run with ``trigger(availableNow=True)`` so a job can be re-run
incrementally from its checkpoint after a failure.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..schema import PENDING, RUNNING, TERMINAL_STATUS
from ..session import scratch_path, ship_package

NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # JSON default keeps only milliseconds
JOB_EVENT_SCHEMA = "job_id long, seq long, ts timestamp_ntz, event string, data string"
EPOCH_SCHEMA = "job_id long, epoch int, train_loss double, val_loss double"


def land(df: DataFrame, path: str, files: int = 4, fmt: str = "json") -> str:
    """Write rows as a few files into a landing folder (test/bench helper)."""
    df.repartition(files).write.mode("append").format(fmt).option("timestampNTZFormat", NTZ_FORMAT).save(path)
    return path


def run_available_now(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append") -> str:
    q = (stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return sink


def progress_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, files_per_batch: int | None = None) -> str:
    """Deduplicate landed job events on (job_id, seq) into a parquet sink.

    The keys seen are state, hashed over all tasks and kept for good: an event
    may land any time later than its own time and is neither lost nor repeated.
    """
    reader = spark.readStream.schema(JOB_EVENT_SCHEMA).option("timestampNTZFormat", NTZ_FORMAT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return run_available_now(reader.json(landing).dropDuplicates(["job_id", "seq"]), sink, checkpoint)


# epochs that landed before an earlier one did wait in two arrays of equal length
STATE_SCHEMA = "last_epoch int, best double, counter int, stopped boolean, epochs array<int>, losses array<double>"
OUT_SCHEMA = ("job_id long, epoch int, val_loss double, best_val_loss double, is_best boolean, "
              "patience_counter int, stopped boolean")


def _early_stop_fn(patience: int):
    def fn(key, pdfs, state):
        if state.exists:
            last, best, counter, stopped, epochs, losses = state.get
            waiting = dict(zip(epochs, losses))
        else:
            last, best, counter, stopped, waiting = -1, None, 0, False, {}
        for p in pdfs:
            for e, v in zip(p["epoch"].tolist(), p["val_loss"].tolist()):
                if e > last:
                    waiting.setdefault(int(e), None if pd.isna(v) else float(v))
        rows = []
        while not stopped and last + 1 in waiting:  # a gap holds back what comes after it
            last += 1
            v = waiting.pop(last)
            is_best = v is not None and (best is None or v < best)
            best, counter = (v, 0) if is_best else (best, counter + 1)
            stopped = counter >= patience
            rows.append((key[0], last, v, best, is_best, counter, stopped))
        if stopped:  # nothing is emitted after the stop
            waiting = {}
        state.update((last, best, counter, stopped, list(waiting), list(waiting.values())))
        yield pd.DataFrame(rows, columns=["job_id", "epoch", "val_loss", "best_val_loss", "is_best",
                                          "patience_counter", "stopped"])
    return fn


def early_stop_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, patience: int = 20,
                      files_per_batch: int | None = None) -> str:
    """Stateful per-job early stopping over a stream of epoch rows."""
    ship_package(spark)
    reader = spark.readStream.schema(EPOCH_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ep = reader.json(landing)
    out = ep.groupBy("job_id").applyInPandasWithState(
        _early_stop_fn(patience), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    return run_available_now(out, sink, checkpoint)


def scratch_stream_dirs(spark: SparkSession, name: str) -> tuple[str, str, str]:
    base = scratch_path(spark, name)
    return f"{base}/landing", f"{base}/sink", f"{base}/checkpoint"


STATUS_STATE = "terminal_event string, terminal_ts timestamp_ntz, terminal_seq long, n_events long, version long"
STATUS_OUT = ("job_id long, status string, terminal_event string, terminal_seq long, terminal_ts timestamp_ntz, "
              "version long")

def _status_fn(key, pdfs, state):
    job_id = key[0]
    if state.exists:
        t_event, t_ts, t_seq, n, version = state.get
    else:
        t_event, t_ts, t_seq, n, version = None, None, None, 0, 0
    for pdf in pdfs:
        n += len(pdf)
        term = pdf[pdf["event"].isin(list(TERMINAL_STATUS))]
        if len(term):
            first = term.sort_values(["ts", "seq"], kind="mergesort").iloc[0]
            cand = (pd.Timestamp(first["ts"]), int(first["seq"]))
            if t_ts is None or cand < (pd.Timestamp(t_ts), int(t_seq)):  # first terminal (by ts, seq) wins
                t_event, t_ts, t_seq = first["event"], cand[0], cand[1]
    version += 1
    state.update((t_event, None if t_ts is None else pd.Timestamp(t_ts).to_pydatetime(),
                  None if t_seq is None else int(t_seq), int(n), int(version)))
    status = TERMINAL_STATUS.get(t_event) if t_event else (RUNNING if n > 0 else PENDING)
    yield pd.DataFrame([{"job_id": job_id, "status": status, "terminal_event": t_event, "terminal_seq": t_seq,
                         "terminal_ts": None if t_ts is None else pd.Timestamp(t_ts), "version": version}])


def job_status_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, files_per_batch: int = 1) -> str:
    """Lifecycle fold as events arrive; each micro-batch appends the job's new state (versioned)."""
    ship_package(spark)
    ev = (spark.readStream.schema(JOB_EVENT_SCHEMA).option("timestampNTZFormat", NTZ_FORMAT)
          .option("maxFilesPerTrigger", files_per_batch).json(landing))
    out = ev.groupBy("job_id").applyInPandasWithState(_status_fn, STATUS_OUT, STATUS_STATE, "append",
                                                      GroupStateTimeout.NoTimeout)
    return run_available_now(out, sink, checkpoint)


def latest_status(spark: SparkSession, sink: str) -> DataFrame:
    """Current status per job: the highest state version in the sink (one aggregate)."""
    s = spark.read.schema(STATUS_OUT).parquet(sink)
    latest = F.max_by(F.struct("status", "terminal_event", "terminal_seq", "terminal_ts"), "version")
    return s.groupBy("job_id").agg(latest.alias("s")).select("job_id", "s.*")
