"""Ordering core: row index, chronological split, expanding folds, tails, samples.

Spark rows have no position, so every operator here takes an explicit total
order (time column + unique key). None of them sorts all rows in one task:
the index is built like ``zipWithIndex`` on DataFrames -- range-partition on
the total order (bounds are sampled on the full key, so a hot timestamp is
split by its tie-break key), number rows inside each partition, and add the
running count of the partitions before it (a table with one row per
partition, broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .select import keys_at, selectable

_PID_SHIFT = 33  # monotonically_increasing_id = (partition id << 33) + position


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row_index(df: DataFrame, order_cols: list, name: str = "idx", num_partitions: int | None = None,
                   total_col: str | None = None) -> DataFrame:
    """Add a dense 0..n-1 index following ``order_cols`` (must be a total order).

    One range shuffle; partition offsets are a broadcast table with one row
    per partition, so nothing row-level reaches a single task or the driver.
    """
    n = _partitions(df, num_partitions)
    cols = df.columns
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = ranged.select("*", F.spark_partition_id().alias("_pid"),
                           F.monotonically_increasing_id().alias("_mid"))
    # Range bounds are sampled with a per-run seed, so partition ids and
    # positions are not reproducible across evaluations (or task retries
    # after a lost executor). Materialise them once in the shared checkpoint
    # folder so the counts and the rows always agree.
    ensure_checkpoint_dir(df.sparkSession)
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(everything).alias("_total"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _PID_SHIFT)
    out = [*cols, (F.col("_off") + pos).alias(name)]
    if total_col:
        out.append(F.col("_total").alias(total_col))
    return tagged.join(F.broadcast(offsets), "_pid").select(*out)


def split_bounds(total: Column, test_size: float, val_size: float) -> tuple[Column, Column]:
    """(n_train, n_train + n_val) as columns; n_test = floor(n*t), n_val = floor(n*v)."""
    n_test = F.floor(total * F.lit(float(test_size)))
    n_val = F.floor(total * F.lit(float(val_size)))
    n_train = total - n_test - n_val
    return n_train, n_train + n_val


def time_split(df: DataFrame, order_cols: list, test_size: float = 0.2, val_size: float = 0.2,
               name: str = "split", index_col: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Chronological train/val/test label per row; fails lazily if train would be empty."""
    ix = with_row_index(df, order_cols, index_col, num_partitions, total_col="_total")
    n_train, n_head = split_bounds(F.col("_total"), test_size, val_size)
    label = (F.when(n_train <= 0, F.raise_error(F.concat(
        F.lit(f"Invalid split sizes: test={test_size}, val={val_size} leaves "), n_train.cast("string"),
        F.lit(" training samples"))))
        .when(F.col(index_col) < n_train, "train")
        .when(F.col(index_col) < n_head, "val")
        .otherwise("test"))
    return ix.withColumn(name, label).drop("_total")


def rows_at(df: DataFrame, order_cols: list[str], positions, num_partitions: int | None = None) -> DataFrame:
    """One row: ``n`` and ``keys``, the order keys at the given positions of the total order.

    ``positions(n)`` gives a list. Keys of numbers and times are selected by counting
    (``select.keys_at``); of keys of other types the key columns alone are indexed.
    """
    if selectable(df, order_cols):
        n, keys = keys_at(df, order_cols, positions)
        got = [F.struct(*[k.alias(c) for k, c in zip(keys[r], order_cols)]) for r in sorted(keys)]
        none = F.array().cast(T.ArrayType(df.select(*order_cols).schema))
        return df.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), (F.array(*got) if got else none).alias("keys"))
    n = df.count()
    ix = with_row_index(df.select(*order_cols), order_cols, "_idx", num_partitions, total_col="_total")
    hit = F.col("_idx").isin(*positions(n)) if positions(n) else F.lit(False)
    return ix.agg(F.max("_total").alias("n"), F.array_sort(F.collect_list(F.when(hit, F.struct(*order_cols)))).alias("keys"))


def label_split(df: DataFrame, order_cols: list[str], test_size: float = 0.2, val_size: float = 0.2,
                name: str = "split", num_partitions: int | None = None) -> DataFrame:
    """``time_split``'s label by two boundary keys: a projection, no shuffle of the rows themselves."""
    def starts(n: int) -> list[int]:
        n_test, n_val = int(n * test_size // 1), int(n * val_size // 1)
        return [n - n_test - n_val, n - n_test]

    at = rows_at(df, order_cols, starts, num_partitions)
    n_train, n_head = split_bounds(F.col("n"), test_size, val_size)
    bound = at.select(n_train.alias("_n_train"), F.when(n_train < n_head, F.get("keys", F.lit(0))).alias("_val"),
                      F.when(n_head < F.col("n"), F.get("keys", F.when(n_train < n_head, F.lit(1)).otherwise(F.lit(0)))).alias("_test"))
    key = F.struct(*order_cols)
    label = (F.when(F.col("_n_train") <= 0, F.raise_error(F.lit(
        f"Invalid split sizes: test={test_size}, val={val_size} leaves no training samples")))
        .when(key >= F.col("_test"), "test").when(key >= F.col("_val"), "val").otherwise("train"))
    return df.crossJoin(F.broadcast(bound)).withColumn(name, label).drop("_n_train", "_val", "_test")


def label_folds(df: DataFrame, order_cols: list[str], k: int = 5, num_partitions: int | None = None) -> DataFrame:
    """``ts_folds``' columns by k boundary keys: a projection, no shuffle of the rows themselves."""
    def starts(n: int) -> list[int]:
        b = n // (k + 1)
        return [n - k * b + f * b for f in range(k)] if b else []

    at = rows_at(df, order_cols, starts, num_partitions)
    few = F.floor(F.col("n") / F.lit(k + 1)) <= 0
    bound = at.select(F.when(few, F.raise_error(F.lit(f"Cannot make {k} folds: too few rows"))).otherwise(F.col("keys")).alias("_starts"))
    key = F.struct(*order_cols)
    fold = F.size(F.filter("_starts", lambda s: s <= key)) - 1
    test_fold = F.when(fold >= 0, fold)
    train_from = F.when(fold < 0, F.lit(0)).when(fold + 1 < k, fold + 1)
    return df.crossJoin(F.broadcast(bound)).withColumns({"test_fold": test_fold, "train_from_fold": train_from}).drop("_starts")


def ts_folds(df: DataFrame, order_cols: list, k: int = 5, index_col: str = "idx",
             num_partitions: int | None = None) -> DataFrame:
    """Expanding-window folds without copying rows k times.

    Fold f tests the block [start + f*b, start + (f+1)*b) with b = n // (k+1),
    start = n - k*b, and trains on everything before its block. Each row gets
    ``test_fold`` (or null) and ``train_from_fold``: it is a training row of
    every fold >= that value (null = never). Fold f's train set is
    ``train_from_fold <= f``; its test set is ``test_fold == f``.
    """
    ix = with_row_index(df, order_cols, index_col, num_partitions, total_col="_total")
    b = F.floor(F.col("_total") / F.lit(k + 1))
    start = F.col("_total") - F.lit(k) * b
    i = F.col(index_col)
    checked_b = F.when(b <= 0, F.raise_error(F.lit(f"Cannot make {k} folds: too few rows"))).otherwise(b)
    test_fold = F.when(i >= start, ((i - start) / checked_b).cast("long").cast("int"))
    train_from = F.when(i < start, F.lit(0)).when(test_fold + 1 < k, test_fold + 1)
    return ix.withColumns({"test_fold": test_fold, "train_from_fold": train_from.cast("int")}).drop("_total")


def fold_sets(folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) frames of one fold from ``ts_folds`` output."""
    return (folded.filter(F.col("train_from_fold") <= fold), folded.filter(F.col("test_fold") == fold))


def _from_key(df: DataFrame, order_cols: list[str], at: DataFrame, below: bool) -> DataFrame:
    """Rows before (or from) the first key of ``at``; all (or none) if it has no key: a filter, no shuffle."""
    bound = at.select(F.get("keys", F.lit(0)).alias("_key"))
    key = F.struct(*order_cols)
    keep = (F.col("_key").isNull() | (key < F.col("_key"))) if below else key >= F.col("_key")
    return df.crossJoin(F.broadcast(bound)).where(keep).drop("_key")


def tail_slice(df: DataFrame, order_cols: list[str], n: int = 5000, num_partitions: int | None = None) -> DataFrame:
    """Last n rows, ascending in time (ties broken by the key in order_cols), for every n alike.

    The key at which they begin is selected by counting; only the n rows are sorted.
    """
    at = rows_at(df, order_cols, lambda total: [max(0, total - n)] if n else [], num_partitions)
    return _from_key(df, order_cols, at, below=False).orderBy(*order_cols)


def head_slice(df: DataFrame, order_cols: list[str], n: int = 168, num_partitions: int | None = None) -> DataFrame:
    """First n rows, ascending in time, for every n alike."""
    at = rows_at(df, order_cols, lambda total: [n], num_partitions)
    return _from_key(df, order_cols, at, below=True).orderBy(*order_cols)


def sample_hash(key: str, seed: int) -> Column:
    """60 bits of md5 of seed and key, as a long: the order in which samples take rows."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def exact_sample(df: DataFrame, key: str, n: int | None = None, fraction: float | None = None,
                 seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    """Repeatable sample without replacement of exactly n (or floor(N*fraction)) rows of distinct keys.

    Rows are taken in the order of a seeded hash of the key, so nested sizes nest; the hash at which a
    sample ends is selected by counting, and the rows are filtered by it.
    """
    hashed = df.withColumn("_h", sample_hash(key, seed))
    at = rows_at(hashed, ["_h", key], lambda total: [n if n is not None else int(total * fraction // 1)], num_partitions)
    return _from_key(hashed, ["_h", key], at, below=True).drop("_h")


def synth_datetime(df: DataFrame, order_cols: list, start: str = "2011-01-01 00:00:00",
                   num_partitions: int | None = None) -> DataFrame:
    """Datetime fallback: keep ``datetime``; else parse ``date``; else hourly stamps by position."""
    if "datetime" in df.columns:
        return df.withColumn("datetime", F.col("datetime").cast("timestamp_ntz")
                             if dict(df.dtypes)["datetime"] != "string" else F.to_timestamp_ntz("datetime"))
    if "date" in df.columns:
        col = F.col("date")
        parsed = F.to_timestamp_ntz(col) if dict(df.dtypes)["date"] == "string" else col.cast("timestamp_ntz")
        return df.withColumn("datetime", parsed)
    ix = with_row_index(df, order_cols, "_pos", num_partitions)
    stamp = F.timestamp_add("HOUR", F.col("_pos"), F.lit(start).cast("timestamp_ntz"))
    return ix.withColumn("datetime", stamp).drop("_pos")


_AGGS = {"min": (F.min, F.least), "max": (F.max, F.greatest),
         "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def running_agg(df: DataFrame, keys: list[str], order: list, specs: list[tuple[str, str, Column, bool]],
                num_partitions: int | None = None) -> DataFrame:
    """Skew-safe running min/max/sum per key group, following ``order``.

    ``specs`` = [(out_col, 'min'|'max'|'sum', value, inclusive)]; ``inclusive=False``
    aggregates strictly earlier rows only. A plain window partitioned by the
    key puts a hot key's rows in one task; here rows are range-partitioned on
    (key, order) so a hot key spans many partitions ("chunks"), each chunk
    runs its own window, and the aggregate of all earlier chunks of the same
    key (a table with one row per key and chunk) is joined back. A null key is
    a key like any other.
    """
    n = _partitions(df, num_partitions)
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
    # chunk ids come from sampled range bounds: fix them once (see with_row_index)
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    frame_end = {True: Window.currentRow, False: -1}
    w_local = Window.partitionBy(*keys, "_pid").orderBy(*order)
    local_cols, tot_cols, pre_cols = {}, [], []
    for out, how, value, inclusive in specs:
        agg, _ = _AGGS[how]
        local_cols[f"_loc_{out}"] = agg(value).over(w_local.rowsBetween(Window.unboundedPreceding, frame_end[inclusive]))
        tot_cols.append(agg(value).alias(f"_tot_{out}"))
    local = ranged.withColumns(local_cols)
    totals = ranged.groupBy(*keys, "_pid").agg(*tot_cols)
    w_chunks = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    for out, how, _, _ in specs:
        agg, _ = _AGGS[how]
        pre_cols.append(agg(f"_tot_{out}").over(w_chunks).alias(f"_pre_{out}"))
    prefix = totals.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_chunk"), *pre_cols)
    same = F.col("_pid") == F.col("_chunk")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = local.join(prefix, same, "left")
    result = {}
    for out, how, _, _ in specs:
        _, combine = _AGGS[how]
        result[out] = combine(F.col(f"_pre_{out}"), F.col(f"_loc_{out}"))  # least/greatest skip nulls
    drop = ["_pid", "_chunk", *[f"_key{i}" for i in range(len(keys))]] + [f"_loc_{o}" for o, *_ in specs] + [f"_pre_{o}" for o, *_ in specs]
    return joined.withColumns(result).drop(*drop)
