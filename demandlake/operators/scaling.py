"""Standardisation and null handling with one-row statistics broadcast to all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SCALED_COLS


def fit_scaler(df: DataFrame, cols: list[str] = SCALED_COLS) -> DataFrame:
    """One-row state: mean and population std per column (zero std stored as 1)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        sd = F.stddev_pop(x)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}__std")]
    return df.agg(*aggs)


def scaler_long(state: DataFrame, cols: list[str] = SCALED_COLS) -> DataFrame:
    """(column, mean, std) rows of a scaler state."""
    return state.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"))
        for c in cols])))


def apply_scaler(df: DataFrame, state: DataFrame, cols: list[str] = SCALED_COLS, as_float: bool = False) -> DataFrame:
    """(x - mean) / std with the stored state (a broadcast one-row join, no shuffle)."""
    joined = df.crossJoin(F.broadcast(state))
    scaled = {}
    for c in cols:
        v = (F.col(c).cast("double") - F.col(f"{c}__mean")) / F.col(f"{c}__std")
        scaled[c] = v.cast("float") if as_float else v
    drop = [f"{c}__{s}" for c in cols for s in ("mean", "std")]
    return joined.withColumns(scaled).drop(*drop)


def scale_numeric(df: DataFrame, cols: list[str] = SCALED_COLS, fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise ``cols``; statistics from ``fit_on`` (e.g. the train split) or from ``df``."""
    return apply_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols), cols)


def fill_nulls(df: DataFrame, feature_cols: list[str], target: str) -> DataFrame:
    """Features: null -> 0. Target: null -> mean of the non-null targets (one-row broadcast)."""
    mean = df.agg(F.avg(F.col(target).cast("double")).alias("_ymean"))
    filled = df.na.fill(0, subset=feature_cols).crossJoin(F.broadcast(mean))
    return filled.withColumn(target, F.coalesce(F.col(target).cast("double"), F.col("_ymean"))).drop("_ymean")
