"""Row-level feature expressions (all JVM-side, codegen-friendly).

Every function here is a pure projection: no shuffle, no UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ENGINEERED_FLOAT_COLS, FEATURE_COLS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def calendar_parts(ts="datetime") -> dict[str, Column]:
    """hour, day of month, month, year, weekday (Monday = 0)."""
    t = _c(ts)
    return {"hour": F.hour(t), "day": F.dayofmonth(t), "month": F.month(t),
            "year": F.year(t), "weekday": F.weekday(t)}


def calendar_names(ts="datetime") -> dict[str, Column]:
    """Full English day name and day of year."""
    t = _c(ts)
    return {"day_of_week": F.date_format(t, "EEEE"), "day_of_year": F.dayofyear(t)}


def cyclic(x, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period, computed in double."""
    angle = F.lit(2.0) * F.lit(math.pi) * _c(x) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def rush_hour_flag(hour) -> Column:
    h = _c(hour)
    return (h.between(7, 9) | h.between(17, 19)).cast("int")


def weekend_flag(weekday) -> Column:
    return _c(weekday).isin(5, 6).cast("int")


# Cyclic periods of the calendar parts.
CYCLE_PERIODS = {"hour": 24, "day": 31, "month": 12, "weekday": 7}


def engineered_columns(ts="datetime", temp="temp", humidity="humidity", windspeed="windspeed",
                       as_float: bool = True) -> dict[str, Column]:
    """The 17 engineered columns, in double maths, narrowed to float32 at the end."""
    parts = calendar_parts(ts)
    cols: dict[str, Column] = dict(parts)
    for name, period in CYCLE_PERIODS.items():
        s, c = cyclic(parts[name], period)
        cols[f"{name}_sin"] = s
        cols[f"{name}_cos"] = c
    cols["is_rush_hour"] = rush_hour_flag(parts["hour"])
    cols["is_weekend"] = weekend_flag(parts["weekday"])
    cols["temp_humidity"] = _c(temp) * _c(humidity) / 100
    cols["temp_windspeed"] = _c(temp) * _c(windspeed)
    if as_float:
        cols = {k: cols[k].cast("float") for k in ENGINEERED_FLOAT_COLS}
    return cols


def engineer_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Widen each demand row by the engineered columns (one projection)."""
    return df.withColumns(engineered_columns(ts))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-numeric text becomes null, never an error; booleans become 0/1."""
    out = {}
    types = dict(df.dtypes)
    for c in cols:
        if types.get(c) == "boolean":
            out[c] = F.col(c).cast("int").cast("double")
        else:
            out[c] = F.col(c).try_cast("double")
    return df.withColumns(out)


def feature_table(df: DataFrame, keep: list[str] | None = None, target: str = "cnt") -> DataFrame:
    """Engineered rows narrowed to the 24 features in fixed order (plus key/target)."""
    eng = engineer_features(df)
    keep = keep or []
    tail = [target] if target in df.columns else []
    return eng.select(*keep, *FEATURE_COLS, *tail)


def assemble(df: DataFrame, cols: list[str] | None = None, out: str = "features") -> DataFrame:
    """Dense feature vector for Spark ML, nulls filled with 0 first."""
    from pyspark.ml.feature import VectorAssembler

    cols = cols or FEATURE_COLS
    filled = df.na.fill(0, subset=cols)
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(filled)
