"""Declared schemas and fixed column lists."""

from __future__ import annotations

from pyspark.sql import types as T

# Demand record as landed by the CSV source (target renamed count -> cnt).
DEMAND_SCHEMA = T.StructType(
    [
        T.StructField("datetime", T.TimestampNTZType(), True),
        T.StructField("season", T.IntegerType(), True),
        T.StructField("holiday", T.IntegerType(), True),
        T.StructField("workingday", T.IntegerType(), True),
        T.StructField("weather", T.IntegerType(), True),
        T.StructField("temp", T.DoubleType(), True),
        T.StructField("atemp", T.DoubleType(), True),
        T.StructField("humidity", T.DoubleType(), True),
        T.StructField("windspeed", T.DoubleType(), True),
        T.StructField("cnt", T.IntegerType(), True),
    ]
)

# Fixed values (must match the reference for equal results):
# columns required on upload, in the reference's order.
REQUIRED_COLUMNS = ["datetime", "season", "holiday", "workingday", "weather",
                    "temp", "atemp", "humidity", "windspeed", "count"]

# The 24 model features in their fixed order.
FEATURE_COLS = [
    "season", "holiday", "workingday", "weather",
    "temp", "atemp", "humidity", "windspeed",
    "hour", "day", "month", "weekday",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "month_sin", "month_cos", "weekday_sin", "weekday_cos",
    "is_rush_hour", "is_weekend", "temp_humidity", "temp_windspeed",
]

# Engineered columns narrowed to float32.
ENGINEERED_FLOAT_COLS = [
    "hour", "day", "month", "year", "weekday",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "month_sin", "month_cos", "weekday_sin", "weekday_cos",
    "is_rush_hour", "is_weekend", "temp_humidity", "temp_windspeed",
]

# Standardised numeric features.
SCALED_COLS = ["temp", "atemp", "humidity", "windspeed", "temp_humidity", "temp_windspeed"]

# Columns in the correlation matrix.
CORR_COLS = ["season", "holiday", "workingday", "weather", "temp", "atemp",
             "humidity", "windspeed", "cnt", "hour", "month"]

# Terminal job event -> job status, and the states before one.
TERMINAL_STATUS = {"done": "completed", "cancelled": "cancelled", "error": "failed"}
TERMINAL_EVENTS = list(TERMINAL_STATUS)
RUNNING, PENDING = "running", "pending"
