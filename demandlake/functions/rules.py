"""Rule and lookup expressions: code labels, demand index, validation, levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code labels and multipliers used by the reference.
SEASON_LABELS = {1: "Spring", 2: "Summer", 3: "Fall", 4: "Winter"}
WEATHER_LABELS = {1: "Clear", 2: "Mist", 3: "Light Rain", 4: "Heavy Rain"}
SEASON_MULT = {1: 0.8, 2: 1.2, 3: 1.3, 4: 1.0}
WEATHER_MULT = {1: 1.0, 2: 0.8, 3: 0.5, 4: 0.2}
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Hour-band factors (morning rush, evening rush, daytime, night).
HOUR_BANDS = [((7, 9), 1.8), ((17, 19), 1.6), ((10, 16), 1.2)]
HOUR_NIGHT = 0.4
BASE_COUNT = 50.0
WORKDAY_FACTOR = (2.0, 1.2)  # (working day, other day)

# Accepted ranges for score requests (inclusive).
RANGE_RULES = [
    ("season", 1, 4), ("holiday", 0, 1), ("workingday", 0, 1), ("weather", 1, 4),
    ("temp", -20, 50), ("atemp", -30, 60), ("humidity", 0, 100), ("windspeed", 0, 100),
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lookup(code, mapping: dict) -> Column:
    """Literal map lookup; unknown code -> null."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, _c(code))


def hour_band_factor(hour) -> Column:
    h = _c(hour)
    expr = None
    for (lo, hi), f in HOUR_BANDS:
        expr = (F.when(h.between(lo, hi), f) if expr is None else expr.when(h.between(lo, hi), f))
    return expr.otherwise(HOUR_NIGHT)


def temp_factor(temp) -> Column:
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1.0 - F.abs(_c(temp) - 25.0) / 50.0))


def demand_index(season="season", hour=None, weather="weather", temp="temp",
                 workingday="workingday", ts="datetime") -> Column:
    """Rule-based demand: deterministic part of the reference's generator.

    The working-day factor is taken per row (the reference read it from the
    first row only). Truncated to int and clipped at 0.
    """
    h = _c(hour) if hour is not None else F.hour(_c(ts))
    wd = F.when(_c(workingday) == 1, WORKDAY_FACTOR[0]).otherwise(WORKDAY_FACTOR[1])
    raw = (F.lit(BASE_COUNT) * lookup(season, SEASON_MULT) * hour_band_factor(h)
           * lookup(weather, WEATHER_MULT) * temp_factor(temp) * wd)
    return F.greatest(raw.cast("int"), F.lit(0))


def rule_violations(rules=RANGE_RULES) -> Column:
    """Sorted-by-rule-order array of violated column names (null counts as a violation)."""
    checks = [F.when(~F.coalesce(_c(name).between(lo, hi), F.lit(False)), F.lit(name)) for name, lo, hi in rules]
    return F.array_compact(F.array(*checks))


def clamp_round(y) -> tuple[Column, Column]:
    """Prediction post-processing: clamp at 0, round half-to-even."""
    clamped = F.greatest(_c(y).cast("double"), F.lit(0.0))
    return clamped, F.bround(clamped, 0).cast("long")


def performance_level(r2, rmse) -> Column:
    r, e = _c(r2), _c(rmse)
    return (F.when((r > 0.9) & (e < 10), "Excellent")
            .when((r > 0.8) & (e < 20), "Good")
            .when((r > 0.7) & (e < 30), "Fair")
            .otherwise("Poor"))


# Recommendation texts, in the reference's order.
REC_LOW_R2 = ["- Consider increasing model complexity or adding more features",
              "- Check for data quality issues or missing important features"]
REC_HIGH_RMSE = ["- High RMSE indicates large prediction errors",
                 "- Consider ensemble methods or regularization techniques"]
REC_SLOW = ["- Long training time - consider model optimization",
            "- Use early stopping or reduce model complexity for faster training"]
REC_EXCELLENT = ["- Excellent performance! Monitor for overfitting on new data",
                 "- Consider this model for production deployment"]
REC_DEFAULT = ["- Performance is acceptable for most use cases",
               "- Continue monitoring model performance on new data"]


def recommendations(r2, rmse, training_time) -> Column:
    """Newline-joined advice from four threshold rules, default pair if none fires."""
    r, e, t = _c(r2), _c(rmse), _c(training_time)

    def block(cond: Column, lines: list[str]) -> Column:
        return F.when(cond, F.array(*[F.lit(x) for x in lines])).otherwise(F.array().cast("array<string>"))

    fired = F.concat(block(r < 0.8, REC_LOW_R2), block(e > 25, REC_HIGH_RMSE),
                     block(F.coalesce(t > 300, F.lit(False)), REC_SLOW), block(r > 0.9, REC_EXCELLENT))
    lines = F.when(F.size(fired) == 0, F.array(*[F.lit(x) for x in REC_DEFAULT])).otherwise(fired)
    return F.concat_ws("\n", lines)


def fmt(x, digits: int, suffix: str = "") -> Column:
    """Fixed-decimal text, e.g. fmt(r2, 4) -> '0.8736'; null -> 'N/A'."""
    v = _c(x)
    return F.when(v.isNull(), F.lit("N/A")).otherwise(F.concat(F.format_string(f"%.{digits}f", v), F.lit(suffix)))
