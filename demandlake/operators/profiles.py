"""Profiling: describe, moments, group profiles, correlations, histograms, box/QQ data.

Each profile is one aggregate pass (partial aggregation map-side, one small
final merge) followed by an unpivot of the one-row result, so the cost is a
single scan regardless of how many statistics are asked for.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DAY_ORDER, SEASON_LABELS, WEATHER_LABELS, lookup
from ..session import ensure_checkpoint_dir
from .select import values_at

QUARTILES = [0.25, 0.5, 0.75]
MAX_BROADCAST_GROUPS = 10_000
COMPILED_FIELDS = 90  # Spark interprets an aggregate with more than 100 fields


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def number(col) -> Column:
    """The column as a double, NaN as null: statistics skip both alike."""
    return F.nullif(_c(col).cast("double"), F.lit(float("nan")))


def quantiles(col, probs: list[float], method: str = "exact", accuracy: int = 10000) -> Column:
    """Array of quantiles with linear interpolation.

    ``exact`` keeps a value->count map per partial aggregate (bounded by the
    number of distinct values, right for coded/rounded measures); ``approx``
    is the Greenwald-Khanna sketch for unbounded domains.
    """
    if method == "approx":
        return F.percentile_approx(_c(col), probs, accuracy).cast("array<double>")
    return F.percentile(_c(col), probs)


def rank_quantiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """Exact interpolated quantiles of one column; one row out, columns q0..qk."""
    q = F.col(f"{col}__q")
    return column_quantiles(df, [col], probs).select(*[q[i].alias(f"q{i}") for i in range(len(probs))])


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """One row with ``<col>__q``: exact interpolated quantiles of each column, null and NaN skipped (null array if nothing is left).

    The two ranks around each quantile are selected by counting (``select.values_at``): no sort and
    no shuffle of values, for any number of distinct ones.
    """
    def ranks(n: int) -> list[int]:
        return [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]

    got = values_at(df, {c: number(c) for c in cols}, dict.fromkeys(cols, ranks))
    out = []
    for c in cols:
        n, at = got[c]
        row = []
        for p in probs if n else []:
            h = (n - 1) * p
            lo, hi = at[math.floor(h)][0], at[math.ceil(h)][0]
            row.append(lo + (h - math.floor(h)) * (hi - lo) if hi != lo else lo)
        out.append((F.array(*map(F.lit, row)) if n else F.lit(None)).cast("array<double>").alias(f"{c}__q"))
    return df.sparkSession.range(1).select(*out)


def describe_long(df: DataFrame, cols: list[str], ts_col: str | None = None) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (interpolated), max per column, one row per column.

    One aggregate pass and one quantile pass over all columns; a timestamp
    column is described in epoch seconds.
    """
    # epoch microseconds of the wall clock (NTZ: no session time zone involved)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts_col)) if ts_col else None
    ranked = df.select(*cols, *([(micros / 1e6).alias("_ts")] if ts_col else []))
    quart = F.broadcast(column_quantiles(ranked, ranked.columns, QUARTILES))
    aggs = []
    for c in cols:
        x = number(c)
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs).crossJoin(quart)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                     F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                     F.col(f"{c}__min").alias("min"), F.col(f"{c}__q")[0].alias("p25"),
                     F.col(f"{c}__q")[1].alias("p50"), F.col(f"{c}__q")[2].alias("p75"),
                     F.col(f"{c}__max").alias("max")) for c in cols]
    out = wide.select(F.inline(F.array(*rows)))
    if ts_col:
        base = df.select(micros.alias("us"), (micros / 1e6).alias("s"))
        head = base.agg(F.count("s").alias("count"),
                        (F.avg(F.col("us").cast("decimal(20,0)")).cast("double") / 1e6).alias("mean"),
                        F.min("s").alias("min"), F.max("s").alias("max"))
        ts_row = head.crossJoin(quart.select("_ts__q")).select(
            F.lit(ts_col).alias("column"), "count", "mean", F.lit(None).cast("double").alias("std"), "min",
            F.col("_ts__q")[0].alias("p25"), F.col("_ts__q")[1].alias("p50"), F.col("_ts__q")[2].alias("p75"), "max")
        out = out.unionByName(ts_row)
    return out


def missing_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null (and NaN) count per column, only columns with at least one."""
    cols = cols or df.columns
    types = dict(df.dtypes)

    def missing(c):
        cond = F.col(c).isNull()
        if types[c] in ("double", "float"):
            cond = cond | F.isnan(c)
        return F.count_if(cond)

    wide = df.agg(*[missing(c).alias(c) for c in cols])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"))
                                          for c in cols])))
    return long.filter(F.col("missing") > 0)


def quality_checks(df: DataFrame, record_cols: list[str], target: str = "cnt") -> DataFrame:
    """Duplicate rows beyond the first (null = null), zero and negative targets."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(target) == 0).alias("zero_targets"),
                    F.count_if(F.col(target) < 0).alias("negative_targets"))
    distinct = df.select(*record_cols).distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    return counts.crossJoin(distinct).select(
        "rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"), "zero_targets", "negative_targets")


def dataset_summary(df: DataFrame, ts: str = "datetime", target: str = "cnt") -> DataFrame:
    """Shape, date range (ISO text) and target mean/std/min/max."""
    y = number(target)
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.date_format(F.min(ts), iso).alias("start"), F.date_format(F.max(ts), iso).alias("end"),
        F.avg(y).alias("target_mean"), F.stddev_samp(y).alias("target_std"),
        F.min(y).alias("target_min"), F.max(y).alias("target_max"))


def target_moments(df: DataFrame, target: str = "cnt") -> DataFrame:
    """mean, median, std, min, max, bias-corrected skewness (G1) and excess kurtosis (G2)."""
    y = number(target)
    mid = column_quantiles(df.select(y.alias("_y")), ["_y"], [0.5]).select(F.col("_y__q")[0].alias("median"))
    m = df.agg(F.count(y).alias("n"), F.avg(y).alias("mean"),
               F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
               F.skewness(y).alias("g1"), F.kurtosis(y).alias("g2")).crossJoin(F.broadcast(mid))
    n = F.col("n").cast("double")
    g1 = F.when(F.col("n") >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(F.col("n") >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return m.select("mean", "median", "std", "min", "max", g1.alias("skewness"), g2.alias("kurtosis"))


def group_profile(df: DataFrame, key, target: str = "cnt", with_std: bool = False, name: str | None = None) -> DataFrame:
    """Mean (and sample std) of the target per key value."""
    k = _c(key).alias(name or (key if isinstance(key, str) else "key"))
    aggs = [F.avg(number(target)).alias("mean")]
    if with_std:
        aggs.append(F.stddev_samp(number(target)).alias("std"))
    return df.groupBy(k).agg(*aggs)


def weekday_profile(df: DataFrame, ts: str = "datetime", target: str = "cnt") -> DataFrame:
    """Mean per day name over all seven days Monday..Sunday; an absent day gives null."""
    spark = df.sparkSession
    days = spark.createDataFrame([(i, d) for i, d in enumerate(DAY_ORDER)], "ord int, day_of_week string")
    means = group_profile(df, F.date_format(ts, "EEEE"), target, name="day_of_week")
    # 7-row dimension drives the join; the aggregate has at most 7 rows too
    return F.broadcast(days).join(means, "day_of_week", "left").select("ord", "day_of_week", "mean")


def workday_holiday_pivot(df: DataFrame, target: str = "cnt") -> DataFrame:
    """Mean target by workingday x holiday (columns holiday_0, holiday_1); empty cell -> 0."""
    y = number(target)
    return df.groupBy("workingday").agg(
        *[F.coalesce(F.avg(F.when(F.col("holiday") == v, y)), F.lit(0.0)).alias(f"holiday_{v}") for v in (0, 1)])


def weekend_effect(df: DataFrame, weekend: Column, target: str = "cnt") -> DataFrame:
    """mean(weekend) - mean(weekday) and its direction label."""
    y = number(target)
    m = df.agg(F.avg(F.when(weekend, y)).alias("weekend_mean"), F.avg(F.when(~weekend, y)).alias("weekday_mean"))
    diff = F.col("weekend_mean") - F.col("weekday_mean")
    return m.select("weekend_mean", "weekday_mean", diff.alias("difference"),
                    F.when(diff > 0, "higher").otherwise("lower").alias("direction"))


def safe_corr(a, b) -> Column:
    """Pearson correlation of the rows where both sides have a value; null (not an error) when either is constant."""
    x, y = number(a), number(b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Lower triangle (with diagonal) of the Pearson matrix, a few aggregate passes over the needed columns."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i + 1]]
    # aggregates of few enough buffer fields (4 a covariance, 3 a deviation) to be compiled
    chunks: list[list[tuple[str, str]]] = [[]]
    for pair in pairs:
        own = [*chunks[-1], pair]
        if 4 * sum(a != b for a, b in own) + 3 * len({c for p in own for c in p}) > COMPILED_FIELDS:
            chunks.append([pair])
        else:
            chunks[-1] = own
    out, gaps = None, df.agg(*[F.count_if(number(c).isNull()).alias(c) for c in cols]).first()
    whole = {c for c in cols if not gaps[c]}  # deviations of whole columns serve all their pairs

    def corr(a: str, b: str) -> Column:
        if {a, b} <= whole:
            return F.try_divide(F.covar_pop(number(a), number(b)), F.stddev_pop(number(a)) * F.stddev_pop(number(b)))
        return safe_corr(a, b)

    for own in chunks:
        wide = df.agg(*[(F.when(F.stddev_pop(number(a)) > 0, F.lit(1.0)) if a == b
                         else corr(a, b)).alias(f"{a}__{b}") for a, b in own])
        part = wide.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"{a}__{b}").alias("corr")) for a, b in own])))
        out = part if out is None else out.unionAll(part)
    return out


def target_correlation_rank(df: DataFrame, cols: list[str], target: str = "cnt", top: int = 10) -> DataFrame:
    """|corr| of each column with the target, largest first (target itself included); nulls last."""
    wide = df.agg(*[(F.when(F.stddev_pop(number(c)) > 0, F.lit(1.0)) if c == target
                     else safe_corr(c, target)).alias(c) for c in cols])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                                                   F.abs(F.col(c)).alias("abs_corr")) for i, c in enumerate(cols)])))
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), "pos")
    return (long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .select("rank", "column", "abs_corr"))


def iqr_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Values strictly outside [Q1-1.5*IQR, Q3+1.5*IQR]: count and percentage per column."""
    stats = df.agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(column_quantiles(df, cols, [0.25, 0.75])))
    bounds = {}
    for c in cols:
        q1, q3 = F.col(f"{c}__q")[0], F.col(f"{c}__q")[1]
        bounds[f"{c}__lo"] = q1 - 1.5 * (q3 - q1)
        bounds[f"{c}__hi"] = q3 + 1.5 * (q3 - q1)
    stats = stats.select("_n", *[v.alias(k) for k, v in bounds.items()])
    # one-row bounds broadcast to every row, then one counting pass
    flagged = df.crossJoin(F.broadcast(stats))
    counts = flagged.agg(F.first("_n").alias("_n"), *[
        F.count_if((number(c) < F.col(f"{c}__lo")) | (number(c) > F.col(f"{c}__hi"))).alias(c) for c in cols])
    long = counts.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers"))
                                                  for c in cols])))
    return long.select("column", "outliers", (F.col("outliers") * 100.0 / F.col("_n")).alias("percentage"))


def histogram(df: DataFrame, col: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (per group): bin 1..bins, edges, count; max lands in the last bin."""
    by = by or []
    x = number(col)
    rng = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")) if by else \
        df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    if by:
        # per-group ranges are broadcast when counted to be few, so rows never move to their group's task
        ensure_checkpoint_dir(df.sparkSession)
        rng = rng.checkpoint(eager=True)
        joined = df.join(F.broadcast(rng) if rng.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS else rng, by)
    else:
        joined = df.crossJoin(F.broadcast(rng))
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((x - F.col("_lo")) * bins / width) + 1, F.lit(bins))).cast("int")
    counted = joined.filter(x.isNotNull()).groupBy(*by, b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    return counted.select(*by, "bin", (F.col("_lo") + (F.col("bin") - 1) * step).alias("lower"),
                          (F.col("_lo") + F.col("bin") * step).alias("upper"), "count")


def box_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Box-plot data per column: quartiles, whiskers (extreme points inside 1.5*IQR), flier count."""
    joined = df.crossJoin(F.broadcast(column_quantiles(df, cols, QUARTILES)))
    aggs = []
    for c in cols:
        x = number(c)
        q1, q3 = F.col(f"{c}__q")[0], F.col(f"{c}__q")[2]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggs.append(F.struct(F.lit(c).alias("column"), F.first(q1).alias("q1"), F.first(F.col(f"{c}__q")[1]).alias("median"),
                             F.first(q3).alias("q3"), F.min(F.when(x >= lo, x)).alias("whisker_low"),
                             F.max(F.when(x <= hi, x)).alias("whisker_high"),
                             F.count_if((x < lo) | (x > hi)).alias("fliers")).alias(c))
    return joined.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in cols])))


def normal_quantile_table(n: int = 99) -> list[tuple[float, float]]:
    """(p, standard normal quantile) for p = 1/(n+1) .. n/(n+1), from the standard library."""
    nd = NormalDist()
    return [(round(i / (n + 1), 10), nd.inv_cdf(i / (n + 1))) for i in range(1, n + 1)]


def qq_points(df: DataFrame, col: str = "cnt", n: int = 99) -> DataFrame:
    """Normal Q-Q data from n sample percentiles (not a full sort) with the least-squares line."""
    table = normal_quantile_table(n)
    probs = [p for p, _ in table]
    spark = df.sparkSession
    theo = spark.createDataFrame([(i, p, z) for i, (p, z) in enumerate(table)], "i int, p double, theoretical double")
    sample = column_quantiles(df, [col], probs).select(F.col(f"{col}__q").alias("qs"))
    pts = (sample.select(F.posexplode("qs").alias("i", "sample"))
           .join(F.broadcast(theo), "i").select("p", "theoretical", "sample"))
    fit = pts.agg(F.regr_slope("sample", "theoretical").alias("slope"),
                  F.regr_intercept("sample", "theoretical").alias("intercept"),
                  safe_corr("theoretical", "sample").alias("r"))
    return pts.crossJoin(fit)


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct count per column in one pass.

    Exact counting deduplicates (column, value) pairs map-side before the
    shuffle, so its cost follows the number of distinct values; ``approx``
    uses HyperLogLog++ sketches (fixed size per column) for unbounded domains.
    """
    agg = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    wide = df.agg(*[agg(c).alias(c) for c in cols])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct"))
                                          for c in cols])))


def top_groups(profile: DataFrame, key: str, n: int = 3, value: str = "mean") -> DataFrame:
    """Top-n keys by value, ties to the smaller key (rank column 1..n)."""
    w = Window.orderBy(F.col(value).desc(), F.col(key))
    return profile.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def argmax_key(profile: DataFrame, key: str, value: str = "mean") -> Column:
    """Aggregate: key with the largest value; ties to the smallest key."""
    return F.max_by(F.col(key), F.struct(F.col(value), -F.col(key)))


def argmax_labels(df: DataFrame, target: str = "cnt") -> DataFrame:
    """Best weather and season (by mean target) with their labels."""
    w = group_profile(df, "weather", target).agg(argmax_key(None, "weather").alias("best_weather"))
    s = group_profile(df, "season", target).agg(argmax_key(None, "season").alias("best_season"))
    return w.crossJoin(s).select(
        "best_weather", lookup("best_weather", WEATHER_LABELS).alias("best_weather_label"),
        "best_season", lookup("best_season", SEASON_LABELS).alias("best_season_label"))


def insights(df: DataFrame, target: str = "cnt") -> DataFrame:
    """Numbered insight lines: peak hours, best weather, best season, temp corr, weekend effect."""
    hourly = group_profile(df, F.hour("datetime"), target, name="hour")
    peaks = top_groups(hourly, "hour", 3).agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "hour"))),
                                      lambda s: s["hour"].cast("string"))).alias("peaks"))
    labels = argmax_labels(df, target)
    corr = df.agg(safe_corr("temp", target).alias("tc"))
    wk = weekend_effect(df, F.weekday("datetime").isin(5, 6), target)
    one = peaks.crossJoin(labels).crossJoin(corr).crossJoin(wk)
    # fixed values: the sentences, which must equal the reference's
    lines = F.array(
        F.concat(F.lit("Peak usage hours: "), F.col("peaks")),
        F.concat(F.lit("Best weather condition: "), F.col("best_weather_label")),
        F.concat(F.lit("Most popular season: "), F.col("best_season_label")),
        F.concat(F.lit("Temperature correlation with usage: "), F.format_string("%.3f", F.col("tc"))),
        F.concat(F.lit("Weekend usage is "), F.format_string("%.1f", F.abs(F.col("difference"))),
                 F.lit(" bikes "), F.col("direction"), F.lit(" than weekdays")))
    return one.select(F.posexplode(lines).alias("pos", "insight")).select((F.col("pos") + 1).alias("n"), "insight")
