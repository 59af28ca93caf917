"""Trial (tuning run) analytics: ranks, best trial, parameter impact, convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import running_agg, with_row_index


def trial_rank(trials: DataFrame, score: str = "r2", key: str = "trial_id",
               num_partitions: int | None = None) -> DataFrame:
    """Position of every trial in the score-sorted results (1 = best; ties to the smaller id)."""
    ix = with_row_index(trials, [F.col(score).desc(), F.col(key).asc()], "_i", num_partitions)
    return ix.withColumn("rank", F.col("_i") + 1).drop("_i")


def best_trial(trials: DataFrame, by: list[str] | None = None, score: str = "r2", key: str = "trial_id") -> DataFrame:
    """Best trial per group: strict '>' over trials in id order, i.e. the first maximum wins."""
    by = by or []
    order = F.struct(F.col(score), -F.col(key))
    aggs = [F.max_by(F.col(key), order).alias("best_trial_id"), F.max(score).alias("best_score"),
            F.count(F.lit(1)).alias("n_trials")]
    return trials.groupBy(*by).agg(*aggs) if by else trials.agg(*aggs)


def param_impact(trials: DataFrame, params: list[str], score: str = "r2", list_params: tuple[str, ...] = (),
                 top: int = 5, box_below: int | None = None) -> DataFrame:
    """Mean score per parameter value, best first.

    Of list-valued parameters (``list_params``) the report shows the ``top``
    best values, of the others all. The score distribution per value is
    summarised as quartiles (bounded output instead of the raw score list); a
    report may leave them out for parameters with ``box_below`` values or more.
    """
    long = trials.select(score, F.inline(F.array(*[
        F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params])))
    per_value = long.groupBy("param", "value").agg(
        F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"),
        F.percentile(F.col(score), [0.25, 0.5, 0.75]).alias("_q"))
    w_all = Window.partitionBy("param")
    w = Window.partitionBy("param").orderBy(F.col("mean_score").desc(), F.col("value"))
    ranked = (per_value.withColumn("n_values", F.count(F.lit(1)).over(w_all))
              .withColumn("rank", F.row_number().over(w))
              .filter(~F.col("param").isin(*list_params) | (F.col("rank") <= top)))
    small = F.col("n_values") < box_below if box_below is not None else F.lit(True)
    return ranked.select("param", "value", "rank", "mean_score", "n", "n_values",
                         F.when(small, F.col("_q")[0]).alias("q1"), F.when(small, F.col("_q")[1]).alias("median"),
                         F.when(small, F.col("_q")[2]).alias("q3"))


def tuning_convergence(trials: DataFrame, by: list[str], order: str = "trial_id", score: str = "r2",
                       num_partitions: int | None = None) -> DataFrame:
    """Best score so far along the search order, per group (skew-safe running max)."""
    return running_agg(trials, by, [order], [("best_so_far", "max", F.col(score), True)], num_partitions)


def expand_params(trials: DataFrame, params_col: str, names: list[str]) -> DataFrame:
    """Explode a params map/struct (or JSON text) into one column per name; missing -> null."""
    dtype = dict(trials.dtypes)[params_col]
    col = F.col(params_col)
    if dtype == "string":
        col = F.from_json(col, "map<string,string>")
    if dtype.startswith("struct"):
        return trials.withColumns({n: col[n] for n in names})
    return trials.withColumns({n: F.try_element_at(col, F.lit(n)) for n in names})


def metrics_with_time(metrics: DataFrame, times: DataFrame, key: str = "model") -> DataFrame:
    """Left equi-join metrics with fit times by model (missing time -> null)."""
    return metrics.join(times, key, "left")
