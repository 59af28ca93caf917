"""Evaluation: regression metrics, residuals, ensembles, leaderboards, summaries.

Metrics are algebraic aggregates (sums and counts), so a metric table over
billions of predictions is one partial-aggregate pass per model group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import fmt, performance_level, recommendations


def metric_columns(y_true: str = "y_true", y_pred: str = "y_pred", with_mape: bool = True) -> list[Column]:
    """Aggregate columns n, mse, rmse, mae, r2 (and mape in %)."""
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    e = y - p
    mse = F.avg(e * e)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * F.count(y)
    # r2 = 1 - SSE/SST; constant truth: 1.0 if perfect else 0.0
    r2 = F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - sse / sst)
    cols = [F.count(F.lit(1)).alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"), r2.alias("r2")]
    if with_mape:
        ape = F.when(y != 0, F.abs(e / y))
        cols.append(F.coalesce(F.avg(ape) * 100, F.lit(0.0)).alias("mape"))
    return cols


def regression_metrics(preds: DataFrame, by: list[str] | None = None, y_true: str = "y_true",
                       y_pred: str = "y_pred", with_mape: bool = True) -> DataFrame:
    """mse, rmse, mae, r2, mape per group (e.g. per model)."""
    by = by or []
    cols = metric_columns(y_true, y_pred, with_mape)
    return preds.groupBy(*by).agg(*cols) if by else preds.agg(*cols)


def residuals(preds: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return preds.select(*keys, e.alias("residual"), F.abs(e).alias("abs_error"))


def ensemble_mean(preds: DataFrame, key: str = "event_id", model_col: str = "model") -> DataFrame:
    """Unweighted mean of all model outputs per row key (one shuffle on the key)."""
    return preds.groupBy(key).agg(F.first("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))


def pair_predictions(truth: DataFrame, preds: DataFrame, key: str, models: list[str],
                     model_col: str = "model") -> DataFrame:
    """Zip truth with each model's output on an explicit row key (never by position).

    The long prediction table is pivoted with a fixed model list (one
    aggregate on the key), then equi-joined to the truth on the same key.
    """
    wide = preds.groupBy(key).agg(*[F.max(F.when(F.col(model_col) == m, F.col("y_pred"))).alias(m) for m in models])
    return truth.join(wide, key, "left")


def stack_predictions(frames: dict[str, DataFrame]) -> DataFrame:
    """Bag union of per-model outputs, tagged with the model name."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("model", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def with_levels(metrics: DataFrame, time_col: str | None = None) -> DataFrame:
    t = F.col(time_col) if time_col else F.lit(None).cast("double")
    return metrics.withColumns({"performance_level": performance_level("r2", "rmse"),
                                "recommendations": recommendations("r2", "rmse", t)})


def leaderboard(metrics: DataFrame, name: str = "model", score: str = "r2") -> DataFrame:
    """Models ranked by score, best first; ties to the smaller name."""
    w = Window.orderBy(F.col(score).desc(), F.col(name))
    return metrics.withColumn("rank", F.row_number().over(w))


def model_recommendations(board: DataFrame, name: str = "model", r2: str = "r2",
                          time: str = "training_time") -> DataFrame:
    """Best r2, fastest, most efficient (r2 per minute), production pick, best neural model, insight flags.

    ``board`` is a leaderboard (one row per model, ``rank`` 1 = best r2), so
    every statistic here is an aggregate over a handful of rows.
    """
    eff = F.try_divide(F.col(r2), F.col(time) / 60)
    b = board.withColumn("efficiency", eff)
    n_models = F.max("rank")
    first_key = F.struct(-F.col("rank"))
    agg = b.agg(
        F.max_by(name, first_key).alias("best_model"), F.max_by(r2, first_key).alias("best_r2"),
        F.min_by(name, F.struct(F.col(time), F.col("rank"))).alias("fastest_model"),
        F.min_by(time, F.struct(F.col(time), F.col("rank"))).alias("fastest_time"),
        F.min_by(r2, F.struct(F.col(time), F.col("rank"))).alias("fastest_r2"),
        F.max_by(name, F.struct(F.col("efficiency"), -F.col("rank"))).alias("most_efficient"),
        F.max(F.col("efficiency")).alias("best_efficiency"),
        F.max_by(name, F.when(F.col(name).rlike("MLP|LSTM"), F.struct(F.col(r2), -F.col("rank")))).alias("best_neural"),
        F.max(F.when(F.col("rank") == 1, F.col(r2))).alias("_first"),
        n_models.alias("_n"),
        F.max(F.when((F.col("rank") <= 3) & F.col(name).contains("MLP"), 1).otherwise(0)).alias("_nn3"),
        F.max(F.when((F.col("rank") <= 3) & F.col(name).isin("Random Forest", "Gradient Boosting"), 1)
              .otherwise(0)).alias("_tree3"))
    last = b.join(agg.select(F.col("_n").alias("rank")), "rank").select(F.col(r2).alias("_last"))
    out = agg.crossJoin(last)
    return out.select(
        "best_model", "best_r2", "fastest_model", "fastest_time", "most_efficient", "best_efficiency",
        F.when(F.col("fastest_r2") > 0.85, F.col("fastest_model")).otherwise(F.col("most_efficient")).alias("production_pick"),
        "best_neural", (F.col("_nn3") == 1).alias("neural_in_top3"), (F.col("_tree3") == 1).alias("trees_in_top3"),
        ((F.col("_first") - F.col("_last")) < 0.1).alias("small_gap"))


def summary_rows(metrics: DataFrame, name: str = "model", time: str | None = "training_time") -> DataFrame:
    """Fixed-decimal text rows: MODEL, r2 .4f, rmse .2f, mae .2f, mape .2f%, time .2fs (N/A if none)."""
    t = F.col(time) if time else F.lit(None).cast("double")
    return metrics.select(F.upper(F.col(name)).alias("model"), fmt("r2", 4).alias("r2_text"),
                          fmt("rmse", 2).alias("rmse_text"), fmt("mae", 2).alias("mae_text"),
                          fmt("mape", 2, "%").alias("mape_text"), fmt(t, 2, "s").alias("time_text"))


def training_summary(per_model: DataFrame, ensemble: DataFrame | None = None, name: str = "model") -> DataFrame:
    """Summary table plus the best model flag (first maximum r2 wins)."""
    rows = per_model.select(name, "r2", "rmse", "mae", "mape",
                            F.col("training_time") if "training_time" in per_model.columns
                            else F.lit(None).cast("double").alias("training_time"))
    best = rows.agg(F.max_by(name, "r2").alias("_best"))
    table = summary_rows(rows, name).crossJoin(best)
    table = table.withColumn("is_best", F.upper(F.col("_best")) == F.col("model")).drop("_best")
    if ensemble is not None:
        ens = summary_rows(ensemble.withColumn(name, F.lit("ensemble")), name, None).withColumn("is_best", F.lit(False))
        table = table.unionByName(ens)
    return table


def cv_summary(fold_scores: DataFrame, score: str = "r2", time: str | None = None) -> DataFrame:
    """Mean and population std of fold scores (plus mean/total time when recorded)."""
    aggs = [F.count(F.lit(1)).alias("n_folds"), F.avg(score).alias("mean_score"),
            F.stddev_pop(score).alias("std_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score")]
    if time:
        aggs += [F.avg(time).alias("mean_time"), F.sum(time).alias("total_time")]
    return fold_scores.agg(*aggs)
