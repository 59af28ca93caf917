"""Model fitting and scoring with Spark ML over chronological splits.

Data preparation is one plan: feature projection -> distributed row index
-> split label -> scaler statistics from the train rows only (one-row
broadcast) -> vector assembly. Every fit reads the same persisted splits;
the driver only loops over a handful of estimators / parameter settings.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import assemble, feature_table
from ..schema import FEATURE_COLS, SCALED_COLS
from ..sources import manifest
from . import evaluate as EV
from . import gram
from .order import exact_sample, label_folds, label_split, rows_at, sample_hash
from .scaling import apply_scaler, fit_scaler


@dataclass
class Splits:
    train: DataFrame
    val: DataFrame
    test: DataFrame
    scaler: DataFrame | None = None
    held: DataFrame | None = None  # what is persisted

    def unpersist(self) -> None:
        if self.held is not None:
            self.held.unpersist()

    def __enter__(self) -> Splits:
        return self

    def __exit__(self, *exc) -> None:
        self.unpersist()


PARTITION_ROWS, PARTITIONS, MOST_PARTITION_ROWS = 16_384, 48, 1 << 20
TREE_PARTITIONS, MOST_TREE_ROWS = 12, 1 << 22


def deal(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows in partitions that depend on their number and ids alone, so models that sample per partition do not depend on the machine.

    Partitions hold PARTITION_ROWS rows while they are fewer than PARTITIONS, then grow up to MOST_PARTITION_ROWS.
    """
    size = max(PARTITION_ROWS, min(-(-n // PARTITIONS), MOST_PARTITION_ROWS))
    return rows.repartition(max(1, -(-n // size)), key).sortWithinPartitions(key)


def few_partitions(rows: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """Rows in few partitions, by their ids alone, for Spark's trees.

    Each partition gives sums of every node, feature and bin, whatever its rows, and each of the many jobs reports every
    task to the driver: both follow the number of partitions, TREE_PARTITIONS of up to MOST_TREE_ROWS rows, then more.
    """
    if n <= TREE_PARTITIONS * PARTITION_ROWS or key not in rows.columns:
        return rows
    return rows.repartition(max(TREE_PARTITIONS, -(-n // MOST_TREE_ROWS)), key).sortWithinPartitions(key)


def prepare_splits(demand: DataFrame, key: str = "event_id", test_size: float = 0.15, val_size: float = 0.15,
                   fit_scaler_on: str = "train", target: str = "cnt", dealt: bool = True) -> Splits:
    """Features, chronological split, scaler fitted on train (or 'all' for parity), assembled vectors.

    Networks deal their rows to shards themselves, so they take rows as they are read (not ``dealt``).
    """
    ft = feature_table(demand, keep=[key, "datetime"], target=target)
    labelled = label_split(ft, ["datetime", key], test_size, val_size)
    state = fit_scaler(labelled.filter(F.col("split") == "train") if fit_scaler_on == "train" else labelled,
                       SCALED_COLS)
    scaled = apply_scaler(labelled, state, SCALED_COLS, as_float=True)
    ready = assemble(scaled.withColumn("label", F.col(target).cast("double"))).select(key, "split", "features", "label")
    ready = (deal(ready, demand.count(), key) if dealt else ready).persist(StorageLevel.MEMORY_AND_DISK)
    parts = [ready.filter(F.col("split") == s) for s in ("train", "val", "test")]
    return Splits(*parts, scaler=state, held=ready)


FOREST_DEPTH = 12  # a default: Spark trees need a limit, 30 is the most they allow


# The reference's scikit-learn defaults re-expressed as Spark ML settings.
def make_estimator(name: str, n_train: int | None = None, label_std: float | None = None, **kw) -> Estimator:
    """Estimator registry: linear, ridge (alpha=1), lasso (alpha=1), forest, gbt."""
    if name == "linear":
        return LinearRegression(regParam=0.0, **kw)
    if name == "ridge":
        alpha = kw.pop("alpha", 1.0)
        # sklearn's alpha*||w||^2 on the raw sum of squares == Spark's regParam
        # scaled by 1/n and by the label std Spark divides out internally
        reg = alpha / n_train * label_std if n_train and label_std else alpha
        return LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, regParam=reg, **kw)
    if name == "lasso":
        alpha = kw.pop("alpha", 1.0)
        return LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=200, **kw)
    if name == "forest":
        args = {"numTrees": 100, "featureSubsetStrategy": "all", "maxDepth": FOREST_DEPTH, "seed": 42}
        args.update(kw)
        return RandomForestRegressor(**args)
    if name == "gbt":
        args = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42}
        args.update(kw)
        return GBTRegressor(**args)
    raise ValueError(f"unknown model {name}")


def label_stats(df: DataFrame) -> tuple[int, float]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd")).first()
    return int(row["n"]), float(row["sd"] or 0.0)


def fit_model(name: str, train: DataFrame, **kw) -> tuple[Model, float]:
    n, sd = label_stats(train) if name == "ridge" else (None, None)
    est = make_estimator(name, n, sd, **kw)
    t0 = time.time()
    if name in ("forest", "gbt"):
        train = few_partitions(train, train.count())
    model = est.fit(train)
    return model, time.time() - t0


def score(model: Model, df: DataFrame) -> DataFrame:
    """Predictions with the reference's post-processing: clamp at 0 and round half-to-even."""
    p = model.transform(df).withColumn("y_pred", F.col("prediction"))
    clamped = F.greatest(F.col("y_pred"), F.lit(0.0))
    return p.withColumns({"y_true": F.col("label"), "count": clamped, "count_rounded": F.bround(clamped, 0).cast("long")})


def metrics_row(model: Model, df: DataFrame, name: str, fit_seconds: float | None = None) -> DataFrame:
    m = EV.regression_metrics(score(model, df))
    return m.select(F.lit(name).alias("model"), "*", F.lit(fit_seconds).cast("double").alias("training_time"))


def fit_any(name: str, splits: Splits, **kw) -> tuple[Callable[[DataFrame], DataFrame], float]:
    """Fit a Spark ML model, the network (``mlp``) or binned boosting (``gbt``) on train: (frame -> metrics, fit seconds)."""
    if name == "mlp":
        from .mlp import fit_mlp

        res = fit_mlp(splits, **kw)
        return res.metrics, res.seconds
    if name == "gbt":
        from .boosting import fit_boosted

        res = fit_boosted(splits.train, **kw)
        return res.metrics, res.seconds
    model, secs = fit_model(name, splits.train, **kw)
    return (lambda df: EV.regression_metrics(score(model, df))), secs


def fit_and_evaluate(name: str, splits: Splits, on: str = "test", **kw) -> DataFrame:
    metrics, secs = fit_any(name, splits, **kw)
    return metrics(getattr(splits, on)).select(F.lit(name).alias("model"), "*", F.lit(secs).cast("double").alias("training_time"))


# Display names used in the comparison table.
DISPLAY = {"linear": "Linear Regression", "ridge": "Ridge Regression", "lasso": "Lasso Regression", "forest": "Random Forest",
           "gbt": "Gradient Boosting", "mlp": "Standard MLP"}
_COMPARED = ["n", "r2", "rmse", "mae", "mse", "mape"]


def compare_models(splits: Splits, models: dict[str, dict]) -> DataFrame:
    """Fit every model on the same train split, score test; a model that fails keeps a row with its error, ranked last."""
    spark = splits.train.sparkSession
    rows = []
    for name, kw in models.items():
        try:
            metrics, secs = fit_any(name, splits, **kw)
            m = metrics(splits.test).select(*_COMPARED).first()
            rows.append((DISPLAY.get(name, name), *[None if v is None else float(v) for v in m], float(secs), None))
        except Exception as e:  # noqa: BLE001 - one model's failure does not end the comparison
            rows.append((DISPLAY.get(name, name), *[None] * len(_COMPARED), None, f"{type(e).__name__}: {e}"[:500]))
    table = spark.createDataFrame(rows, "model string, " + ", ".join(f"{c} double" for c in _COMPARED) + ", training_time double, error string")
    return EV.leaderboard(table.withColumn("n", F.col("n").cast("long")))


def tree_importance(splits: Splits, forest_kw: dict, gbt_kw: dict, top: int | None = None) -> DataFrame:
    """Importances of the better (by test r2) of forest and boosting, largest first; all features unless ``top``."""
    spark = splits.train.sparkSession
    best = None
    for name, kw in (("forest", forest_kw), ("gbt", gbt_kw)):
        model, _ = fit_model(name, splits.train, **kw)
        r2 = EV.regression_metrics(score(model, splits.test)).first()["r2"]
        if best is None or r2 > best[1]:
            best = (name, r2, model)
    imp = best[2].featureImportances.toArray().tolist()
    rows = [(DISPLAY[best[0]], FEATURE_COLS[i], float(v)) for i, v in enumerate(imp)]
    df = spark.createDataFrame(rows, "model string, feature string, importance double").orderBy(F.col("importance").desc(), "feature")
    return df if top is None else df.limit(top)


def cross_validate(demand: DataFrame, name: str, k: int = 5, key: str = "event_id", **kw) -> DataFrame:
    """Expanding-window k-fold CV: per fold r2 and fit seconds, then mean / population std and the fold scores.

    The network watches its fold's test rows for early stopping, as the reference's folds do. All folds
    of a linear model are solved from one scan; a fold's seconds are its share of it and its solving.
    """
    spark = demand.sparkSession
    ft = feature_table(demand, keep=[key, "datetime"])
    folded = label_folds(ft, ["datetime", key], k)
    if _from_sums(name, kw):
        t0 = time.time()
        # block 0 lies before every test fold; fold f trains on blocks up to f and tests block f + 1
        blocks = gram.group_sums(folded.withColumn("_block", F.coalesce(F.col("test_fold") + 1, F.lit(0))), FEATURE_COLS, "cnt", "_block")
        scan = (time.time() - t0) / k
        return _cv_table(spark, [(f, line.r2(blocks[f + 1]) if f + 1 in blocks else None, scan + secs) for f, (line, secs) in enumerate(_solved(name, blocks, range(k), kw))])
    ready = assemble(folded.withColumn("label", F.col("cnt").cast("double"))).select(
        key, "test_fold", "train_from_fold", "features", "label")
    scores = []
    if name == "mlp":  # all folds at a time
        from . import mlp

        packed = mlp.pack(ready.select(F.col(key).alias("event_id"), "features", "label", F.col("train_from_fold").alias("train_from"), F.col("test_fold").alias("held")))
        trials = [_trial(kw, level=f, watch=f) for f in range(k)]
        results = _trained(packed, trials)
        scores = [(f, own["held"][1], res.seconds) for f, (own, res) in enumerate(zip(mlp.score_many(packed, trials, results), results))]
        return _cv_table(spark, scores)
    ready = deal(ready, demand.count(), key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for f in range(k):
            test = ready.filter(F.col("test_fold") == f)
            metrics, secs = fit_any(name, Splits(ready.filter(F.col("train_from_fold") <= f), test, test), **kw)
            scores.append((f, float(metrics(test).first()["r2"]), float(secs)))
    finally:
        ready.unpersist()
    return _cv_table(spark, scores)


def _from_sums(name: str, kw: dict) -> bool:
    return name in gram.LINEAR and set(kw) <= {"alpha"}


def _solved(name: str, groups: dict[int, gram.Sums], ends, kw: dict) -> list[tuple[gram.Line, float]]:
    """(model, seconds) of the rows of all groups up to each of ``ends``."""
    out = []
    for e in ends:
        t0, rows = time.time(), gram.prefix(groups, e)
        if rows is None:
            raise ValueError(f"{name} has no labelled rows to learn from")
        out.append((gram.solve(name, rows, **kw), time.time() - t0))
    return out


def _cv_table(spark: SparkSession, scores: list[tuple[int, float, float]]) -> DataFrame:
    fold_df = spark.createDataFrame(scores, "fold int, r2 double, training_time double")
    return EV.cv_summary(fold_df, "r2", "training_time").crossJoin(
        fold_df.agg(F.sort_array(F.collect_list(F.struct("fold", "r2"))).alias("scores")))


def learning_curve(splits: Splits, name: str, sizes=(0.1, 0.25, 0.5, 0.75, 1.0), seed: int = 42, **kw) -> DataFrame:
    """Fit on nested hash-ranked subsets of train; score train subset and validation r2.

    The networks of all sizes are trained at a time; linear models of all sizes come from one scan.
    """
    spark = splits.train.sparkSession
    rows = []
    if name == "mlp" or _from_sums(name, kw):
        rows = (_network_curve if name == "mlp" else _linear_curve)(splits, name, list(sizes), seed, kw)
        sizes = ()
    for s in sizes:
        sub = splits.train
        if s < 1.0:  # the sample of the keys alone is ranked; features never move
            own = exact_sample(splits.train.select("event_id"), "event_id", fraction=s, seed=seed)
            sub = splits.train.join(own, "event_id", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
        metrics, secs = fit_any(name, Splits(sub, splits.val, splits.test), **kw)
        tr, va = metrics(sub).first(), metrics(splits.val).first()
        rows.append((float(s), int(tr["n"]), float(tr["r2"]), float(va["r2"]), float(secs)))
        if s < 1.0:
            sub.unpersist()
    return spark.createDataFrame(rows, "size double, n_train long, train_r2 double, val_r2 double, training_time double")


def _trial(params: dict, **own):
    from .mlp import Trial

    return Trial(**{**params, **({"hidden": tuple(params["hidden"])} if "hidden" in params else {}), **own})


def _trained(packed, trials: list) -> list:
    from .mlp import fit_many

    results = fit_many(packed, trials)
    for r in results:
        if r.error is not None:
            raise ValueError(r.error)
    return results


def _levelled(splits: Splits, sizes: list[float], seed: int) -> tuple[DataFrame, list[int], int]:
    """(train rows with ``level``, the level of each size, levels): a row's level is the smallest size whose sample holds it."""
    n = splits.train.count()
    starts = sorted({int(n * s) for s in sizes if int(n * s) < n})  # ranks at which a larger sample begins
    hashed = splits.train.select("event_id", "features", "label", sample_hash("event_id", seed).alias("_h"))
    at = rows_at(hashed, ["_h", "event_id"], lambda total: starts).select("keys")  # one key per size
    key = F.struct("_h", "event_id")
    levels = hashed.crossJoin(F.broadcast(at)).select("event_id", "features", "label", F.size(F.filter("keys", lambda k: k <= key)).alias("level"))
    return levels, [starts.index(int(n * s)) if int(n * s) < n else len(starts) for s in sizes], len(starts) + 1


def _network_curve(splits: Splits, name: str, sizes: list[float], seed: int, kw: dict) -> list[tuple]:
    """(size, rows, train r2, validation r2, seconds) per size."""
    from . import mlp

    levels, of_size, _ = _levelled(splits, sizes, seed)
    train = levels.select("event_id", "features", "label", F.col("level").alias("train_from"), F.lit(None).cast("int").alias("held"))
    packed = mlp.pack(train.unionAll(splits.val.select("event_id", "features", "label", F.lit(None).cast("int"), F.lit(0))), kw.get("seed", 42))
    trials = [_trial(kw, level=level) for level in of_size]
    results = _trained(packed, trials)
    return [(float(s), own["train"][0], own["train"][1], own["held"][1], res.seconds) for s, own, res in zip(sizes, mlp.score_many(packed, trials, results), results)]


def _linear_curve(splits: Splits, name: str, sizes: list[float], seed: int, kw: dict) -> list[tuple]:
    """``_network_curve`` of a linear model: the sums of every level and of the validation rows, in one scan."""
    from pyspark.ml.functions import vector_to_array

    levels, of_size, held = _levelled(splits, sizes, seed)
    both = levels.select("features", "label", "level").unionAll(splits.val.select("features", "label", F.lit(held)))
    x = vector_to_array("features")
    t0 = time.time()
    sums = gram.group_sums(both.select(*[x[i].alias(c) for i, c in enumerate(FEATURE_COLS)], "label", "level"), FEATURE_COLS, "label", "level")
    scan, val = (time.time() - t0) / max(len(sizes), 1), sums.pop(held, None)
    out = []
    for s, level, (line, secs) in zip(sizes, of_size, _solved(name, sums, of_size, kw)):
        own = gram.prefix(sums, level)
        out.append((float(s), own.n, line.r2(own), None if val is None else line.r2(val), scan + secs))
    return out


def sample_params(space: dict[str, list], n: int, seed: int = 42, method: str = "random") -> list[dict]:
    """Grid (first n combinations) or seeded random draws from a small parameter space (driver side)."""
    import itertools

    keys = list(space)
    grid = [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]
    if method == "grid":
        return grid[:n]
    rng = random.Random(seed)
    return [rng.choice(grid) for _ in range(n)]


def refine_params(space: dict[str, list], best: dict, n: int, seed: int = 43) -> list[dict]:
    """Two-phase search, second half: move 1-2 parameters of the best by one list position."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = dict(best)
        for k in rng.sample(list(space), k=min(len(space), rng.choice([1, 2]))):
            vals = space[k]
            i = vals.index(p[k]) if p[k] in vals else 0
            p[k] = vals[max(0, min(len(vals) - 1, i + rng.choice([-1, 1])))]
        out.append(p)
    return out


def tune_model(splits: Splits, name: str, space: dict[str, list], n_trials: int = 20, method: str = "random",
               seed: int = 42, timeout_s: float | None = None) -> DataFrame:
    """Search scored by validation r2, for Spark ML models and the network (``mlp``).

    The networks of a phase are trained at a time, one job per epoch; a network's ``training_time``
    is what its units of work took together, also where they were a longer trial's as well. A failed trial scores -inf and says why in ``error``.
    With ``timeout_s``, a slower trial is marked ``timed_out``; its score stays.
    """
    spark = splits.train.sparkSession
    params = sample_params(space, max(1, n_trials // 2), seed) if method == "two_phase" else sample_params(space, n_trials, seed, method)
    results = []
    run = _network_trials(splits, space.get("epochs", [])) if name == "mlp" else lambda ps: [_ml_trial(name, splits, p) for p in ps]

    def phase(label: str, own: list[dict]) -> None:
        for p, (r2, secs, error) in zip(own, run(own)):
            results.append((len(results), name, json.dumps(p, sort_keys=True), r2, float(secs), label, timeout_s is not None and secs > timeout_s, error))

    phase("explore", params)
    if method == "two_phase":
        best = json.loads(max(results, key=lambda r: r[3])[2])
        phase("refine", refine_params(space, best, n_trials - len(params), seed + 1))
    return spark.createDataFrame(results, "trial_id int, model_type string, params string, r2 double, "
                                          "training_time double, phase string, timed_out boolean, error string")


def _ml_trial(name: str, splits: Splits, params: dict) -> tuple[float, float, str | None]:
    try:
        metrics, secs = fit_any(name, splits, **params)
        return float(metrics(splits.val).first()["r2"]), secs, None
    except Exception as e:  # noqa: BLE001 - one trial's failure does not end the search
        return float("-inf"), 0.0, f"{type(e).__name__}: {e}"[:500]


def _network_trials(splits: Splits, epochs: list = ()) -> Callable[[list[dict]], list[tuple[float, float, str | None]]]:
    """(validation r2, seconds, error) of each parameter set; equal sets are trained once. The shards are written once for all phases.

    A network also gives those of fewer ``epochs``, its other settings being equal, which a later phase may ask for.
    """
    from . import mlp

    packed, known, spare = mlp.pack_splits(splits), {}, {}
    key = lambda p: json.dumps(p, sort_keys=True)

    def run(params: list[dict]) -> list[tuple[float, float, str | None]]:
        new, ready, short = {}, {}, {}
        for p in params:
            k = key(p)
            if k in spare:
                ready[k] = spare[k]
            elif k not in known:
                try:
                    new[k] = _trial(p)
                except TypeError as e:  # a setting that networks do not have
                    known[k] = (float("-inf"), 0.0, f"TypeError: {e}"[:500])
        for t, p in [(t, json.loads(k)) for k, t in new.items()]:
            for k, n in [(key({**p, "epochs": n}), n) for n in epochs if "epochs" in p and isinstance(n, int) and 0 < n < t.epochs]:
                if not any(k in seen for seen in (new, known, spare)):
                    short[k] = replace(t, epochs=n)
        fits = dict(zip([*new, *short], mlp.fit_many(packed, [*new.values(), *short.values()])))
        spare.update({k: (t, fits[k]) for k, t in short.items()})
        trials, results = [*new.values(), *[t for t, _ in ready.values()]], [*[fits[k] for k in new], *[r for _, r in ready.values()]]
        for k, r, own in zip([*new, *ready], results, mlp.score_many(packed, trials, results)):
            known[k] = (own["held"][1], r.seconds, None) if r.error is None and "held" in own else (float("-inf"), r.seconds, r.error or "no validation rows")
            spare.pop(k, None)
        return [known[key(p)] for p in params]

    return run


def final_validation(splits: Splits, name: str, trials: DataFrame) -> DataFrame:
    """Refit the best trial's parameters on train+val and score the untouched test split.

    The network has no rows left to watch then and runs all its epochs. A search without a finite
    score is an error.
    """
    best = trials.filter(F.col("r2") > float("-inf")).orderBy(F.col("r2").desc(), "trial_id").first()
    if best is None:
        why = trials.select("error").first()
        raise ValueError(f"no trial of {name} has a score: {why and why['error']}")
    both = splits.train.unionByName(splits.val)
    metrics, secs = fit_any(name, Splits(both, both.limit(0), splits.test), **json.loads(best["params"]))
    return metrics(splits.test).select(F.lit(name).alias("model"), F.lit(best["params"]).alias("params"), "*",
                                       F.lit(secs).alias("training_time"))


def save_bundle(path: str, model, scaler: DataFrame, model_type: str, features: list[str] = FEATURE_COLS) -> str:
    """Model, scaler, ordered feature names and model type under one folder; the type is written last."""
    from .mlp import MLPResult

    spark = scaler.sparkSession
    if isinstance(model, MLPResult):
        model.save(spark, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    spark.createDataFrame([(model_type, list(features))], "model_type string, features array<string>").write.mode("overwrite").json(f"{path}/about")
    return path


def load_bundle(spark: SparkSession, path: str) -> tuple[object, DataFrame, str, list[str]]:
    """(model, scaler, model type, features) of a saved bundle; a missing or foreign one is an error that says so."""
    from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel

    from .mlp import MLPResult

    try:
        about = spark.read.schema("model_type string, features array<string>").json(f"{path}/about").first()
    except Exception as e:
        raise FileNotFoundError(f"no model bundle at {path}") from e
    kinds = {"linear": LinearRegressionModel, "ridge": LinearRegressionModel, "lasso": LinearRegressionModel,
             "forest": RandomForestRegressionModel, "gbt": GBTRegressionModel}
    if about is None or about.model_type not in {*kinds, "mlp"}:
        raise ValueError(f"{path} holds no known model type: {about and about.model_type}")
    model = MLPResult.load(spark, f"{path}/model") if about.model_type == "mlp" else kinds[about.model_type].load(f"{path}/model")
    return model, spark.read.parquet(f"{path}/scaler"), about.model_type, list(about.features)


def publish_bundle(root: str, name: str, model, scaler: DataFrame, model_type: str) -> str:
    """Save a bundle aside and make it the current version of ``name``; the version's name."""
    return manifest.publish(scaler.sparkSession, root, name, lambda path: save_bundle(path, model, scaler, model_type))


def current_bundle(spark: SparkSession, root: str, name: str) -> tuple[object, DataFrame, str, list[str]]:
    """``load_bundle`` of the published version of ``name``."""
    return load_bundle(spark, manifest.version_path(root, manifest.current(spark, root, name)))


def model_roundtrip(model, scaler: DataFrame, model_type: str, path: str, df: DataFrame) -> DataFrame:
    """Publish a bundle, load it and re-score: both predictions per row and whether they agree."""
    publish_bundle(path, model_type, model, scaler, model_type)
    loaded, _, kind, _ = current_bundle(df.sparkSession, path, model_type)
    guess = (lambda m: m.predict(df).withColumnRenamed("y_pred", "prediction")) if kind == "mlp" else (lambda m: m.transform(df))
    a = guess(model).select("event_id", F.col("prediction").alias("p1"))
    b = guess(loaded).select("event_id", F.col("prediction").alias("p2"))
    return a.join(b, "event_id").select("event_id", "p1", "p2", (F.abs(F.col("p1") - F.col("p2")) < 1e-9).alias("same"))
