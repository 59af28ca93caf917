"""Data-parallel neural regressors (ReLU MLP, MSE, Adam) on Spark, many models at a time.

``pack`` deals the rows to shards of a fixed number of rows by a hash of their id and writes each
shard as packed arrays to the shared checkpoint folder, once. An epoch of all models (the trials of a
search, the folds of a validation, the sizes of a learning curve) is one Spark job; its unit of work
is a model on a shard. Weights and Adam state are broadcast, a unit runs one pass of mini-batch Adam
over its rows with NumPy, and results are averaged by rows: sums are taken pairwise over the shards'
numbers, in tasks over runs of consecutive shards and over the runs in a tree of Spark aggregations,
so what is shuffled follows the number of tasks, not of rows, and one averaged state per model reaches
the driver. A search over few rows gives each model tasks in proportion to its cost. The same job gives the validation loss of the weights it starts from, so an epoch needs
no second pass. Models stop singly, by their epochs or their patience, and get their best weights
back. Shards follow the number of rows alone, so weights depend neither on partitions nor on the
number of cores, and a table of one shard is trained as on one machine.
"""

from __future__ import annotations

import heapq
import io
import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..schema import FEATURE_COLS
from ..session import scratch_path, ship_package
from . import evaluate as EV

SHARD_ROWS = 16_384  # rows a unit of work holds
GROUPS = 64  # of consecutive shards, which tasks work through in order
MOST_RUN = 64  # shards of a group, a power of two; beyond GROUPS of them there are more groups
FAN = 8  # partial results that one aggregation adds up, a power of two
TASKS = 1  # per core that an epoch is cut into, at least, where there are enough shards: each sends a state of each of its models
FINER = 2  # times as many tasks, at most, where so many more fill the cores better by GAIN
GAIN = 0.1
MOST_DEALT = 16 << 20  # rows, copies for several tasks' models included, up to which models are told apart by task
NEVER = 1 << 30
B1, B2, EPS = 0.9, 0.999, 1e-8


def init_weights(n_in: int, hidden: tuple[int, ...], seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    sizes = [n_in, *hidden, 1]
    ws = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = 1.0 / np.sqrt(a)
        ws += [rng.uniform(-bound, bound, (a, b)).astype(np.float32), rng.uniform(-bound, bound, b).astype(np.float32)]
    return ws


def forward(ws: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    acts = [x]
    h = x
    n_layers = len(ws) // 2
    for i in range(n_layers):
        z = h @ ws[2 * i]
        z += ws[2 * i + 1]
        h = np.maximum(z, 0.0, out=z) if i < n_layers - 1 else z
        acts.append(h)
    return h[:, 0], acts


def backward(ws: list[np.ndarray], acts: list[np.ndarray], d_out: np.ndarray, into: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of the weights (written to ``into`` if given) and of the inputs for upstream gradient d_out (shape n)."""
    n_layers = len(ws) // 2
    grads = [np.empty_like(w) for w in ws] if into is None else into
    d = d_out[:, None].astype(ws[0].dtype, copy=False)
    for i in reversed(range(n_layers)):
        np.matmul(acts[i].T, d, out=grads[2 * i])
        np.sum(d, axis=0, out=grads[2 * i + 1])
        if i or into is None:
            d = d @ ws[2 * i].T
        if i:
            d *= acts[i] > 0
    return grads, d


def _shapes(n_in: int, hidden: tuple[int, ...]) -> list[tuple[int, ...]]:
    sizes = [n_in, *hidden, 1]
    return [s for a, b in zip(sizes[:-1], sizes[1:]) for s in ((a, b), (b,))]


def _views(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return [p.reshape(s) for p, s in zip(np.split(flat, cuts), shapes)]


def _flat(ws: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in ws])


def _pack(ws: list[np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, *ws)
    return buf.getvalue()


def _unpack(blob: bytes) -> list[np.ndarray]:
    z = np.load(io.BytesIO(blob))
    return [z[f"arr_{i}"] for i in range(len(z.files))]


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, len(FEATURE_COLS)))


@dataclass
class MLPResult:
    weights: list[np.ndarray]
    y_mean: float = 0.0
    y_std: float = 1.0
    history: list[tuple[int, float, float, float, bool]] = field(default_factory=list)
    seconds: float = 0.0
    best_epoch: int = 0
    error: str | None = None

    def save(self, spark, path: str) -> None:
        row = (_pack(self.weights), self.y_mean, self.y_std, self.best_epoch)
        spark.createDataFrame([row], "weights binary, y_mean double, y_std double, best_epoch int").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> MLPResult:
        r = spark.read.parquet(path).first()
        return MLPResult(_unpack(bytes(r["weights"])), r["y_mean"], r["y_std"], best_epoch=r["best_epoch"])

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``y_pred`` (and ``y_true`` from ``label``) with broadcast weights, Arrow batches."""
        spark = df.sparkSession
        ship_package(spark)
        bc = spark.sparkContext.broadcast(_pack(self.weights))
        mu, sd = self.y_mean, self.y_std
        keep = [c for c in df.columns if c not in ("features",)]
        src = df.select(*keep, vector_to_array("features").alias("x"))

        def run(batches):
            ws = _unpack(bc.value)
            for b in batches:
                y = forward(ws, _matrix(b.column(len(keep))).astype(np.float32))[0].astype(np.float64) * sd + mu
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(y)], names=[*b.schema.names[:-1], "y_pred"])

        return src.mapInArrow(run, src.drop("x").schema.add("y_pred", "double")).withColumn("y_true", F.col("label"))

    def metrics(self, df: DataFrame) -> DataFrame:
        return EV.regression_metrics(self.predict(df))

    def history_df(self, spark, job_id: int = 0) -> DataFrame:
        return spark.createDataFrame(
            [(job_id, e, tl, vl, b, ib) for e, tl, vl, b, ib in self.history],
            "job_id long, epoch int, train_loss double, val_loss double, best_val_loss double, is_best boolean")


@dataclass(frozen=True)
class Trial:
    """One model: its settings, the rows it trains on (``train_from`` <= level) and those it watches (``held`` == watch)."""

    hidden: tuple[int, ...] = (512, 256, 128, 64)
    epochs: int = 30
    batch_size: int = 64
    lr: float = 1e-3
    weight_decay: float = 1e-5
    patience: int = 20
    seed: int = 42
    level: int = 0
    watch: int = 0

    @property
    def cost(self) -> float:
        return sum(float(np.prod(s)) for s in _shapes(len(FEATURE_COLS), tuple(self.hidden))) * (1 + 64 / max(1, self.batch_size))


@dataclass
class Packed:
    """Shards on file, in groups of ``run``, and, per level, the mean and deviation of the labels trained on."""

    units: DataFrame
    shards: int
    groups: int
    run: int
    rows: int
    stats: dict[int, tuple[float, float]]


def pack(rows: DataFrame, seed: int = 42, shards: int | None = None) -> Packed:
    """Shards of (features, label, train_from, held): rows train models of level >= train_from (null: none) and are watched by models with watch == held.

    A shard of more than twice its share (many rows of one id) is cut into pieces in order.
    """
    spark = rows.sparkSession
    ship_package(spark)
    place = F.xxhash64("event_id", F.lit(seed)) if "event_id" in rows.columns else F.xxhash64(vector_to_array("features"), "label")
    flat = rows.select(vector_to_array("features").cast("array<float>").alias("x"), F.col("label").cast("double").alias("y"), F.coalesce("train_from", F.lit(NEVER)).cast("int").alias("train_from"),
                       F.coalesce("held", F.lit(-1)).cast("int").alias("held"), place.alias("place"))
    per_level = flat.groupBy("train_from").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).collect()  # a row per fold or size
    n_rows = sum(r.n for r in per_level)
    shards, run_of = shards or max(1, -(-n_rows // SHARD_ROWS)), 1
    while run_of < MOST_RUN and -(-shards // run_of) > GROUPS:
        run_of *= 2
    groups = -(-shards // run_of)
    shard = F.pmod("place", F.lit(shards)).cast("long")
    dealt = flat.withColumns({"shard": shard, "grp": F.floor(shard / run_of).cast("int")}).repartition(groups, "grp").sortWithinPartitions("shard", "place", "y")
    most = 2 * SHARD_ROWS

    def run(batches):
        key, held, n, piece = None, [], 0, 0

        def out():
            t = [np.concatenate([h[i] for h in held]) for i in range(4)]
            return pa.RecordBatch.from_arrays([pa.array([key[1]], pa.int32()), pa.array([key[0]], pa.int64()), pa.array([piece], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in t]],
                                              names=["grp", "shard", "piece", "x", "y", "train_from", "held"])

        for b in batches:
            x = _matrix(b.column(0)).astype("<f4")
            y, start, watch, of, grp = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("y", "train_from", "held", "shard", "grp"))
            edges = np.flatnonzero(np.diff(of)) + 1
            for a, z in zip([0, *edges], [*edges, len(of)]):
                if a == z:
                    continue
                own = (int(of[a]), int(grp[a]))
                if own != key:
                    if n:
                        yield out()
                    key, held, n, piece = own, [], 0, 0
                while a < z:
                    to = min(z, a + most - n)
                    held.append((x[a:to], y[a:to].astype("<f8"), start[a:to].astype("<i4"), watch[a:to].astype("<i4")))
                    n, a = n + to - a, to
                    if n == most:
                        yield out()
                        held, n, piece = [], 0, piece + 1
        if n:
            yield out()

    path = scratch_path(spark, "mlp-shards")
    schema = "grp int, shard long, piece int, x binary, y binary, train_from binary, held binary"
    dealt.mapInArrow(run, schema).write.parquet(path)
    stats, n, m, v = {}, 0, 0.0, 0.0
    for r in sorted(per_level, key=lambda r: r.train_from):  # pooled over levels up to this one
        if r.train_from == NEVER:
            continue
        gap, both = r.m - m, n + r.n
        v = (n * v + r.n * r.v) / both + gap * gap * n * r.n / both**2
        m, n = m + gap * r.n / both, both
        stats[r.train_from] = (m, float(np.sqrt(v)) or 1.0)
    return Packed(spark.read.schema(schema).parquet(path), shards, groups, run_of, n_rows, stats)


def _level_stats(packed: Packed, level: int) -> tuple[float, float]:
    upto = [k for k in packed.stats if k <= level]
    if not upto:
        raise ValueError("no rows to train on")
    return packed.stats[max(upto)]


def _unit(row: dict, trial: Trial, mu: float, sd: float, watched: bool) -> tuple[np.ndarray, np.ndarray]:
    """(x, standardised y) of the rows of a shard that a trial trains on or watches."""
    x = np.frombuffer(row["x"], "<f4").reshape(-1, len(FEATURE_COLS))
    y = np.frombuffer(row["y"], "<f8")
    use = np.frombuffer(row["held"], "<i4") == trial.watch if watched else np.frombuffer(row["train_from"], "<i4") <= trial.level
    if not use.all():
        x, y = x[use], y[use]
    return x, ((y - mu) / sd).astype(np.float32)


def _train(trial: Trial, state: tuple[np.ndarray, np.ndarray, np.ndarray, float], x: np.ndarray, y: np.ndarray, key: list[int]) -> tuple[np.ndarray, float, float]:
    """One pass of mini-batch Adam over a shard: (weights, means and squares end to end, sum of squared errors, steps)."""
    shapes = _shapes(x.shape[1], tuple(trial.hidden))
    w, m, v = (a.copy() for a in state[:3])
    g, tmp = np.empty_like(w), np.empty_like(w)
    ws, gs, steps, sse = _views(w, shapes), _views(g, shapes), state[3], 0.0
    order = np.random.default_rng(key).permutation(len(y))
    for s in range(0, len(y), trial.batch_size):
        idx = order[s:s + trial.batch_size]
        out, acts = forward(ws, x[idx])
        err = out - y[idx]
        sse += float(err @ err)
        backward(ws, acts, err * np.float32(2.0 / len(idx)), gs)
        steps += 1
        np.multiply(w, np.float32(trial.weight_decay), out=tmp)
        g += tmp
        m *= np.float32(B1)
        m += np.multiply(g, np.float32(1 - B1), out=tmp)
        v *= np.float32(B2)
        np.multiply(g, g, out=tmp)
        v += np.multiply(tmp, np.float32(1 - B2), out=tmp)
        np.sqrt(v, out=tmp)
        tmp *= np.float32(1 / np.sqrt(1 - B2**steps))
        tmp += np.float32(EPS)
        np.divide(m, tmp, out=tmp)
        tmp *= np.float32(trial.lr / (1 - B1**steps))
        w -= tmp
    return np.concatenate([w, m, v]), sse, steps


_PART = "trial int, grp int, train_n long, train_sse double, steps double, val_n long, val_sse double, seconds double, error string, blob binary"


def _added(parts: list) -> tuple:
    """Sum of partial results (train_n, train_sse, steps, val_n, val_sse, seconds, error, blob) in the order given; blobs and steps come weighted by rows."""
    total, blob = [0, 0.0, 0.0, 0, 0.0, 0.0], None
    error = next((p[6] for p in parts if p[6]), None)
    for p in parts:
        total = [a + b for a, b in zip(total, p[:6])]
        if p[7] is not None:
            blob = p[7] if blob is None else blob + p[7]
    return (*total, error, blob)


def _raised(parts: list[tuple[int, int, tuple]], top: int) -> list[tuple[int, int, tuple]]:
    """Results (level, number, sum) in order of their shards, added up pairwise until all are of level ``top``.

    A sum of level l and number k is over the shards k * 2^l and on, so it does not depend on how shards are dealt to tasks.
    """
    for level in range(top):
        out: list[tuple[int, int, tuple]] = []
        for l, k, p in parts:
            if l == level:
                l, k = l + 1, k >> 1
            if out and out[-1][:2] == (l, k):
                p = _added([out.pop()[2], p])
            out.append((l, k, p))
        parts = out
    return parts


def _pushed(parts: list[tuple[int, int, tuple]], shard: int, part: tuple) -> None:
    """Take in the next shard's result: a few sums are held, however many shards there are."""
    level = 0
    while parts and shard & 1 and parts[-1][:2] == (level, shard - 1):
        part, shard, level = _added([parts.pop()[2], part]), shard >> 1, level + 1
    parts.append((level, shard, part))


def _batch(rows: list[tuple], last: bool) -> pa.RecordBatch:
    """Partial results (trial, number, sum); the last sums are sent as means in single precision."""
    cells = [None if p[7] is None else (p[7] / p[0]).astype("<f4").tobytes() if last else p[7].tobytes() for _, _, p in rows]
    cols = [*zip(*[(i, k, *p[:7]) for i, k, p in rows])]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types)], pa.array(cells, pa.binary())], names=[f.split()[0] for f in _PART.split(", ")])


def _tree(parts: DataFrame, runs: int) -> list:
    """A row per trial: its runs' sums, added up in Spark; a sum over one run has been closed by its task."""
    names = ["train_n", "train_sse", "steps", "val_n", "val_sse", "seconds", "error"]
    fan = FAN

    def added(last: bool):
        def add(t: pa.Table) -> pa.Table:
            t = t.sort_by("grp")
            blobs = [np.frombuffer(v.as_buffer(), "<f8") if v.is_valid else None for c in t.column("blob").chunks for v in c]
            own = [(0, k, (*p, blob)) for k, p, blob in zip(t.column("grp").to_pylist(), zip(*[t.column(c).to_pylist() for c in names]), blobs)]
            return pa.Table.from_batches([_batch([(t.column("trial")[0].as_py(), k, p) for _, k, p in _raised(own, fan.bit_length() - 1)], last)])

        return add

    while runs > 1:
        runs = -(-runs // fan)
        parts = parts.groupBy("trial", F.floor(F.col("grp") / fan).alias("_to")).applyInArrow(added(runs == 1), _PART)
    return [Row(**r) for r in parts.toArrow().to_pylist()]  # a row per trial; Arrow's bytes pass the driver's JVM as they are


@dataclass(frozen=True)
class _Layout:
    """Which tasks train which trials on which shards: a deck's trials share tasks, each over ``width`` groups in a row."""

    deck_of: dict[int, int]
    widths: tuple[int, ...]  # per deck, powers of two


def _layout(packed: Packed, live: list[int], trials: list[Trial], cores: int) -> _Layout:
    """Trials go to the deck of least cost, costly ones first; a deck gets tasks in proportion to its cost."""
    tasks = TASKS * cores
    costs = [0.0] * max(1, min(len(live), max(-(-tasks // packed.groups), MOST_DEALT // max(1, packed.rows))))
    deck_of = {}
    for i in sorted(live, key=lambda i: (-trials[i].cost, i)):
        deck_of[i] = costs.index(min(costs))
        costs[deck_of[i]] += trials[i].cost

    def widths(tasks: int) -> tuple[int, ...]:
        out = []
        for c in costs:
            wanted = max(1, math.ceil(tasks * c / max(sum(costs), 1e-9)))
            most = max(1, MOST_RUN // packed.run)
            out.append(min(most, 1 << (packed.groups - 1).bit_length() if wanted == 1 else 1 << (max(1, packed.groups // wanted).bit_length() - 1)))
        return tuple(out)

    few, more = widths(tasks), widths(FINER * tasks)
    return _Layout(deck_of, more if _span(costs, more, packed.groups, cores) < (1 - GAIN) * _span(costs, few, packed.groups, cores) else few)


def _span(costs: list[float], widths: tuple[int, ...], groups: int, cores: int) -> float:
    """What the core with most to do works through, if each takes the costliest task left."""
    busy = [0.0] * cores
    for c in sorted((c * min(w, groups - a) / groups for c, w in zip(costs, widths) for a in range(0, groups, w)), reverse=True):
        heapq.heapreplace(busy, busy[0] + c)
    return max(busy)


def _dealt(packed: Packed, layout: _Layout, costs: list[float]) -> DataFrame:
    """A partition per deck and run of groups, those of most work first, with the deck's shards."""
    spark = packed.units.sparkSession
    decks, slots = [], 0
    for d in sorted(range(len(layout.widths)), key=lambda d: -costs[d] * min(layout.widths[d], packed.groups)):
        decks.append((d, layout.widths[d], slots))
        slots += -(-packed.groups // layout.widths[d])
    table = spark.createDataFrame(decks, "deck int, width int, start int")
    units = packed.units.crossJoin(F.broadcast(table)).withColumn("run", F.floor(F.col("grp") / F.col("width")).cast("int"))
    units = units.withColumn("slot", F.col("start") + F.col("run")).drop("grp", "width", "start")
    return units.repartitionById(slots, "slot").sortWithinPartitions("slot", "shard", "piece").persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class _State:
    trial: Trial
    result: MLPResult
    held: tuple[np.ndarray, np.ndarray, np.ndarray, float]  # weights, means, squares, steps
    trained: int = 0  # epochs trained
    losses: list[float] = field(default_factory=list)
    best: np.ndarray | None = None
    best_loss: float = float("inf")
    since: int = 0
    done: bool = False
    follows: int | None = None  # a trial that is the same but for more epochs and passes through this one's


def _failed(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def fit_many(packed: Packed, trials: list[Trial], on_epoch_end=None) -> list[MLPResult]:
    """Train all trials, one job per epoch; a trial that fails has its ``error`` set and no weights."""
    spark = packed.units.sparkSession
    sc = spark.sparkContext
    states: list[_State] = []
    for t in trials:
        try:
            mu, sd = _level_stats(packed, t.level)
            ws = init_weights(len(FEATURE_COLS), tuple(t.hidden), t.seed)
            w = _flat(ws)
            states.append(_State(t, MLPResult(ws, mu, sd), (w, np.zeros_like(w), np.zeros_like(w), 0.0), best=w, done=t.epochs <= 0))
        except Exception as e:  # noqa: BLE001 - one model's failure does not end the others
            states.append(_State(t, MLPResult([], error=_failed(e)), (None, None, None, 0.0), done=True))
    if on_epoch_end is None:
        _share(states)
    still = lambda: [i for i, s in enumerate(states) if not s.done and s.follows is None]
    live, layout, units = still(), None, None
    try:
        while live:
            new = _layout(packed, live, trials, sc.defaultParallelism)
            if layout is None or new.widths != layout.widths or any(layout.deck_of.get(i) != d for i, d in new.deck_of.items()):
                if units is not None:
                    units.unpersist()
                layout = new
                units = _dealt(packed, layout, [sum(trials[i].cost for i, d in layout.deck_of.items() if d == k) for k in range(len(layout.widths))])
            told, spent = [len(states[i].result.history) for i in live], {i: states[i].result.seconds for i in live}
            _epoch(units, packed, states, live, layout)
            for i, n in zip(live, told):
                for e, tl, vl, best, is_best in states[i].result.history[n:] if on_epoch_end is not None else []:
                    on_epoch_end({"epoch": e, "train_loss": tl, "val_loss": vl, "best_val_loss": best, "is_best": is_best})
            for s in states:
                if s.follows in spent:
                    _follow(s, states[s.follows], spent[s.follows])
            live = still()
    finally:
        if units is not None:
            units.unpersist()
    for s in states:
        if s.result.error is None:
            s.result.weights = [w.copy() for w in _views(s.best, _shapes(len(FEATURE_COLS), tuple(s.trial.hidden)))]
    return [s.result for s in states]


def _share(states: list[_State]) -> None:
    """Of trials that differ in their epochs alone only the longest is trained: no setting looks at the epochs to come."""
    longest: dict[str, int] = {}
    for i in sorted((i for i, s in enumerate(states) if not s.done), key=lambda i: -states[i].trial.epochs):
        first = longest.setdefault(repr(replace(states[i].trial, epochs=0)), i)
        states[i].follows = None if first == i else first


def _follow(s: _State, leader: _State, spent: float) -> None:
    """Take over the leader's results once it has passed through all of this trial's epochs, or has stopped before.

    A leader that fails leaves the trial to be trained by itself. ``spent``: the leader's seconds before its last job.
    """
    own, r = s.result, leader.result
    if r.error is not None:
        s.follows = None
    elif leader.done or len(r.history) >= s.trial.epochs:
        own.history, own.best_epoch, own.seconds = list(r.history), r.best_epoch, r.seconds if leader.done else spent
        s.best, s.follows, s.done = leader.best, None, True


def _epoch(units: DataFrame, packed: Packed, states: list[_State], live: list[int], layout: _Layout) -> None:
    """One job: a pass of training for trials with epochs left, and the watched loss of the weights it starts from."""
    sent = {i: (states[i].trial, layout.deck_of[i], states[i].result.y_mean, states[i].result.y_std, states[i].trained, states[i].held) for i in live}
    bc = units.sparkSession.sparkContext.broadcast(sent)
    tops = [(packed.run * w).bit_length() - 1 for w in layout.widths]  # levels of the tasks' sums
    runs = max(-(-packed.groups // w) for w in layout.widths)

    def run(batches):
        work, at, own, held = bc.value, None, {}, {}  # own: sums of the shard at hand; held: of the shards before

        def shard_done():
            for i, part in own.items():
                _pushed(held.setdefault(i, []), at[2], part)
            own.clear()

        def slot_done():
            shard_done()
            # a trial at a time: their sums are as large as their models
            for i in sorted(held):
                yield _batch([(i, k, p) for _, k, p in _raised(held.pop(i), tops[at[1]])], runs == 1)

        for b in batches:
            for row in b.to_pylist():
                now = (row["slot"], row["deck"], row["shard"])
                if at is not None and now != at:
                    if now[0] != at[0]:
                        yield from slot_done()
                    else:
                        shard_done()
                at = now
                for i, (trial, deck, mu, sd, trained, start) in work.items():
                    if deck != row["deck"]:
                        continue
                    began, part = time.perf_counter(), None
                    try:
                        part = _unit_result(row, trial, mu, sd, trained, start)
                    except Exception as e:  # noqa: BLE001 - reported with the trial
                        part = (0, 0.0, 0.0, 0, 0.0, 0.0, _failed(e), None)
                    part = (*part[:5], time.perf_counter() - began, *part[6:])
                    own[i] = part if i not in own else _added([own[i], part])
        if at is not None:
            yield from slot_done()

    got = {r.trial: tuple(r)[2:] for r in _tree(units.mapInArrow(run, _PART), runs)}
    bc.destroy()
    for i in live:
        _advance(states[i], got.get(i, _added([])))


def _unit_result(row: dict, trial: Trial, mu: float, sd: float, trained: int, held: tuple) -> tuple:
    watch_n, watch_sse, train_n, train_sse, steps, blob = 0, 0.0, 0, 0.0, 0.0, None
    if trained:
        x, y = _unit(row, trial, mu, sd, watched=True)
        if len(y):
            err = (forward(_views(held[0], _shapes(x.shape[1], tuple(trial.hidden))), x)[0] - y).astype(np.float64)
            watch_n, watch_sse = len(y), float(err @ err)
    if trained < trial.epochs:
        x, y = _unit(row, trial, mu, sd, watched=False)
        if len(y):
            got, train_sse, steps = _train(trial, held, x, y, [trial.seed, trained, row["shard"], row["piece"]])
            train_n, steps, blob = len(y), steps * len(y), got.astype(np.float64) * len(y)
    return train_n, train_sse, steps, watch_n, watch_sse, 0.0, None, blob


def _advance(s: _State, got: tuple) -> None:
    """Take over an epoch's sums: the loss of the weights before it, early stopping, and the averaged weights."""
    train_n, train_sse, steps, val_n, val_sse, seconds, error, blob = got
    r, var = s.result, s.result.y_std ** 2
    r.seconds += seconds
    if error:
        r.error, s.done = error, True
        return
    if s.trained:
        epoch = s.trained - 1
        loss = val_sse / val_n * var if val_n else float("nan")
        is_best = loss < s.best_loss or not val_n
        if is_best:
            s.best, s.best_loss, s.since, r.best_epoch = s.held[0], loss, 0, epoch
        else:
            s.since += 1
        r.history.append((epoch, s.losses[epoch], loss, s.best_loss, is_best))
        if s.trained >= s.trial.epochs or (val_n and s.since >= s.trial.patience):
            s.done = True
            return
    if not train_n:
        r.error, s.done = "no rows to train on", True
        return
    w, m, v = np.split(np.frombuffer(blob, "<f4"), 3)
    s.held, s.trained = (w, m, v, steps / train_n), s.trained + 1
    s.losses.append(train_sse / train_n * var)


def score_many(packed: Packed, trials: list[Trial], results: list[MLPResult]) -> list[dict[str, tuple[int, float]]]:
    """Per trial (rows, r2) of its best weights on the rows it trained on (``train``) and watched (``held``): one job for all."""
    sent = {i: (t, r.y_mean, r.y_std, r.weights) for i, (t, r) in enumerate(zip(trials, results)) if r.error is None}
    bc = packed.units.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        sums = {}
        for b in batches:
            for row in b.to_pylist():
                for i, (trial, mu, sd, ws) in bc.value.items():
                    for watched in (False, True):
                        x, y = _unit(row, trial, mu, sd, watched)
                        if len(y):
                            err, y = (forward(ws, x)[0] - y).astype(np.float64), y.astype(np.float64)
                            got = np.array([len(y), err @ err, y.sum(), y @ y])
                            sums[i, watched] = sums.get((i, watched), 0) + got
        cols = list(zip(*[(i, w, *map(float, v)) for (i, w), v in sums.items()])) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.bool_(), *[pa.float64()] * 4])], names=["trial", "watched", "n", "sse", "s", "q"])

    rows = packed.units.mapInArrow(run, "trial int, watched boolean, n double, sse double, s double, q double").groupBy("trial", "watched").agg(*[F.sum(c).alias(c) for c in ("n", "sse", "s", "q")]).collect()
    out: list[dict] = [{} for _ in trials]
    for r in rows:
        sst = r.q - r.s * r.s / r.n
        out[r.trial]["held" if r.watched else "train"] = (int(r.n), 1 - r.sse / sst if sst > 0 else float(r.sse == 0))
    return out


def pack_splits(splits, seed: int = 42, shards: int | None = None) -> Packed:
    """Train rows at level 0, watched by none; validation rows watched by all."""
    id_cols = ["event_id"] if "event_id" in splits.train.columns else []
    columns = [*id_cols, "features", "label"]
    train = splits.train.select(*columns, F.lit(0).alias("train_from"), F.lit(None).cast("int").alias("held"))
    return pack(train.unionAll(splits.val.select(*columns, F.lit(None).cast("int"), F.lit(0))), seed, shards)


def fit_mlp(splits, hidden: tuple[int, ...] = (512, 256, 128, 64), epochs: int = 30, batch_size: int = 64, lr: float = 1e-3,
            weight_decay: float = 1e-5, patience: int = 20, seed: int = 42, shards: int | None = None,
            on_epoch_end=None) -> MLPResult:
    """Train one network on ``splits.train`` with early stopping on ``splits.val`` (none if it is empty)."""
    trial = Trial(tuple(hidden), epochs, batch_size, lr, weight_decay, patience, seed)
    t0 = time.time()
    res = fit_many(pack_splits(splits, seed, shards), [trial], on_epoch_end)[0]
    if res.error is not None:
        raise ValueError(res.error)
    res.seconds = time.time() - t0
    return res


def gradient_importance(result: MLPResult, df: DataFrame, n_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Mean |d prediction / d feature| over all rows (or ``n_rows`` hash-sampled ones), largest first.

    Each task sums its rows' gradients; Spark adds the sums up.
    """
    from .order import exact_sample

    spark = df.sparkSession
    ship_package(spark)
    rows = df if n_rows is None else exact_sample(df, "event_id", n=n_rows, seed=seed)
    bc = spark.sparkContext.broadcast(_pack(result.weights))
    sd = result.y_std
    names = list(FEATURE_COLS)

    def grads(batches):
        w = _unpack(bc.value)
        total, n = np.zeros(len(names)), 0
        for b in batches:
            x = _matrix(b.column(0)).astype(np.float32)
            _, dx = backward(w, forward(w, x)[1], np.ones(len(x), np.float32))
            total += np.abs(dx).sum(0, dtype=np.float64) * sd
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(np.full(len(names), n))], names=["feature", "total", "n"])

    long = rows.select(vector_to_array("features").alias("x")).mapInArrow(grads, "feature string, total double, n long")
    return (long.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("importance"))
            .orderBy(F.col("importance").desc(), "feature"))
