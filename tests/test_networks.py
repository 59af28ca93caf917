"""What an epoch of networks shuffles and sends to the driver."""

import pytest

from demandlake.operators import mlp, models
from demandlake.operators.models import _trial, prepare_splits, sample_params
from demandlake.plans import fixtures as FX
from demandlake.plans.catalog import TUNE_SPACE

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def splits(spark):
    with prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        yield s


def test_driver_gets_one_state_per_network(splits, monkeypatch):
    got, tree = [], mlp._tree
    monkeypatch.setattr(mlp, "_tree", lambda *a: got.append(tree(*a)) or got[-1])
    trials = [mlp.Trial((8,), epochs=2), mlp.Trial((16, 8), epochs=1)]
    mlp.fit_many(mlp.pack_splits(splits, shards=20), trials)
    assert [sorted(r.trial for r in rows) for rows in got] == [[0, 1], [0, 1], [0]]
    for r in got[0]:  # weights, means and squares in single precision
        assert len(r.blob) == 3 * 4 * len(mlp._flat(mlp.init_weights(24, trials[r.trial].hidden, 42)))


def test_groups_do_not_follow_rows_and_weights_do_not_follow_tasks(splits, monkeypatch):
    packed = mlp.pack_splits(splits, shards=130)
    assert packed.groups <= mlp.GROUPS and packed.run == 4
    assert packed.units.agg({"grp": "max"}).first()[0] < packed.groups
    trials, fits = [mlp.Trial((8,), epochs=2, lr=1e-2), mlp.Trial((4, 4), epochs=2, batch_size=16)], []
    for tasks, dealt in ((1, 0), (1, 1 << 24), (50, 1 << 24)):
        monkeypatch.setattr(mlp, "TASKS", tasks)
        monkeypatch.setattr(mlp, "MOST_DEALT", dealt)
        fits.append(mlp.fit_many(packed, trials))
    for fit in fits[1:]:
        assert all((a == b).all() for one, two in zip(fit, fits[0]) for a, b in zip(one.weights, two.weights))


def test_pairwise_sums_skip_missing_shards():
    part = lambda n: (n, 0.0, 0.0, 0, 0.0, 0.0, None, None)
    held = []
    for shard in (1, 4, 6, 7, 8):
        mlp._pushed(held, shard, part(shard))
    assert [(level, k) for level, k, _ in held] == [(0, 1), (0, 4), (1, 3), (0, 8)]
    assert [(level, k, p[0]) for level, k, p in mlp._raised(held, 3)] == [(3, 0, 18), (3, 1, 8)]


def test_tasks_send_few_states_per_network(splits, monkeypatch):
    seen, tree = [], mlp._tree
    monkeypatch.setattr(mlp, "_tree", lambda parts, runs: seen.append((parts.count(), runs)) or tree(parts, runs))
    packed = mlp.pack_splits(splits, shards=256)
    mlp.fit_many(packed, [mlp.Trial((8,), epochs=1)])
    cores = splits.train.sparkSession.sparkContext.defaultParallelism
    assert packed.groups == 64
    assert min(64, cores) <= seen[0][0] == seen[0][1] < 2 * cores


def test_states_pass_the_driver_as_arrow(splits, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    packed, found = mlp.pack_splits(splits, shards=20), []
    monkeypatch.setattr(DataFrame, "collect", lambda self: found.append(self.columns) or [])
    assert [r.error for r in mlp.fit_many(packed, [mlp.Trial((8,), epochs=1)])] == [None]
    assert not [c for c in found if "blob" in c]


def test_rows_of_networks_are_not_dealt(spark, splits):
    with prepare_splits(FX.demand(spark, SF_SMALL), dealt=False) as own:
        plan = own.held._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" not in plan
        one, two = (mlp.fit_mlp(s, hidden=(8,), epochs=2, shards=4) for s in (own, splits))
        assert all(abs(a - b).max() < 1e-5 for a, b in zip(one.weights, two.weights))


def test_tasks_fill_the_cores():
    packed = lambda shards, run=1: mlp.Packed(None, shards * run, shards, run, 1 << 24, {})
    # one network: 32 groups on 6 cores took two rounds of 4 groups, 46 (in runs of 8 shards) on 8 cores as well
    for groups, run, cores, want in ((32, 1, 6, 2), (46, 8, 8, 2), (32, 1, 8, 4), (64, 1, 4, 16)):
        assert mlp._layout(packed(groups, run), [0], [mlp.Trial()], cores).widths == (want,)
    trials = [_trial(p) for p in sample_params(TUNE_SPACE, 10, 42)]  # the search's first phase, 1.2 times the ideal before
    own = mlp.Packed(None, 32, 32, 1, 510_000, {})
    for cores in (6, 8):
        layout = mlp._layout(own, list(range(10)), trials, cores)
        costs = [sum(trials[i].cost for i, d in layout.deck_of.items() if d == k) for k in range(10)]
        assert mlp._span(costs, layout.widths, 32, cores) < 1.1 * sum(costs) / cores
        assert sum(-(-32 // w) for w in layout.widths) <= 4 * cores


def _equal(one, two):
    same = all((a == b).all() for a, b in zip(one.weights, two.weights, strict=True))
    return same and one.history == two.history and one.best_epoch == two.best_epoch


def test_trials_that_differ_in_epochs_alone_are_trained_once(splits, monkeypatch):
    packed, seen, epoch, advance = mlp.pack_splits(splits, shards=3), [], mlp._epoch, mlp._advance
    own = {"hidden": (8,), "lr": 1e-2}
    trials = [mlp.Trial(epochs=1, **own), mlp.Trial(epochs=4, **own), mlp.Trial(epochs=4, **own), mlp.Trial(epochs=2, **own), mlp.Trial(epochs=2, **own, seed=1),
              mlp.Trial(epochs=0, **own), mlp.Trial((8,), epochs=9, patience=0), mlp.Trial((8,), epochs=8, patience=0)]
    single = [mlp.fit_many(packed, [t])[0] for t in trials]
    assert len(single[6].history) == 1  # stops early
    monkeypatch.setattr(mlp, "_epoch", lambda *a: seen.append(a[3]) or epoch(*a))
    many = mlp.fit_many(packed, trials)
    assert all(_equal(a, b) for a, b in zip(many, single)) and all(r.seconds > 0 for r in many if r.history)
    assert {i for live in seen for i in live} == {1, 4, 6}

    def failing(s, got):
        advance(s, got)
        if s.trial.epochs == 4 and s.trained == 2:
            s.result.error, s.done = "stopped by the test", True

    monkeypatch.setattr(mlp, "_advance", failing)
    many = mlp.fit_many(packed, trials[:2] + trials[3:4])
    assert many[1].error and all(r.error is None and _equal(r, w) for r, w in ((many[0], single[0]), (many[2], single[3])))


def test_search_takes_shorter_trials_from_longer_ones(splits, monkeypatch):
    p = {"hidden": [8], "lr": 1e-2}
    (want, _, _), = models._network_trials(splits)([{**p, "epochs": 1}])
    run = models._network_trials(splits, [1, 3, 5])
    run([{**p, "epochs": 3}])
    monkeypatch.setattr(mlp, "_epoch", None)
    assert run([{**p, "epochs": 1}, {**p, "epochs": 1}])[0][0] == want
    assert run([{**p, "epochs": 1, "dropout": 0.5}])[0][0] == float("-inf")
