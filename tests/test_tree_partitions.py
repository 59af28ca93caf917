"""Spark's trees learn in few partitions, whatever the rows."""

from demandlake.operators import models as M
from demandlake.plans import fixtures as FX

from .conftest import SF_SMALL


def test_partitions_of_trees_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(M, "PARTITION_ROWS", 10)
    monkeypatch.setattr(M, "TREE_PARTITIONS", 3)
    seen, estimator = [], M.make_estimator

    class Spy:
        def __init__(self, own):
            self.own = own

        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            return self.own.fit(rows)

    monkeypatch.setattr(M, "make_estimator", lambda *a, **kw: Spy(estimator(*a, **kw)))
    with M.prepare_splits(FX.demand(spark, SF_SMALL)) as s:
        n = s.train.count()
        assert s.held.rdd.getNumPartitions() <= 48
        M.fit_model("forest", s.train, numTrees=2, maxDepth=2)
        M.fit_model("gbt", s.train, maxIter=1)
        assert seen == [(3, n), (3, n)]
        monkeypatch.setattr(M, "MOST_TREE_ROWS", 100)
        assert M.few_partitions(s.train, n).rdd.getNumPartitions() == -(-n // 100)
        monkeypatch.setattr(M, "PARTITION_ROWS", n)
        assert M.few_partitions(s.train, n) is s.train
