"""A level that makes many rows is dealt out to more tasks than shuffles have partitions."""

import random

from pyspark.sql import functions as F

from seqharvest.operators import mine as mining
from seqharvest.operators.mine import Search, mine, positions
from seqharvest.storage import cut, steps

SCHEMA = "sid long, tid int, item int, util long"


def rows(seed, sequences, items):
    rng = random.Random(seed)
    return [(s, t, i, rng.randint(1, 30)) for s in range(sequences) for t in range(3) for i in rng.sample(range(1, items + 1), 2)]


def test_rows_of_a_task(spark, monkeypatch):
    """Work of a task is bounded at every level, and what is dealt anew isn't shuffled again."""
    monkeypatch.setattr(mining, "ROWS", 500)
    monkeypatch.setattr(mining, "HEAVY", 10_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with steps(spark):
            search = Search(cut(positions(spark.createDataFrame(rows(3, 40, 5), SCHEMA))), 0.0)
            before = search.n
            for _ in range(2):
                open_ = search.nodes()
                search.advance(open_, open_.count(), 0.0)
            assert search.n > before
            plan = search.front()._jdf.queryExecution().executedPlan().toString()
            assert "Window" in plan and "Exchange" not in plan
            # hashes deal sequences out unevenly, so a task may have several times the mean
            tasks = search.front().groupBy(F.spark_partition_id().alias("p")).count()
            assert tasks.count() > before and tasks.agg(F.max("count")).first()[0] <= 10 * 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_same_results(spark, monkeypatch):
    pos = positions(spark.createDataFrame(rows(5, 15, 3), SCHEMA))
    found = lambda: set(map(tuple, mine(pos, 0.17).nodes().collect()))
    once, dealt = found(), []
    buckets = Search._buckets
    monkeypatch.setattr(Search, "_buckets", lambda self, open_: dealt.append(buckets(self, open_)) or dealt[-1])
    monkeypatch.setattr(mining, "ROWS", 40)
    assert found() == once and max(dealt) > 4
