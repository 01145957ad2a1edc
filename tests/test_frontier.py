"""What a search holds and shuffles between its levels."""

import random

import pytest
from pyspark.sql import functions as F

from seqharvest.operators.mine import Search, mine, positions
from seqharvest.storage import _AT, cut, steps

SCHEMA = "sid long, tid int, item int, util long"


def rows(seed):
    rng = random.Random(seed)
    return [(s, t, i, rng.randint(1, 30)) for s in range(40) for t in range(4) for i in rng.sample(range(1, 7), 3)]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frontier_is_not_shuffled(spark, no_broadcast):
    """Growing a frontier and its windows keep to the buckets that ends and positions are held in."""
    with steps(spark):
        pos = cut(positions(spark.createDataFrame(rows(3), SCHEMA)))
        search = Search(pos, 0.0)
        open_ = search.nodes()
        search.advance(open_, open_.count(), 0.0)
        plan = search.front()._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Exchange" not in plan
        first = search.ends
        # a level holds the ends of extended nodes only, and the level before holds none any more
        nodes = search.nodes()
        some = nodes.orderBy("id").limit(3)
        search.advance(cut(some), 3, 0.0)
        assert set(search.ends.columns) == {"sid", "share", "parent", "tid", "k", "iu"}
        assert {r["parent"] for r in search.ends.select("parent").distinct().collect()} == {r["id"] for r in some.collect()}
        assert first not in _AT and search.ends in _AT


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_only(spark, seed):
    """Nodes that are neither patterns nor extended are left out, and nothing else."""
    pos = positions(spark.createDataFrame(rows(seed), SCHEMA))
    whole, lean = mine(pos, 0.05), mine(pos, 0.05, patterns_only=True)
    as_set = lambda df: set(map(tuple, df.collect()))
    assert as_set(lean.patterns()) == as_set(whole.patterns()) != set()
    need = F.lit(whole.theta) * F.col("len")
    kept = whole.nodes().where((F.col("u") >= need) | (F.col("bound") >= F.lit(whole.theta) * (F.col("len") + 1)))
    assert as_set(lean.nodes()) == as_set(kept) != as_set(whole.nodes())
