"""The pair filter inside a search: pairs are summed only where the search is grown by them."""

import random

import pytest
from pyspark.sql import functions as F

from seqharvest.operators import mine as m
from seqharvest.operators.cooccurrence import pair_filter
from seqharvest.storage import cut, steps

SCHEMA = "sid long, tid int, item int, util long"


def rows(seed):
    rng = random.Random(seed)
    return [(s, t, i, rng.randint(1, 30)) for s in range(30) for t in range(4) for i in rng.sample(range(1, 9), 3)]


def as_set(df):
    return set(map(tuple, df.collect()))


@pytest.mark.parametrize("broadcast", [100_000, 3])
def test_nodes_and_counters_are_those_of_the_whole_table(spark, monkeypatch, broadcast):
    monkeypatch.setattr(m, "BROADCAST_ROWS", broadcast)
    pos = cut(m.positions(spark.createDataFrame(rows(4), SCHEMA)))
    theta = 0.4 * m.total_utility(pos)
    found = m.mine(pos, theta=theta, options=m.Options(eucs=True, bound=False, length_swu=False, max_len=3), counters=True)
    plain = m.mine(pos, theta=theta, options=m.Options(bound=False, length_swu=False, max_len=3)).nodes()
    allowed = {(r["kind"] == "i", r["last_item"], r["new_item"]) for r in pair_filter(pos, theta).collect()}

    def passes(pat):
        sets = [x.split(",") for x in pat.split(")(")]
        steps_ = [(j > 0, s[j]) for s in sets for j in range(len(s))]
        return all((inside, int(a), int(b)) in allowed for (_, a), (inside, b) in zip(steps_, steps_[1:]))

    expected = {x for x in as_set(plain) if passes(x[0])}
    assert as_set(found.nodes()) == expected != as_set(plain)
    assert all(n > 0 for _, n, _, _ in found.dropped) and sum(d for *_, d in found.dropped) > 0


def test_a_frontier_of_pairs_is_not_shuffled(spark, monkeypatch):
    """Neither the second level, whose patterns are pairs, nor a later one is joined with pairs by shuffling its rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with steps(spark):
            pos = cut(m.positions(spark.createDataFrame(rows(5), SCHEMA)))
            search = m.Search(pos, 0.0, 1.0)
            for _ in range(2):
                open_ = search.nodes()
                search.advance(open_, open_.count(), 0.0)
                plan = search.front()._jdf.queryExecution().executedPlan().toString()
                assert "Window" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
