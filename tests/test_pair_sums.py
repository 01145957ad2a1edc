"""Sums of S pairs, and how they are brought together."""

import random

import pytest
from pyspark.sql import functions as F

from seqharvest.operators import cooccurrence as co
from seqharvest.operators.mine import positions

SCHEMA = "sid long, tid int, item int, util long"


def brute(rows):
    by, out = {}, {}
    for s, t, i, u in rows:
        by.setdefault(s, []).append((t, i, u))
    for seq in by.values():
        su, items = sum(u for *_, u in seq), {i for _, i, _ in seq}
        at = {x: [t for t, i, _ in seq if i == x] for x in items}
        for a in items:
            for b in items - {a}:
                if min(at[a]) < max(at[b]):
                    out[a, b] = out.get((a, b), 0) + su
    return out


@pytest.mark.parametrize("block, frequent, pairs", [(2_000, 20_000, 4_000_000), (2_000, 6, 50), (5, 20_000, 50), (5, 6, 50), (1, 1, 1)])
def test_sums(spark, monkeypatch, block, frequent, pairs):
    """Items of many or of long sequences are summed apart, with the same result."""
    monkeypatch.setattr(co, "BLOCK", block)
    monkeypatch.setattr(co, "FREQUENT", frequent)
    monkeypatch.setattr(co, "PAIRS", pairs)
    rng = random.Random(4)
    rows = [(s, t, i, rng.randint(1, 9)) for s in range(12) for t in range(3) for i in rng.sample(range(1, 14 if s == 3 else 7), 6 if s == 3 else 2)]
    got = co.s_pairs(positions(spark.createDataFrame(rows, SCHEMA)))
    assert {(r["a"], r["b"]): r["swu"] for r in got.collect()} == brute(rows) and got.count() == len(brute(rows))


def test_no_rows(spark):
    assert co.s_pairs(positions(spark.createDataFrame([], SCHEMA))).collect() == []


def test_an_item_is_sent_once_a_sequence(spark):
    """Only rows of (item, list) are shuffled, not a row a pair."""
    rows = [(s, t, i, 1) for s in range(6) for t in range(3) for i in range(4)]
    plan = co.s_pairs(positions(spark.createDataFrame(rows, SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(a#" in plan and ", b#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
