"""Frontiers of named patterns are held in the buckets of their positions, so that growing them shuffles nothing."""

import random

from pyspark.sql import functions as F

from seqharvest.operators import tree
from seqharvest.operators.incremental import follow
from seqharvest.operators.mine import grow_named, held_dealt, positions
from seqharvest.storage import _AT, cut, steps

SCHEMA = "sid long, tid int, item int, util long"


def rows(seed, first=0):
    rng = random.Random(seed)
    return [(s, t, i, rng.randint(1, 30)) for s in range(first, first + 30) for t in range(4) for i in rng.sample(range(1, 6), 2)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_followed_names_are_grown_in_their_buckets(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with steps(spark):
            pos = held_dealt(cut(positions(spark.createDataFrame(rows(7), SCHEMA))))
            names = spark.createDataFrame([("1)(2,3",), ("2)(1)(4",)], "pat string")
            fronts = dict(follow(pos, names))
            assert sorted(fronts) == [1, 2, 3]
            for n in (2, 3):
                assert fronts[n] in _AT and exchanges(grow_named(fronts[n], pos, held=True)) == 0
            assert {r["pat"] for r in fronts[3].select("pat").distinct().collect()} <= {"1)(2,3", "2)(1)(4"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_tree_holds_its_frontiers_and_positions_by_bucket(spark):
    kept = tree.PatternTree(0.05)
    for b in range(2):
        kept.add(spark.createDataFrame(rows(8 + b, 100 * b), SCHEMA))
    assert kept.pos in _AT and all(level.front in _AT for level in kept.levels) and len(kept.levels) > 1
    assert exchanges(grow_named(kept.levels[0].front, kept.pos, held=True)) == 0
    assert kept.levels[0].front.where(F.col("origin") == tree.NEW).count() > 0
