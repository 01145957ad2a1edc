"""The answers after every batch from one search."""

import random

from pyspark.sql import functions as F

from seqharvest.operators.mine import positions
from seqharvest.operators.views import by_batch, spans
from test_mining import answer

SCHEMA = "sid long, tid int, item int, util long, batch_id int"


def random_batches(seed, appended):
    """Rows of 14 sequences in three of four batches (the second is empty); appended: some sequences go on in a later batch."""
    rng, out = random.Random(seed), []
    for s in range(14):
        first = rng.choice([0, 2, 3])
        for t in range(4):
            batch = 3 if appended and t > 1 and s % 3 == 0 else first
            out += [(s, t, i, rng.randint(1, 30) * (5 if batch == 3 else 1), batch) for i in rng.sample(range(1, 6), 2)]
    return out


def check(spark, rows):
    got = {}
    for r in by_batch(spark.createDataFrame(rows, SCHEMA), 0.12, 4).collect():
        assert r["avg_utility"] == r["utility"] / r["len"]
        got.setdefault(r["batch_id"], []).append((r["pattern"], r["utility"], r["support"]))
    for b in range(4):
        assert sorted(got.get(b, [])) == sorted(answer([r[:4] for r in rows if r[4] <= b], 0.12)), b
    assert len({frozenset(x) for x in got.values()}) > 1


def test_answers_are_those_of_each_prefix(spark):
    check(spark, random_batches(5, False))


def test_sequences_that_go_on_in_later_batches(spark):
    rows = random_batches(6, True)
    check(spark, rows)
    made = spans(spark.createDataFrame(rows, SCHEMA), 4)
    assert made.where(F.col("sid").startswith("0:")).select("sid").distinct().count() == len({r[4] for r in rows if r[0] == 0})


def test_no_rows_and_rows_without_use(spark):
    assert by_batch(spark.createDataFrame([], SCHEMA), 0.1, 3).collect() == []
    assert by_batch(spark.createDataFrame([(1, 0, 1, 0, 0), (None, 0, 1, 5, 1)], SCHEMA), 0.1, 3).collect() == []


def test_one_search_serves_all_batches(spark):
    """Jobs don't grow with the number of batches, as they did with a search for each."""

    def jobs(batches):
        rows = [(s, t, i, 3 + s % 5, s % batches) for s in range(24) for t in range(3) for i in (1, 2, 3)]
        tag = f"batches-{batches}"
        spark.sparkContext.setJobGroup(tag, tag)
        by_batch(spark.createDataFrame(rows, SCHEMA), 0.15, batches)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))

    assert jobs(6) < 1.5 * jobs(2)
