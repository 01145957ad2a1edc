"""Ten batches are answered by one search, at the price of one."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from seqharvest.operators.views import by_batch

SF = "/root/testdata/sf0.001"


def test_jobs_of_ten_batches(spark):
    """A store made by ten batches ran over 800 jobs."""
    spark.sparkContext.setJobGroup("ten", "ten")
    try:
        found = queries()["ten_batches_hausp"](spark, SF)
        assert {r["batch_id"] for r in found.select("batch_id").distinct().collect()} == set(range(10))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ten")) < 200
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("batches", [1, 10])
def test_sums_by_span(spark, batches):
    """A node's sums in a view are those of the view's sequences, whatever spans they have."""
    rows = [(s, t, 1 + (s + t) % 3, 10 + s, s % batches) for s in range(20) for t in range(3)]
    found = by_batch(spark.createDataFrame(rows, "sid long, tid int, item int, util long, batch_id int"), 0.05, batches)
    single = {(r["batch_id"], r["pattern"]): (r["utility"], r["support"]) for r in found.where(F.col("len") == 1).collect()}
    for b in range(batches):
        held = [r for r in rows if r[4] <= b]
        for item in (1, 2, 3):
            best = {}
            for s, _, i, u, _ in held:
                if i == item:
                    best[s] = max(best.get(s, 0), u)
            if best and sum(best.values()) >= 0.05 * sum(r[3] for r in held):
                assert single[b, f"<({item})>"] == (sum(best.values()), len(best))
