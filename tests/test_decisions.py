"""Rescans of the pre-large search are decided by the batches' utilities alone."""

from seqharvest.operators import incremental as inc

SCHEMA = "sid long, tid int, item int, util long, batch_id int"


def test_decisions_are_those_of_the_maintenance(spark):
    rows = [(s, t, i, u, b) for b, u, n in ((0, 50, 6), (1, 2, 2), (2, 1, 1), (3, 40, 4), (4, 1, 2)) for s in range(10 * b, 10 * b + n) for t in range(2) for i in (1, 2)]
    raw = spark.createDataFrame(rows + [(None, 0, 1, 999, 1), (3, 0, None, 999, 2), (4, 0, 1, -7, 0)], SCHEMA)
    sizes = inc.batch_sizes(raw, 5)
    assert sizes == [1200, 16, 4, 640, 8]
    log = inc.decisions(sizes, 0.3, 0.3)
    assert log == inc.prelarge(raw, 0.3, 0.3, 5)[1]
    assert [r["rescan"] for r in log] == [True, False, False, True, False] and [r["buffer"] for r in log] == [1200, 16, 20, 660, 8]


def test_batches_without_rows(spark):
    raw = spark.createDataFrame([(1, 0, 1, 5, 1)], SCHEMA)
    assert inc.batch_sizes(raw, 3) == [0, 5, 0]
    assert [r["rescan"] for r in inc.decisions([0, 5, 0], 0.3, 0.3)] == [True, True, False]
    assert inc.decisions([], 0.3, 0.3) == []


def test_deciding_searches_nothing(spark):
    raw = spark.createDataFrame([(s, t, i, 5, s % 3) for s in range(12) for t in range(2) for i in (1, 2)], SCHEMA)
    spark.sparkContext.setJobGroup("decide", "decide")
    inc.decisions(inc.batch_sizes(raw, 3), 0.1, 0.3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("decide")) <= 3
