"""Counters of a level that nothing reaches."""

from seqharvest.operators.mine import Options, layer_counters, mine, positions


def test_counters_of_an_empty_level(spark, request):
    """Item 1 is extended, but no other item's SWU reaches two thresholds: the level is counted, with no occurrences."""
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that the level is found empty while it runs, as on large tables
    rows = [(1, 1, 1, 1), (1, 2, 2, 9), (2, 1, 1, 1), (2, 2, 3, 9)]
    pos = positions(spark.createDataFrame(rows, "sid long, tid int, item int, util long"))
    found = mine(pos, theta=10.0, options=Options(eucs=True), counters=True)
    assert found.dropped == [(1, 4, 0, 0), (2, 0, 2, 0)]
    assert sorted(map(tuple, layer_counters(found).collect())) == [(1, 3, 1, 2, 0, 4, 0, 0), (2, 0, 0, 0, 0, 0, 2, 0)]
