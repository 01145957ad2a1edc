"""Counters by pruning layer, and searches that a deadline ends."""

import time

import pytest

from seqharvest.operators.mine import DeadlinePassed, Options, deadline, layer_counters, mine, positions
from test_mining import SCHEMA, answer, as_set, random_rows


def test_counters_change_no_result_and_add_up(spark):
    rows = random_rows(31)
    rows += [(9, 0, 77, 1)]  # an item that the SWU drops
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    found = mine(pos, 0.1, options=Options(eucs=True), counters=True)
    plain = mine(pos, 0.1, options=Options(eucs=True))
    assert as_set(found.patterns()) == as_set(plain.patterns()) == answer(rows, 0.1)
    table = {r["len"]: r for r in layer_counters(found).collect()}
    assert sorted(table) == list(range(1, len(found.levels) + 1))
    assert table[1]["dropped_swu"] >= 1 and table[1]["occurrences"] + table[1]["dropped_swu"] == pos.count()
    for n, r in table.items():
        assert r["nodes"] == r["extended"] + r["cut"]
        assert (r["extended"] > 0) == (n < max(table))
        assert r["patterns"] == plain.patterns().where(f"len = {n}").count()
    assert not plain.dropped


def test_a_deadline_reports_where_it_stopped(spark):
    rows = random_rows(32)
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    whole = mine(pos, 0.1, seconds=600)
    assert whole.cut_at is None and as_set(whole.patterns()) == answer(rows, 0.1)
    early = mine(pos, 0.1, seconds=0)
    assert early.cut_at in (0, 1)  # the first level may be whole when the time is over
    assert as_set(early.patterns()) == {x for x in answer(rows, 0.1) if x[0].count(",") + x[0].count(")(") < early.cut_at}


def test_a_deadline_cancels_a_running_job(spark):
    start = time.monotonic()
    with pytest.raises(DeadlinePassed), deadline(spark, 1):
        spark.range(10**13).selectExpr("sum(hash(id))").collect()
    assert time.monotonic() - start < 60
    assert spark.range(3).count() == 3
