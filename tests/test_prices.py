"""Several price systems in one search, against an enumeration in each."""

import pytest
from pyspark.sql import functions as F

from seqharvest.operators import probes
from seqharvest.operators.prices import priced
from test_mining import SCHEMA, answer, brute, random_rows


@pytest.mark.parametrize("items", [[3], [1, 4], None])
def test_status_at_every_price(spark, items):
    rows, xi, tenths = random_rows(7), 0.12, [2, 10, 40]
    want = {}
    for place, f in enumerate(tenths):
        scaled = [(s, t, i, u * (f if items is None or i in items else 10)) for s, t, i, u in rows]
        for p, *_ in answer(scaled, xi):
            want.setdefault(p, ["0"] * len(tenths))[place] = "1"
    got = probes.price_grid(spark.createDataFrame(rows, SCHEMA), xi, items, tenths).collect()
    assert {r["pattern"]: r["status"] for r in got} == {p: "".join(s) for p, s in want.items()} and len(got) == len(want)
    if items:
        assert len({r["status"] for r in got}) > 1


def test_utilities_are_those_of_each_system(spark):
    rows = random_rows(9)
    found = priced(spark.createDataFrame(rows, SCHEMA), 0.15, [F.lit(1), F.col("item") + 1]).collect()
    one, other = brute(rows), brute([(s, t, i, u * (i + 1)) for s, t, i, u in rows])
    assert found and all(r["utilities"] == [one[r["pattern"]][0], other[r["pattern"]][0]] and r["len"] == one[r["pattern"]][2] for r in found)


def test_nothing_to_price(spark):
    assert priced(spark.createDataFrame([], SCHEMA), 0.1, [F.lit(1), F.lit(2)]).collect() == []
    assert priced(spark.createDataFrame([(1, 0, 1, 0), (None, 0, 1, 5)], SCHEMA), 0.1, [F.lit(1)]).collect() == []
