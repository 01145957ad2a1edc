"""Boundary databases, the toy database, random ones, long sequences in shares, and the pre-large state, all against brute force."""

import itertools
import random

import pytest
from test_mining import SCHEMA, answer, as_set, brute, random_rows, raw_rows

from seqharvest.operators import incremental as inc, mine as search, topk
from seqharvest.operators.mine import Options, mine, positions

# The toy database's profits and sequences, and how many patterns it has at three ratios.
TOY_PROFITS = {1: 5, 2: 3, 3: 2, 4: 4, 5: 6, 6: 1}
TOY = [
    [[(1, 1)], [(2, 2), (3, 1)]],
    [[(2, 1), (4, 2)], [(1, 2)], [(3, 1)]],
    [[(3, 2)], [(1, 3), (2, 1)], [(4, 1)]],
    [[(1, 1)], [(2, 1), (3, 2)], [(1, 2), (4, 1)]],
    [[(1, 4), (2, 3)], [(3, 5), (4, 2), (5, 2)], [(1, 3), (6, 5)]],
]
TOY_COUNTS = {0.10: 13, 0.05: 118, 0.02: 157}

@pytest.mark.parametrize("xi", sorted(TOY_COUNTS))
def test_toy_database(spark, xi):
    rows = raw_rows(TOY, TOY_PROFITS)
    found = mine(positions(spark.createDataFrame(rows, SCHEMA)), xi)
    assert found.total == 167 and found.patterns().count() == TOY_COUNTS[xi]


#: Where this engine's own steps have edges -> rows.
EDGES = {
    # names are joined from numbers: 1 then 2 must not be taken for 12, nor 11 after 1 for 1 after 11
    "numbers that run together": [(0, 0, 1, 5), (0, 1, 2, 5), (0, 2, 12, 7), (1, 0, 11, 4), (1, 1, 1, 9), (2, 0, 1, 3), (2, 0, 11, 3)],
    # positions() sums repeats and drops what has no utility before it numbers positions
    "repeats, nothing and nulls": [(0, 0, 3, 2), (0, 0, 3, 5), (0, 1, 4, 0), (0, 1, 5, -3), (0, 2, 4, 6), (None, 0, 3, 9), (1, None, 3, 9), (1, 0, None, 9), (1, 1, 4, 1)],
    # itemsets are ordered by number, items inside them too, however rows arrive
    "rows in no order": [(0, 9, 2, 4), (0, -4, 7, 3), (0, 9, 1, 8), (0, 0, 7, 2), (0, -4, 1, 6)],
    # the largest numbers that columns hold
    "large numbers": [(2**62, 2**31 - 1, 2**31 - 1, 2**40), (2**62, -(2**31), 2**31 - 1, 2**41), (-(2**62), 0, 5, 2**42)],
    # a share begins at its own first item: the last share has a single one, and items come back later
    "a sequence of many shares": [(0, t, i, 1 + (t * i) % 5) for t, i in enumerate([1, 2, 1, 3, 2, 4, 1, 5])] + [(1, 0, 5, 2)],
    # more sequences than partitions, each of one position: no frontier after the first
    "single positions": [(s, 0, s % 3, s + 1) for s in range(40)],
}


def known(rows):
    """The rows that count, repeats summed."""
    out = {}
    for s, t, i, u in rows:
        if None not in (s, t, i) and u > 0:
            out[s, t, i] = out.get((s, t, i), 0) + u
    return [(*k, u) for k, u in out.items()]


@pytest.mark.parametrize("name", EDGES)
def test_edges(spark, monkeypatch, name):
    monkeypatch.setattr(search, "HEAVY", 3)
    rows = EDGES[name]
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    assert as_set(mine(pos, 0.06).patterns()) == answer(known(rows), 0.06)


def test_a_threshold_that_is_met_exactly(spark):
    rows = [(0, 0, 1, 25), (0, 1, 2, 50), (1, 0, 3, 25)]
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    # 0.25 of 100 is a double without error: utilities of 25 and 75 / 3 reach it
    assert as_set(mine(pos, 0.25).patterns()) == {("<(1)>", 25, 1), ("<(2)>", 50, 1), ("<(3)>", 25, 1), ("<(1)(2)>", 75, 1)}


def generated(seed):
    rng = random.Random(seed)
    profits = {i: rng.randint(1, 9) for i in range(1, rng.randint(3, 6) + 1)}
    items = sorted(profits)
    db = [[[(i, rng.randint(1, 5)) for i in sorted(rng.sample(items, rng.randint(1, 3)))] for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(4, 8))]
    return raw_rows(db, profits)


@pytest.mark.parametrize(("seed", "k"), [(11, 1), (12, 2), (13, 3), (14, 8)])
def test_topk_of_random_databases(spark, seed, k):
    rows = generated(seed)
    every = sorted(brute(rows).items(), key=lambda x: -x[1][0] / x[1][2])
    least = every[min(k, len(every)) - 1][1]
    want = {(p, u, s) for p, (u, s, n) in every if u * least[2] >= least[0] * n}
    assert as_set(topk.topk(positions(spark.createDataFrame(rows, SCHEMA)), k)[0]) == want


def test_ranks_compare_exactly():
    # averages of two thirds of 10^18 that a double can't tell apart
    u = 2 * 10**17
    assert topk.ranks([(3 * u, 3, 1), (50 * u, 50, 2), (50 * u - 1, 50, 1), (u + 1, 1, 1)], 3) == [(u + 1, 1, 1), (3 * u, 3, 2), (50 * u, 50, 2)]


def test_long_sequences_in_shares(spark, monkeypatch):
    rows = generated(21)
    want = answer(rows, 0.08)
    monkeypatch.setattr(search, "HEAVY", 2)
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    assert as_set(mine(pos, 0.08).patterns()) == want
    assert as_set(mine(pos, 0.08, options=Options(eucs=True)).patterns()) == want


@pytest.mark.parametrize("cuts", [(4, 5), (5,), (3,)])
def test_prelarge_state_is_complete(spark, cuts):
    rows, xi, mu = random_rows(8), 0.2, 0.5
    dealt = [(*r, sum(r[0] >= c for c in cuts)) for r in rows]
    state, log = inc.prelarge(spark.createDataFrame(dealt, SCHEMA + ", batch_id int"), xi, mu, len(cuts) + 1)
    last = max(x["batch_id"] for x in log if x["rescan"])
    lower = xi * (1 - mu)
    scanned = [r[:4] for r in dealt if r[4] <= last]
    good = {p for p, u, s in answer(scanned, lower)}
    kept = {p for g in good for p in prefixes(g)}
    truth, theta = brute(rows), xi * sum(r[3] for r in rows)
    want = {(p, *truth[p][:2], truth[p][0] >= theta * truth[p][2]) for p in kept}
    assert {(f"<({r['pat']})>", r["u"], r["support"], r["large"]) for r in state.collect()} == want
    held, at_rescan, total = 0, None, 0
    for x in log:
        size = sum(r[3] for r in dealt if r[4] == x["batch_id"])
        total += size
        room = 0 if at_rescan is None else (xi - lower) / (1 - xi) * at_rescan
        assert x["rescan"] == (at_rescan is None or held + size > room) and x["buffer"] == held + size
        held, at_rescan = (0, total) if x["rescan"] else (held + size, at_rescan)


def prefixes(name):
    sets = [s.split(",") for s in name[2:-2].split(")(")]
    for n in range(1, len(sets) + 1):
        for m in range(1, len(sets[n - 1]) + 1):
            yield "<(" + ")(".join(map(",".join, [*sets[: n - 1], sets[n - 1][:m]])) + ")>"


def test_ranked_positions(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    values = rng.sample(range(10**6), 500) + [-(2**62), 2**62]
    got = inc.ranked(spark.createDataFrame([(v, v % 7) for v in values], "v long, w long"), F.desc("w"), F.asc("v")).collect()
    want = {v: n for n, v in enumerate(sorted(values, key=lambda v: (-(abs(v) % 7 if v >= 0 else -(abs(v) % 7) % 7), v)))}
    order = sorted(got, key=lambda r: r["number"])
    assert [r["number"] for r in order] == list(range(len(values))) and set(want) == {r["v"] for r in got}
    assert all((-a["w"], a["v"]) < (-b["w"], b["v"]) for a, b in itertools.pairwise(order))
    assert inc.ranked(spark.createDataFrame([], "v long"), "v").count() == 0
