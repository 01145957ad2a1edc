"""Appends answered from stored patterns, pair sums by blocks, and long sequences dealt into shares."""

import random

import pytest

from seqharvest.operators import appends, cooccurrence as co, incremental as inc, mine as m, probes
from seqharvest.operators.mine import mine, positions
from test_mining import SCHEMA, brute, random_rows


def stored_before(spark, rows, first_new, xi):
    found = mine(positions(spark.createDataFrame([r for r in rows if r[1] < first_new], SCHEMA)), xi)
    return found.nodes().where(f"u >= {found.theta!r} * len")


@pytest.mark.parametrize("seed", [21])
@pytest.mark.parametrize("heavy", [None, 3])
def test_update_from_stored_patterns_at_any_length(spark, monkeypatch, seed, heavy):
    if heavy:  # every sequence of more than three positions has shares
        monkeypatch.setattr(m, "HEAVY", heavy)
    rows, xi = random_rows(seed), 0.07
    total = sum(r[3] for r in rows)
    want = {(p, u) for p, (u, _, n) in brute(rows).items() if u >= xi * total * n}
    got = appends.update_stored(stored_before(spark, rows, 2, xi), positions(spark.createDataFrame(rows, SCHEMA)), 2, xi)
    assert {(r["pattern"], r["utility"]) for r in got.collect()} == want
    assert max(p.count(",") + p.count(")(") + 1 for p, _ in want) >= 3


def test_update_without_a_batch_and_without_stored_patterns(spark):
    rows, xi = random_rows(23), 0.12
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    total = sum(r[3] for r in rows)
    want = {(p, u) for p, (u, _, n) in brute(rows).items() if u >= xi * total * n}
    as_pairs = lambda df: {(r["pattern"], r["utility"]) for r in df.collect()}
    assert as_pairs(appends.update_stored(stored_before(spark, rows, 99, xi), pos, 99, xi)) == want
    none = spark.createDataFrame([], "pat string, len int, u long")
    assert as_pairs(appends.update_stored(none, pos, 0, xi)) == want
    assert as_pairs(appends.update_stored(none, positions(spark.createDataFrame([], SCHEMA)), 0, xi)) == set()


def test_shares_change_no_named_frontier(spark, monkeypatch):
    rows = random_rows(24)
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    terms = lambda: {tuple(r) for r in appends.pattern_terms(pos, 2, 3).collect()}
    back = lambda: {tuple(r) for r in appends.backward(pos, 2, 0.1).collect()}
    lone = lambda: {tuple(r) for r in probes.alone(pos, 20).collect()}
    names = spark.createDataFrame([("1)(2", 2), ("1", 1), ("2,3)(1", 3)], "pat string, len int")
    gain = lambda: {tuple(r) for r in inc.delta_nodes(pos, names).collect()}
    before = terms(), back(), lone(), gain()
    monkeypatch.setattr(m, "HEAVY", 2)
    assert (terms(), back(), lone(), gain()) == before and all(before)


def pair_sums(rows):
    by, s, i = {}, {}, {}
    for sid, t, item, u in rows:
        by.setdefault(sid, {}).setdefault(t, set()).add(item)
    size = {sid: sum(r[3] for r in rows if r[0] == sid) for sid in by}
    for sid, sets in by.items():
        first = {x: min(t for t in sets if x in sets[t]) for t in sets for x in sets[t]}
        last = {x: max(t for t in sets if x in sets[t]) for t in sets for x in sets[t]}
        for a in first:
            for b in first:
                if a != b and first[a] < last[b]:
                    s[a, b] = s.get((a, b), 0) + size[sid]
                if a < b and any({a, b} <= x for x in sets.values()):
                    i[a, b] = i.get((a, b), 0) + size[sid]
    return s, i


@pytest.mark.parametrize("block", [2_000, 7])
def test_pairs_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(co, "BLOCK", block)
    rng = random.Random(5)
    rows = [(0, t, i, 1) for t in range(3) for i in rng.sample(range(60), 25)]  # long against a block of seven
    rows += [(s, t, i, rng.randint(1, 4)) for s in range(1, 9) for t in range(3) for i in rng.sample(range(12), 3)]
    s, i = pair_sums(rows)
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    table = lambda df: {(r["a"], r["b"]): r["swu"] for r in df.collect()}
    assert table(co.s_pairs(pos)) == s
    assert table(co.i_pairs(pos)) == i
