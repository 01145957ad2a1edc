"""A level whose nodes are mostly held by few sequences sends lists, and grows only by items that can matter."""

import random

import pytest

from seqharvest.operators import mine as mining
from seqharvest.operators.mine import Options, Search, mine, positions
from seqharvest.storage import cut
from test_mining import answer

SCHEMA = "sid long, tid int, item int, util long"


def rows(seed, sequences=30, items=25):
    rng = random.Random(seed)
    out = [(s, t, i, rng.randint(1, 30)) for s in range(sequences) for t in range(3) for i in rng.sample(range(1, items + 1), 3)]
    # some that recur, also inside an itemset, and a sequence that repeats its items
    out += [(s, t, i, 25) for s in range(0, sequences, 4) for t, i in ((1, 100), (1, 101), (2, 102))]
    return out + [(sequences, t, i, 9) for t in range(6) for i in (100, 101)]


@pytest.mark.parametrize("eucs", [False, True])
@pytest.mark.parametrize("seed, xi", [(1, 0.02), (2, 0.05)])
def test_same_patterns(spark, monkeypatch, seed, xi, eucs):
    made, made_hits = [], Search._hits
    monkeypatch.setattr(Search, "_hits", lambda self, worth: made.append(made_hits(self, worth)) or made[-1])
    monkeypatch.setattr(mining, "ROWS", 200)
    monkeypatch.setattr(mining, "SPARSE", 1e9)
    monkeypatch.setattr(mining, "PAIRS", 300)
    data = rows(seed)
    found = mine(positions(spark.createDataFrame(data, SCHEMA)), xi, options=Options(eucs=eucs), patterns_only=True).patterns()
    assert sorted((r["pattern"], r["utility"], r["support"]) for r in found.collect()) == sorted(answer(data, xi))
    assert made


def test_fewer_rows_are_made(spark, monkeypatch):
    """Rows that a level grows are those of nodes that can matter, not all of them."""
    grown, rows_of = [], Search.front
    monkeypatch.setattr(mining, "ROWS", 20)
    monkeypatch.setattr(Search, "front", lambda self, only=None: grown.append((self.length, only is None, rows_of(self, only).count())) or rows_of(self, only))
    pos = positions(spark.createDataFrame(rows(4, 60, 200), SCHEMA))
    mine(pos, 0.02, patterns_only=True)
    few = next(n for length, whole, n in grown if length == 2 and whole)
    grown.clear()
    mine(pos, 0.02)
    assert few < 0.5 * next(n for length, whole, n in grown if length == 2 and whole)


def test_held_positions_are_not_written_again(spark, monkeypatch):
    pos, written = mining.cut(positions(spark.createDataFrame(rows(5, 8, 5), SCHEMA))), []
    monkeypatch.setattr(mining, "cut", lambda df, *keys, **how: written.append(df) or cut(df, *keys, **how))
    mine(pos, 0.2, held=True)
    assert not any(df is pos for df in written) and written
