"""The maintained search against mining anew: appends, new sequences, odd batches, restarts."""

import random

import pytest

from seqharvest.operators import maintained
from seqharvest.operators.maintained import Maintained
from test_mining import SCHEMA, answer, as_set, random_rows


def in_batches(seed, batches=3):
    """Rows of each batch, and all rows so far with itemsets numbered as they arrive: parts of stored sequences, and new sequences."""
    rng = random.Random(seed)
    rows = random_rows(seed)
    sets = sorted({(r[0], r[1]) for r in rows})
    last, when = {}, {}
    for sid, tid in sets:  # a sequence's itemsets arrive in their order
        last[sid] = max(last.get(sid, 0), rng.choice([0, 0, 1, 2]))
        when[sid, tid] = last[sid]
    for b in range(batches):
        yield [r for r in rows if when[r[0], r[1]] == b], [r for r in rows if when[r[0], r[1]] <= b]


@pytest.mark.parametrize("seed,margin", [(5, 0.1), (6, 0.0)])
def test_appends_equal_mining_anew(spark, tmp_path, seed, margin):
    from seqharvest.operators.mine import mine, positions

    kept = Maintained(spark, str(tmp_path), 0.1, margin=margin, buckets=4)
    for new, so_far in in_batches(seed):
        found = kept.add(spark.createDataFrame(new, SCHEMA))
        assert as_set(found.patterns()) == answer(so_far, 0.1)
    want = {r["pat"]: (r["u"], r["bound"], r["support"]) for r in mine(positions(spark.createDataFrame(so_far, SCHEMA)), 0.1).nodes().collect()}
    got = {r["pat"]: (r["u"], r["bound"], r["support"]) for r in found.nodes().collect()}
    assert set(want) <= set(got) and all(got[p] == want[p] for p in want)


def test_restart_empty_batch_and_repeats(spark, tmp_path, monkeypatch):
    batches = list(in_batches(9))
    kept = Maintained(spark, str(tmp_path), 0.15, buckets=4)
    assert as_set(kept.add(spark.createDataFrame([], SCHEMA)).patterns()) == set()
    kept.add(spark.createDataFrame(batches[0][0], SCHEMA))
    # a batch that breaks off leaves nothing behind
    monkeypatch.setattr(Maintained, "_items", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.add(spark.createDataFrame(batches[1][0], SCHEMA))
    monkeypatch.undo()
    again = Maintained(spark, str(tmp_path), 0.15)
    assert again.version == 1 and as_set(again.answer().patterns()) == answer(batches[0][1], 0.15)
    assert as_set(again.add(spark.createDataFrame(batches[1][0], SCHEMA), 2).patterns()) == answer(batches[1][1], 0.15)
    assert as_set(again.add(spark.createDataFrame(batches[1][0], SCHEMA), 2).patterns()) == answer(batches[1][1], 0.15)
    assert as_set(again.add(spark.createDataFrame([], SCHEMA)).patterns()) == answer(batches[1][1], 0.15)
    with pytest.raises(ValueError):
        again.add(spark.createDataFrame([], SCHEMA), 9)
    with pytest.raises(ValueError):
        Maintained(spark, str(tmp_path), 0.2, buckets=4)


def test_a_batch_reads_what_it_touches(spark, tmp_path):
    rng = random.Random(4)
    base = [(s, t, rng.randint(1, 6), rng.randint(1, 9)) for s in range(300) for t in range(4)]
    kept = Maintained(spark, str(tmp_path), 0.05, margin=0.15, buckets=32, audit=True)
    kept.add(spark.createDataFrame(base, SCHEMA))
    so_far = base
    for b in range(3):
        new = [(s, 4 + b, rng.randint(1, 6), rng.randint(1, 9)) for s in range(3 * b, 3 * b + 3)]
        so_far = so_far + new
        assert as_set(kept.add(spark.createDataFrame(new, SCHEMA)).patterns()) == answer(so_far, 0.05)
    assert kept.read_rows[3] * 3 < kept.stored_rows[3], (kept.read_rows, kept.stored_rows)
    # new sequences only: nothing but sequences' marks is read
    kept.add(spark.createDataFrame([(s, 0, rng.randint(1, 6), 5) for s in range(900, 910)], SCHEMA))
    assert kept.read_rows[4] * 10 < kept.stored_rows[4], (kept.read_rows, kept.stored_rows)


def test_shuffled_parents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintained, "BROADCAST_ROWS", 0)
    kept = Maintained(spark, str(tmp_path), 0.15, buckets=2)
    for new, so_far in in_batches(12, 2):
        assert as_set(kept.add(spark.createDataFrame(new, SCHEMA)).patterns()) == answer(so_far, 0.15)
