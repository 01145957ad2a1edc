"""The kept pattern tree against mining anew after every batch."""

import random

import pytest

from seqharvest.operators.mine import mine, positions
from seqharvest.operators.tree import PatternTree
from test_mining import SCHEMA, answer, as_set, random_rows


def test_tree_equals_mining_anew(spark):
    rows = random_rows(5)
    rng = random.Random(3)
    batch_of = {s: b for b, s in enumerate(rng.sample(sorted({r[0] for r in rows}), 3))}
    tree = PatternTree(0.12)
    for b in range(3):
        new = [r for r in rows if batch_of.get(r[0], 2) == b]
        so_far = [r for r in rows if batch_of.get(r[0], 2) <= b]
        assert as_set(tree.add(spark.createDataFrame(new, SCHEMA)).patterns()) == answer(so_far, 0.12)


def test_empty_batch_and_known_sequences(spark):
    rows = random_rows(6)
    tree = PatternTree(0.2)
    assert as_set(tree.add(spark.createDataFrame([], SCHEMA)).patterns()) == set()
    first = as_set(tree.add(spark.createDataFrame(rows, SCHEMA)).patterns())
    assert first == answer(rows, 0.2)
    assert as_set(tree.add(spark.createDataFrame([], SCHEMA)).patterns()) == first
    with pytest.raises(ValueError):
        tree.add(spark.createDataFrame(rows[:1], SCHEMA))
