"""What the search under several price systems holds."""

import random

from pyspark.sql import functions as F

from seqharvest.operators import prices


def test_only_extended_ends_are_held(spark, monkeypatch):
    """Frontiers aren't written: what is held by sequence are positions, and ends without their remaining utility."""
    rng = random.Random(5)
    raw = [(s, t, i, rng.randint(1, 30)) for s in range(20) for t in range(3) for i in rng.sample(range(1, 5), 2)]
    held, real = [], prices.cut

    def spy(df, *keys, **more):
        if keys:
            held.append(df.columns)
        return real(df, *keys, **more)

    monkeypatch.setattr(prices, "cut", spy)
    found = prices.priced(spark.createDataFrame(raw, "sid long, tid int, item int, util long"), 0.1, [F.lit(1), F.lit(2)])
    assert found.count() > 0
    assert held[1:] and all(set(c) == {"sid", "parent", "tid", "k", "iu0", "iu1"} for c in held[1:])
