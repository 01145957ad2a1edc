"""Mining against a brute-force enumeration, the worked example, batches and text files."""

import itertools
import random

import pytest

from seqharvest.operators import incremental as inc, topk
from seqharvest.operators.mine import Options, mine, positions
from seqharvest.sources import qsdb

SCHEMA = "sid long, tid int, item int, util long"


def raw_rows(db, profits):
    return [(s, t, i, q * profits[i]) for s, sequence in enumerate(db) for t, items in enumerate(sequence) for i, q in items]


def brute(rows):
    """pattern -> (utility, support), by all subsets of positions of each sequence."""
    by = {}
    for s, t, i, u in rows:
        by.setdefault(s, []).append((t, i, u))
    total = {}
    for seq in by.values():
        seq.sort()
        best = {}
        for n in range(1, len(seq) + 1):
            for pick in itertools.combinations(seq, n):
                sets = [",".join(str(i) for _, i, _ in g) for _, g in itertools.groupby(pick, lambda x: x[0])]
                name = "<(" + ")(".join(sets) + ")>"
                best[name] = max(best.get(name, (0, 0)), (sum(u for *_, u in pick), n))
        for name, (u, n) in best.items():
            a, b, _ = total.get(name, (0, 0, n))
            total[name] = (a + u, b + 1, n)
    return total


def answer(rows, xi):
    theta = xi * sum(r[3] for r in rows)
    return {(p, u, s) for p, (u, s, n) in brute(rows).items() if u >= theta * n}


def as_set(df):
    return {(r["pattern"], r["utility"], r["support"]) for r in df.collect()}


EXAMPLE_PROFITS = {1: 5, 2: 3, 3: 2, 4: 4, 5: 1, 6: 2, 7: 6, 8: 3}
EXAMPLE = [
    [[(1, 2)], [(2, 1), (3, 2)], [(4, 1), (5, 3), (6, 1)], [(7, 1)]],
    [[(2, 2)], [(1, 1), (3, 1)], [(4, 2), (6, 2)]],
    [[(1, 3), (5, 2)], [(3, 1), (6, 1)], [(7, 2)], [(8, 1)]],
    [[(1, 1)], [(2, 1), (3, 2)], [(1, 2), (4, 1)]],
    [[(7, 10)], [(5, 20), (6, 15), (8, 10)]],
]


def test_worked_example(spark):
    pos = positions(spark.createDataFrame(raw_rows(EXAMPLE, EXAMPLE_PROFITS), SCHEMA))
    found = mine(pos, 0.2)
    assert found.total == 259
    assert as_set(found.patterns()) == {("<(7)>", 78, 3), ("<(7)(8)>", 105, 2)}
    root = found.levels[0].where("pat = '1'").first()
    assert root is None or (root["u"], root["bound"]) == (40, 113)


def random_rows(seed):
    rng = random.Random(seed)
    profits = {i: rng.randint(1, 9) for i in range(1, 5)}
    db = [[[(i, rng.randint(1, 5)) for i in sorted(rng.sample(range(1, 5), rng.randint(1, 3)))] for _ in range(rng.randint(1, 4))] for _ in range(5)]
    return raw_rows(db, profits)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_databases(spark, seed):
    rows = random_rows(seed)
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    assert as_set(mine(pos, 0.1).patterns()) == answer(rows, 0.1)
    assert as_set(mine(pos, 0.1, options=Options(eucs=True)).patterns()) == answer(rows, 0.1)


def test_topk_with_ties(spark):
    rows = random_rows(5)
    every = sorted(brute(rows).items(), key=lambda x: -x[1][0] / x[1][2])
    least = every[4][1][0] / every[4][1][2]
    want = {(p, u, s) for p, (u, s, n) in every if u / n >= least}
    found, tau = topk.topk(positions(spark.createDataFrame(rows, SCHEMA)), 5)
    assert as_set(found) == want
    assert tau == pytest.approx(least)


def test_appends_equal_a_new_search(spark):
    rows = random_rows(7)
    old, batch = [r for r in rows if r[1] < 2], [r for r in rows if r[1] >= 2]
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(batch, SCHEMA)
    want = answer(rows, 0.15)
    assert as_set(mine(positions(inc.append(a, b)), 0.15).patterns()) == want
    assert as_set(mine(positions(inc.rewrite(a, b)), 0.15).patterns()) == want


def test_prelarge_utilities_are_exact(spark):
    rows = random_rows(8)
    raw = spark.createDataFrame([(*r, 0 if r[0] < 4 else 1) for r in rows], SCHEMA + ", batch_id int")
    state, log = inc.prelarge(raw, 0.2, 0.5, 2)
    truth = brute(rows)
    assert log[0]["rescan"]
    for r in state.collect():
        u, support, n = truth[f"<({r['pat']})>"]
        assert (r["u"], r["support"], r["len"]) == (u, support, n)


def test_schedules():
    assert inc.ratio_bounds(36369, [0.2] * 5, "floor")[0] == 7273
    assert inc.ratio_bounds(36369, [0.2] * 5)[0] == 7274
    assert inc.ratio_bounds(10, inc.warm_schedule(3, 0.5))[-1] == 10


def test_text_files(spark, tmp_path):
    (tmp_path / "eui.txt").write_text("# prices\n1:5\n2 , 3\n1:7\n\n")
    (tmp_path / "seq.txt").write_text("@ head\n2[2] 1[1] 1[1] -1 9 -1 -1 x[1] -2 5[1]\n\n-2\n1[1] -1 oops 2\n")
    profits = qsdb.read_profits(spark, str(tmp_path / "eui.txt"))
    assert {(r["item"], r["profit"]) for r in profits.collect()} == {(1, 7), (2, 3)}
    raw = qsdb.read_sequences(spark, str(tmp_path / "seq.txt"), profits)
    assert {tuple(r) for r in raw.select("sid", "tid", "item", "qty", "util").collect()} == {(0, 0, 1, 2, 14), (0, 0, 2, 2, 6), (0, 1, 9, 1, 1), (2, 0, 1, 1, 7), (2, 1, 2, 1, 3)}


def test_empty_database(spark):
    pos = positions(spark.createDataFrame([], SCHEMA))
    assert mine(pos, 0.1).patterns().count() == 0


def test_stream_answers_equal_a_new_search(spark, tmp_path):
    from seqharvest.streaming import feed

    rows = random_rows(9)
    last = {s: max(t for x, t, *_ in rows if x == s) for s, *_ in rows}
    parts = [[r for r in rows if r[1] < last[r[0]] or r[0] < 3], [r for r in rows if r[1] == last[r[0]] and r[0] >= 3]]
    so_far = []
    for n, part in enumerate(parts):  # the second part comes after a restart
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = feed.start(stream, 0.15, store=str(tmp_path / "store"), answers=str(tmp_path / "answers"), checkpoint=str(tmp_path / "check"))
        q.awaitTermination()
        so_far += part
        assert as_set(spark.read.parquet(str(tmp_path / "answers")).where(f"batch_id = {n}")) == answer(so_far, 0.15)
