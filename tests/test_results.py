"""Result tables, lone patterns, holders and the backward search on small data."""

import itertools

import pytest

from seqharvest.operators import appends, probes, results
from seqharvest.operators.mine import mine, positions
from test_mining import SCHEMA, brute, random_rows

RUN = "config string, arm string, trial int, value long"


def test_signed_rank_and_step_down():
    for d in ([3, -1, 2, 5], [1, 2, 3, 4, 5], [-2, 1, -4]):
        n = len(d)
        order = sorted(range(n), key=lambda i: abs(d[i]))
        rank = {i: r + 1 for r, i in enumerate(order)}
        w = sum(rank[i] for i in range(n) if d[i] > 0)
        low = min(w, n * (n + 1) // 2 - w)
        ways = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
        assert results.signed_rank(d) == pytest.approx(min(1.0, 2 * sum(x <= low for x in ways) / 2**n))
    assert results.signed_rank([]) == results.signed_rank([0, 0]) == 1.0
    assert results.step_down([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def test_audits(spark):
    runs = spark.createDataFrame([("a", "x", 1, 10), ("a", "x", 1, 20), ("a", "x", 2, 30), ("a", "y", 1, 5), ("b", "x", 1, 7)], RUN)
    seen = {(r["config"], r["arm"]): r for r in results.audit(runs, ["config", "arm"], "trial", "value", trials=2).collect()}
    assert (seen["a", "x"]["rows"], seen["a", "x"]["repeated"], seen["a", "x"]["short"]) == (3, 1, False)
    assert seen["a", "x"]["cv"] == pytest.approx(0.5) and seen["b", "x"]["short"] and seen["b", "x"]["cv"] is None
    assert [tuple(r) for r in results.holes(runs, ["config"], "arm").collect()] == [("b", "y")]
    pair = results.paired(runs, ["config"], "arm", "trial", "value", "x", "y").collect()
    assert [(r["config"], r["base"], r["other"]) for r in pair] == [("a", 30.0, 5.0)]
    assert results.audit(runs.limit(0), ["config"], "trial", "value").collect() == []


def test_metrics_sink(spark, tmp_path):
    found = mine(positions(spark.createDataFrame(random_rows(1), SCHEMA)), 0.2)
    path = str(tmp_path / "metrics")
    row = results.metrics(found, config="a", status="OK")
    results.append_metrics(row, path)
    results.append_metrics(row, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.first()["patterns"] == found.patterns().count()
    with pytest.raises(ValueError):
        results.append_metrics(row.drop("lists"), path)
    plan = spark.createDataFrame([("a",), ("b",), (None,)], "config string")
    assert {r[0] for r in results.pending(plan, back, ["config"]).collect()} == {"b", None}


def test_lone_patterns_and_holders(spark):
    rows = random_rows(4)
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    theta = 0.6 * max(r[3] for r in rows)
    want = {(s, p, u) for s in {r[0] for r in rows} for p, (u, _, n) in brute([r for r in rows if r[0] == s]).items() if u >= theta * n}
    assert {tuple(r) for r in probes.alone(pos, theta).collect()} == want
    found = mine(pos, 0.15)
    names = found.nodes().where("support <= 2")
    want = {(p[2:-2], s) for s in {r[0] for r in rows} for p in brute([r for r in rows if r[0] == s])}
    kept = {r["pat"] for r in names.collect()}
    assert {tuple(r) for r in probes.holders(pos, names).collect()} == {x for x in want if x[0] in kept}


def test_backward_search_loses_no_candidate(spark):
    rows, first, xi = random_rows(7), 2, 0.15
    batch = sum(r[3] for r in rows if r[1] >= first)
    found = {(r["pattern"], r["uhat"]) for r in appends.backward(positions(spark.createDataFrame(rows, SCHEMA)), first, xi).where("candidate").collect()}
    total = {}
    for s in {r[0] for r in rows}:
        best, seq = {}, sorted(r[1:] for r in rows if r[0] == s)
        for n in range(1, len(seq) + 1):
            for pick in itertools.combinations(seq, n):
                if pick[-1][0] >= first:
                    name = "<(" + ")(".join(",".join(str(i) for _, i, _ in g) for _, g in itertools.groupby(pick, lambda x: x[0])) + ")>"
                    best[name, n] = max(best.get((name, n), 0), sum(x[2] for x in pick))
        for key, u in best.items():
            total[key] = total.get(key, 0) + u
    assert found == {(p, u) for (p, n), u in total.items() if u > xi * n * batch and xi * n < 1}


def test_patterns_are_written_as_text(spark, tmp_path):
    from seqharvest.operators.mine import Options, mine, positions
    from seqharvest.operators.results import config
    from seqharvest.sources.qsdb import write_patterns

    rows = [(0, 0, 1, 5), (0, 1, 2, 4), (1, 0, 1, 3)]
    found = mine(positions(spark.createDataFrame(rows, "sid long, tid int, item int, util long")), 0.2).patterns()
    write_patterns(found, str(tmp_path / "out"))
    got = sorted(line for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines())
    want = sorted(f"{r['pattern']}\t{r['avg_utility']:.2f}\t{r['support']}" for r in found.collect())
    assert got == want and len(got) == 3
    assert config(Options(eucs=True), arm="a") == '{"arm": "a", "bound": true, "eucs": true, "length_swu": true, "max_len": null}'


def test_a_ratio_is_chosen_by_the_number_of_patterns(spark):
    from seqharvest.operators.mine import positions
    from seqharvest.operators.probes import choose_xi
    from test_mining import SCHEMA, answer, random_rows

    rows = random_rows(9)
    pos = positions(spark.createDataFrame(rows, SCHEMA))
    xi = choose_xi(pos, 20, low=0.08, high=0.6)
    n = len(answer(rows, xi))
    # no ratio on a fine grid comes nearer to 20, in logarithms, by more than the last step of the bisection
    grid = [len(answer(rows, 0.08 + k * 0.004)) for k in range(60)]
    nearest = min((max(x, 0.5) / 20 if x > 20 else 20 / max(x, 0.5)) for x in grid)
    assert 0.08 <= xi <= 0.6 and max(n / 20, 20 / max(n, 0.5)) <= nearest * 1.2
