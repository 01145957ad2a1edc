"""Top-k patterns by average utility, ties at the k-th included."""

from __future__ import annotations

from fractions import Fraction
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from ..storage import cut, steps
from .mine import Mined, Options, Search, rendered, total_utility

SLACK = 1 - 1e-12


def _kth(nodes: DataFrame, k: int) -> float:
    """The k-th largest average so far (0 while there are fewer)."""
    rows = nodes.select((F.col("u") / F.col("len")).alias("a")).orderBy(F.desc("a")).limit(k).collect()
    return rows[-1][0] if len(rows) == k else 0.0


def ranks(pairs: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """(u, len, rank) of the (u, len, number of nodes) that rank among the first k by u / len, compared as exact fractions."""
    out, before = [], 0
    for average, group in groupby(sorted(pairs, key=lambda p: -Fraction(p[0], p[1])), key=lambda p: Fraction(p[0], p[1])):
        group = list(group)
        if before >= k:
            break
        out += [(u, n, before + 1) for u, n, _ in group]
        before += sum(c for *_, c in group)
    return out


def topk(pos: DataFrame, k: int, *, start: float = 0.0, options: Options | None = None) -> tuple[DataFrame, float]:
    """(pattern, len, utility, avg_utility, support, rank), and the k-th average, with which a later batch may start.

    The threshold rises after every level to the k-th average of all nodes so
    far; start must not exceed the k-th average of this database.
    """
    options = options or Options()
    spark = pos.sparkSession
    with steps(spark):
        pos = cut(pos)
        search, out = Search(pos, 0.0), Mined(0.0, total_utility(pos))
        tau, best = start, None
        while True:
            nodes = search.nodes()
            out.levels.append(nodes.select("pat", "len", "u", "bound", "support"))
            length = search.length
            top = out.levels[-1].orderBy(F.desc("u")).limit(k)
            best = cut((top if best is None else best.unionByName(top)).orderBy(F.desc(F.col("u") / F.col("len"))).limit(k))
            tau = max(tau, _kth(best, k))
            open_ = nodes.where(F.col("bound") >= F.lit(tau * SLACK) * (length + 1))
            count = open_.count()
            if not count or options.max_len == length:
                out.cut_at = length if count else None
                break
            search.advance(open_, count, tau * SLACK * (length + 1))
    # only nodes that can tie with the k-th are ranked: a bounded number of averages but for ties of different length
    close = out.nodes().where(F.col("u") >= F.lit(tau * SLACK) * F.col("len"))
    found = [(r["u"], r["len"], r["n"]) for r in close.groupBy("u", "len").agg(F.count("*").alias("n")).collect()]
    ranked = spark.createDataFrame(ranks(found, k), "u long, len int, rank int")
    shown = close.join(F.broadcast(ranked), ["u", "len"])
    return shown.select(rendered().alias("pattern"), "len", F.col("u").alias("utility"), (F.col("u") / F.col("len")).alias("avg_utility"), "support", "rank"), tau
