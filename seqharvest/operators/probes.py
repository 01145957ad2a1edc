"""Probes of a database: price grids, support of given patterns, threshold choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..storage import cut
from .incremental import follow, prefixes
from .prices import priced
from .mine import Mined, dealt, grow_named, held_dealt, mine, rendered, roots, total_utility


def price_grid(raw: DataFrame, xi: float, items: list[int] | None, tenths: list[int]) -> DataFrame:
    """Status string of each pattern that is one at some price: all prices times 10, those of the items (all items, if None) times f for each f of tenths."""
    changed = F.lit(True) if items is None else F.col("item").isin(items)
    return priced(raw, xi, [F.when(changed, f).otherwise(10) for f in tenths]).select("pattern", "status")


def best_item(pos: DataFrame) -> int | None:
    """The item of the largest total utility, ties to the lowest id."""
    r = pos.groupBy("item").agg(F.sum("util").alias("t")).orderBy(F.desc("t"), "item").limit(1).collect()
    return r[0]["item"] if r else None


def support(pos: DataFrame, pattern: list[list[int]]) -> DataFrame:
    """(sid, ends): sequences that contain the pattern, with the tid at which its earliest match ends."""
    at = None
    for items in pattern:
        wanted = pos.where(F.col("item").isin(items)).groupBy("sid", "tid").agg(F.countDistinct("item").alias("n")).where(F.col("n") == len(set(items)))
        if at is not None:
            wanted = wanted.join(at, "sid").where("tid > ends")
        at = wanted.groupBy("sid").agg(F.min("tid").alias("ends"))
    return at


def support_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("len", "support").agg(F.count("*").alias("patterns"))


def threshold_sweep(pos: DataFrame, xis: list[float]) -> DataFrame:
    """(xi, patterns, longest): one search at the smallest ratio serves all, since utilities don't depend on it."""
    found = mine(pos, min(xis)).nodes()
    total = total_utility(pos)
    spark = pos.sparkSession
    grid = spark.createDataFrame([(x, x * total) for x in xis], "xi double, theta double")
    hits = found.crossJoin(F.broadcast(grid)).where(F.col("u") >= F.col("theta") * F.col("len"))
    return hits.groupBy("xi").agg(F.count("*").alias("patterns"), F.max("len").alias("longest"))


def choose_xi(pos: DataFrame, wanted: int, *, low: float, high: float, steps: int = 12) -> float:
    """A ratio in [low, high] whose number of patterns is nearest to wanted (in logarithms), by bisection."""
    from math import log, sqrt

    total = total_utility(pos)
    nodes = cut(mine(pos, low).nodes())
    count = lambda xi: nodes.where(F.col("u") >= F.lit(xi * total) * F.col("len")).count()
    best = (float("inf"), low)
    for _ in range(steps):
        mid = sqrt(low * high)
        n = count(mid)
        best = min(best, (abs(log(max(n, 0.5)) - log(wanted)), mid))
        low, high = (mid, high) if n > wanted else (low, mid)
    return best[1]


def xi_grid(pos: DataFrame, start: float, steps: int, least: int = 10) -> DataFrame:
    """(step, xi, patterns, accepted) for the ratios start * 2^(-step/2), step 0 to steps - 1; a level with ``least`` patterns is accepted."""
    grid = [(k, start * 2 ** (-k / 2)) for k in range(steps)]
    found = threshold_sweep(pos, [x for _, x in grid]).drop("longest")
    every = pos.sparkSession.createDataFrame(grid, "step int, xi double").join(F.broadcast(found), "xi", "left")
    return every.select("step", "xi", F.coalesce("patterns", F.lit(0)).alias("patterns"), (F.coalesce("patterns", F.lit(0)) >= least).alias("accepted"))


def barren(nodes: DataFrame, theta: float) -> DataFrame:
    """(len, nodes, barren, patterns): barren nodes are no prefix of any pattern."""
    hit = F.col("u") >= F.lit(theta) * F.col("len")
    ways = nodes.where(hit).select(F.explode(prefixes(F.col("pat"))).alias("pat")).distinct()
    fruitful = nodes.join(ways, "pat", "left_semi").groupBy("len").agg(F.count("*").alias("fruitful"))
    per = nodes.groupBy("len").agg(F.count("*").alias("nodes"), F.count_if(hit).alias("patterns"))
    return per.join(fruitful, "len", "left").select("len", "nodes", (F.col("nodes") - F.coalesce("fruitful", F.lit(0))).alias("barren"), "patterns")


def compare_sets(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows (side, pattern, ...) that only one of two pattern tables has."""
    only = lambda a, b, side: a.exceptAll(b).select(F.lit(side).alias("side"), "*")
    return only(one, other, "left").unionAll(only(other, one, "right"))


def holders(pos: DataFrame, names: DataFrame) -> DataFrame:
    """(pat, sid): the sequences that hold each pattern of names(pat); only prefixes of the patterns are followed."""
    known = cut(names.select("pat").distinct())
    levels = [front.select("pat", "sid").distinct().join(known, "pat", "left_semi") for _, front in follow(held_dealt(cut(pos)), known)]
    return reduce(DataFrame.unionAll, levels, known.join(pos.select("sid"), F.lit(False)))


def rare_holders(pos: DataFrame, found: Mined, most: int) -> DataFrame:
    """(sid, patterns): how many patterns with a support of at most most each sequence holds."""
    rare = found.nodes().where((F.col("u") >= F.lit(found.theta) * F.col("len")) & (F.col("support") <= most))
    return holders(pos, rare).groupBy("sid").agg(F.count("*").alias("patterns"))


def alone(pos: DataFrame, theta: float) -> DataFrame:
    """(sid, pattern, utility): patterns that a sequence supports by itself, at a threshold of the whole database.

    Utility in one sequence is its largest occurrence, so a level's nodes are
    kept by (pattern, sequence); a sequence's bound prunes its own branches only.
    """
    pos = cut(dealt(cut(pos.where(F.col("su") >= theta))))
    front = roots(pos)
    levels, n = [], 1
    while True:
        nodes = cut(front.groupBy("pat", "sid").agg(F.max("iu").alias("u"), F.max(F.col("iu") + F.col("rem")).alias("bound")))
        levels.append(nodes.where(F.col("u") >= F.lit(theta) * n).select("sid", rendered().alias("pattern"), F.col("u").alias("utility")))
        open_ = nodes.where(F.col("bound") >= F.lit(theta) * (n + 1)).select("pat", "sid")
        if open_.isEmpty():
            return reduce(DataFrame.unionAll, levels)
        front = cut(grow_named(front.join(open_, ["pat", "sid"], "left_semi"), pos))
        n += 1
