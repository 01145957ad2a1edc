"""What an append batch may change: anchored utilities, candidates, the update formula.

pos holds the database after the batch; positions with tid >= first_new are new
(anchored).  For a pattern and a sequence, u is the largest utility of the
occurrences that end before, uhat of those that end at a new position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import cut
from .incremental import follow
from .mine import grow_named, held_dealt, held_front, item_swu, kept, rendered, roots


def _anchored(front: DataFrame, first_new: int) -> DataFrame:
    """(pat, sid, u, uhat) of a frontier."""
    best = lambda rows: F.coalesce(F.max(F.when(rows, F.col("iu"))), F.lit(0))
    new = F.col("tid") >= first_new
    return front.groupBy("pat", "sid", "share").agg(best(~new).alias("u"), best(new).alias("uhat")).select("pat", "sid", "u", "uhat")


def anchored(pos: DataFrame, first_new: int, longest: int) -> DataFrame:
    """(pat, len, sid, u, uhat), zero where there is no such occurrence, of all patterns up to a length."""
    pos = held_dealt(pos)
    front = roots(pos)
    levels = []
    for n in range(1, longest + 1):
        levels.append(_anchored(front, first_new).withColumn("len", F.lit(n)).select("pat", "len", "sid", "u", "uhat"))
        if n < longest:
            front = grow_named(front, pos, held=True)
            if n + 1 < longest:  # the last level is read once
                front = cut(front, "sid", "share")
    return reduce(DataFrame.unionByName, levels)


def totals(pos: DataFrame, first_new: int) -> tuple[int, int]:
    """Utility before the batch, and of the batch."""
    r = pos.agg(F.coalesce(F.sum(F.when(F.col("tid") < first_new, F.col("util"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("tid") >= first_new, F.col("util"))), F.lit(0))).first()
    return int(r[0]), int(r[1])


def pattern_terms(pos: DataFrame, first_new: int, longest: int) -> DataFrame:
    """(pat, len, u_old, u_new, uhat, du) summed over sequences."""
    per = anchored(pos, first_new, longest)
    return per.groupBy("pat", "len").agg(
        F.sum("u").cast("long").alias("u_old"),
        F.sum(F.greatest("u", "uhat")).cast("long").alias("u_new"),
        F.sum("uhat").cast("long").alias("uhat"),
        F.sum(F.greatest(F.lit(0), F.col("uhat") - F.col("u"))).cast("long").alias("du"),
    )


def counts(pos: DataFrame, first_new: int, xi: float, length: int) -> DataFrame:
    """One row: c_uhat, c_du, c_C, h, p at a length, and the same for patterns whose items reach length * theta'."""
    pos = cut(pos, "sid")
    before, batch = totals(pos, first_new)
    theta, theta_new, limit = xi * before, xi * before + xi * batch, xi * batch * length
    good = item_swu(pos).where(F.col("swu") >= theta_new * length).select(F.col("item").cast("string").alias("item"))
    terms = pattern_terms(pos, first_new, length).where(F.col("len") == length)
    bad = terms.select("pat", F.explode(F.regexp_extract_all("pat", F.lit("[0-9]+"), F.lit(0))).alias("item")).join(good, "item", "left_anti").select("pat").distinct().withColumn("bad", F.lit(True))
    rows = terms.join(bad, "pat", "left")
    is_old, is_new = F.col("u_old") >= theta * length, F.col("u_new") >= theta_new * length
    tests = {"c_uhat": F.col("uhat") > limit, "c_du": F.col("du") > limit, "c_new": (F.col("du") > limit) & ~is_old, "h": is_new, "p": is_new & ~is_old}
    number = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    return rows.agg(*[number(t).alias(n) for n, t in tests.items()], *[number(t & F.col("bad").isNull()).alias(f"{n}_swu") for n, t in tests.items() if n.startswith("c_")])


def update(pos: DataFrame, first_new: int, xi: float, longest: int) -> DataFrame:
    """Patterns after the batch, up to a length, by the update formula: kept ones, candidates whose gain is large enough, and degenerate ones."""
    pos = cut(pos, "sid")
    before, batch = totals(pos, first_new)
    theta, theta_new = xi * before, xi * before + xi * batch
    n = F.col("len")
    reach = F.col("u_old") + F.col("du") >= theta_new * n
    old = F.col("u_old") >= theta * n
    candidate = ~old & (F.col("du") > xi * batch * n) & (xi * n < 1)
    degenerate = ~old & (xi * n >= 1)
    terms = pattern_terms(pos, first_new, longest)
    return terms.where(reach & (old | candidate | degenerate)).select(rendered().alias("pattern"), "len", F.col("u_new").alias("utility"))


def update_stored(stored: DataFrame, pos: DataFrame, first_new: int, xi: float) -> DataFrame:
    """(pattern, len, utility) after the batch, of any length, from the patterns stored(pat, len, u) before it, all of them.

    A pattern that was none before gains more than xi * len of the batch's utility, and so is a candidate of the
    backward search.  Gains are read from touched sequences only, along the prefixes of stored patterns and candidates;
    other sequences are read only for candidates that gain enough and aren't stored.  No pattern has xi * len > 1.
    """
    pos = cut(pos, "sid")
    before, batch = totals(pos, first_new)
    theta_new, limit = xi * before + xi * batch, xi * batch
    stored = cut(stored.select("pat", F.col("len").cast("int").alias("len"), F.col("u").cast("long").alias("u")))
    found = backward(pos, first_new, xi).where("candidate").select(F.regexp_replace("pattern", r"^<\(|\)>$", "").alias("pat"), "len")
    names = cut(stored.select("pat", "len").unionByName(found).distinct())

    def sums(rows: DataFrame, over: DataFrame, term: Column, name: str) -> DataFrame:
        levels = [_anchored(front, first_new).groupBy("pat").agg(F.sum(term).cast("long").alias(name)) for _, front in follow(over, rows)]
        none = rows.where("false").select("pat", F.lit(0).cast("long").alias(name))
        return rows.join(reduce(DataFrame.unionByName, levels, none), "pat", "left").withColumn(name, F.coalesce(name, F.lit(0)))

    touched = pos.where(F.col("tid") >= first_new).select("sid").distinct()
    here = held_dealt(cut(pos.join(touched, "sid", "left_semi"), "sid"))
    gains = cut(sums(names, here, F.greatest(F.lit(0), F.col("uhat") - F.col("u")), "du"))
    fresh = cut(gains.join(stored, "pat", "left_anti").where(F.col("du") >= F.lit(limit * (1 - 1e-12)) * F.col("len")).select("pat", "len"))
    known = stored
    if not fresh.isEmpty():
        known = stored.unionByName(sums(fresh, held_dealt(cut(pos.where(F.col("tid") < first_new), "sid")), F.col("u"), "u"))
    after = known.join(gains.select("pat", "du"), "pat").select("pat", "len", (F.col("u") + F.col("du")).alias("u"))
    return after.where(F.col("u") >= F.lit(theta_new) * F.col("len")).select(rendered().alias("pattern"), "len", F.col("u").alias("utility"))


def anchored_bound(pos: DataFrame, first_new: int) -> DataFrame:
    """(item, bound2): twice the sum over sequences of max over new positions of min((u + before) / 2, max(u, largest before)); whole numbers."""
    ahead = Window.partitionBy("sid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    seen = pos.withColumn("most", F.coalesce(F.max("util").over(ahead), F.lit(0))).where(F.col("tid") >= first_new)
    each = seen.select("sid", "item", F.least(F.col("util") + F.col("pre"), 2 * F.greatest("util", "most")).alias("b"))
    return each.groupBy("sid", "item").agg(F.max("b").alias("b")).groupBy("item").agg(F.sum("b").cast("long").alias("bound2"))


def anchored3(pos: DataFrame, first_new: int) -> DataFrame:
    """One row: distinct patterns of length 3 with an anchored occurrence, over sequences, and the bound n_new * C(n - 1, 2)."""
    pos = cut(pos, "sid")
    found = anchored(pos, first_new, 3).where("len = 3 and uhat > 0").agg(F.count("*").alias("anchored3"))
    per = pos.groupBy("sid").agg(F.count("*").alias("n"), F.sum(F.when(F.col("tid") >= first_new, 1).otherwise(0)).alias("a")).where("a > 0")
    bound = per.agg(F.sum(F.expr("a * ((n - 1) * (n - 2) div 2)")).cast("long").alias("bound3"))
    return found.crossJoin(bound)


def backward(pos: DataFrame, first_new: int, xi: float, longest: int | None = None) -> DataFrame:
    """(pattern, len, uhat, bound, candidate, extended): the nodes of the search that grows anchored patterns at their front.

    Positions are mirrored, so that putting an item before a pattern is the
    extension of mining; the search starts from the new positions.  bound is
    len * (len + 1) times the sum over sequences of the largest of
    min((iu + before) / (len + 1), max(iu / len, largest before)), a whole
    number.  A candidate's uhat exceeds xi * len of the batch's utility; no
    candidate is lost below a node that isn't extended.  longest ends the search.
    """
    pos = cut(pos, "sid")
    _, batch = totals(pos, first_new)
    limit = xi * batch
    touched = pos.where(F.col("tid") >= first_new).select("sid").distinct()
    ahead = Window.partitionBy("sid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    here = pos.join(touched, "sid", "left_semi").withColumn("most", F.coalesce(F.max("util").over(ahead), F.lit(0)))
    mirrored = here.select("sid", (-F.col("tid")).alias("tid"), (-F.col("k")).alias("k"), "item", "util", F.col("pre").alias("rem"), "most")
    mirrored = held_dealt(cut(mirrored, "sid"))
    front = roots(mirrored.where(F.col("tid") <= -first_new), "most")
    levels, n = [], 1
    while True:
        iu, before, most = F.col("iu"), F.col("rem"), F.col("most")
        each = F.least(n * (iu + before), F.greatest((n + 1) * iu, n * (n + 1) * most))
        per = front.groupBy("pat", "sid", "share").agg(F.max(iu).alias("uhat"), F.max(each).alias("b"))
        nodes = per.groupBy("pat").agg(F.sum("uhat").cast("long").alias("uhat"), F.sum("b").cast("long").alias("bound"))
        goes_on = (F.col("bound") > F.lit(limit) * (n * (n + 1))) & F.lit(xi * (n + 1) < 1)
        nodes = cut(nodes.select("pat", F.lit(n).alias("len"), "uhat", "bound", (F.col("uhat") > F.lit(limit) * n).alias("candidate"), goes_on.alias("extended")))
        levels.append(nodes)
        count = nodes.where("extended").count()
        if not count or n == longest:
            break
        # as in mine.Search: only the ends of extended nodes are held
        ends = held_front(kept(front, nodes.where("extended"), count), count)
        front = grow_named(ends, mirrored, "most", held=True)
        n += 1
    sets = F.transform(F.split("pat", r"\)\("), lambda x: F.array_join(F.reverse(F.split(x, ",")), ","))
    return reduce(DataFrame.unionByName, levels).select(rendered(F.array_join(F.reverse(sets), ")(")).alias("pattern"), "len", "uhat", "bound", "candidate", "extended")
