"""One search under several price systems at once.

A position has a utility in each system, and so have a pattern's ends and nodes:
vectors, held as a column a system.  The frontier is extended once for all systems; a node is
extended, and an item admitted, while any system's bound still lets it be a pattern there.
Occurrences that are best differ by system, so maxima are taken column by column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import cut, release, steps
from .mine import BROADCAST_ROWS, grow, rendered

NODE = ["parent", "inside", "item"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _positions(raw: DataFrame, factors: list[Column]) -> DataFrame:
    """Like mine.positions(), with util, rem and su of each system."""
    raw = raw.where("util > 0 and sid is not null and tid is not null and item is not null")
    rows = raw.groupBy("sid", "tid", "item").agg(F.sum("util").cast("long").alias("util")).repartition("sid")
    rows = rows.select("sid", "tid", "item", *[(F.col("util") * f).cast("long").alias(f"util{p}") for p, f in enumerate(factors)])
    by_sid = Window.partitionBy("sid")
    order = by_sid.orderBy("tid", "item")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    every = range(len(factors))
    return rows.select(
        "*",
        (F.row_number().over(order) - 1).cast("int").alias("k"),
        *[F.coalesce(F.sum(f"util{p}").over(after), F.lit(0)).cast("long").alias(f"rem{p}") for p in every],
        *[F.sum(f"util{p}").over(by_sid).cast("long").alias(f"su{p}") for p in every],
    )


def priced(raw: DataFrame, xi: float, factors: list[Column], *, max_len: int | None = None) -> DataFrame:
    """(pattern, len, status, utilities): the patterns at the ratio xi of some system, each of which multiplies raw's util by a factor over 0.

    status has a character a system, 1 where the pattern is one there.  Each system has the threshold of its
    own total utility.  max_len ends the search early.
    """
    every = range(len(factors))
    parts = tuple(map(str, every))
    with steps(raw.sparkSession):
        pos = cut(_positions(raw, factors))
        totals = pos.agg(*[F.coalesce(F.sum(f"util{p}"), F.lit(0)).cast("long") for p in every]).first()
        theta = [xi * t for t in totals]
        swu = pos.select("sid", "item", *[f"su{p}" for p in every]).distinct().groupBy("item").agg(*[F.sum(f"su{p}").alias(f"swu{p}") for p in every])
        reaches = lambda name, n: _any([F.col(f"{name}{p}") >= F.lit(theta[p]) * n for p in every])
        n = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        items = pos.drop(*[f"su{p}" for p in every]).join(swu.where(reaches("swu", 1)), "item")
        items = cut(items.repartition(n, "sid"), "sid")
        # as in mine.Search: a frontier is grown for its nodes and again for the ends that are extended, which alone are held
        front = items.select("sid", F.lit(-1).cast("long").alias("parent"), F.lit(False).alias("inside"), "item", "tid", "k", *[F.col(f"util{p}").alias(f"iu{p}") for p in every], *[f"rem{p}" for p in every])
        names, levels, length, held = None, [], 1, None
        while True:
            reach = lambda p: F.max(F.col(f"iu{p}") + F.col(f"rem{p}")).alias(f"reach{p}")
            per = front.groupBy("sid", *NODE).agg(*[F.max(f"iu{p}").alias(f"iu{p}") for p in every], *[reach(p) for p in every])
            nodes = per.groupBy(*NODE).agg(*[F.sum(f"iu{p}").cast("long").alias(f"u{p}") for p in every], *[F.sum(f"reach{p}").cast("long").alias(f"bound{p}") for p in every])
            nodes = nodes.where(reaches("u", length) | reaches("bound", length + 1))  # others are neither patterns nor extended
            item = F.col("item").cast("string")
            if names is None:
                nodes = nodes.withColumn("pat", item)
            else:
                named = nodes.join(names.select(F.col("id").alias("parent"), F.col("pat").alias("start")), "parent")
                nodes = named.withColumn("pat", F.concat("start", F.when(F.col("inside"), F.lit(",")).otherwise(F.lit(")(")), item))
            nodes = cut(nodes.select(F.monotonically_increasing_id().alias("id"), *NODE, "pat", F.lit(length).alias("len"), *[f"u{p}" for p in every], *[f"bound{p}" for p in every]), outlives=True)
            levels.append(nodes)
            open_ = nodes.where(reaches("bound", length + 1))
            count = open_.count()
            if not count or length == max_len:
                break
            names = F.broadcast(open_) if count <= BROADCAST_ROWS else open_
            ends = front.join(names.select("id", *NODE), NODE).select("sid", F.col("id").alias("parent"), "tid", "k", *[f"iu{p}" for p in every])
            before, held = held, cut(ends if count <= BROADCAST_ROWS else ends.repartition(n, "sid"), "sid")
            if before is not None:
                release(before)
            length += 1
            admitted = items.where(reaches("swu", length)).drop(*[f"swu{p}" for p in every])
            front = grow(held, admitted, "sid", parts=parts, held=True)
    is_one = [F.col(f"u{p}") >= F.lit(theta[p]) * F.col("len") for p in every]
    status = F.concat(*[F.when(t, "1").otherwise("0") for t in is_one])
    found = reduce(DataFrame.unionByName, levels).where(_any(is_one))
    return found.select(rendered().alias("pattern"), "len", status.alias("status"), F.array(*[f"u{p}" for p in every]).alias("utilities"))
