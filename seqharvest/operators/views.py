"""One search for several views of a database at once.

A view has some of the sequences and a threshold of its own, as have the answers after batches of
new sequences.  The frontier is grown once for all views; a node is extended, and an item admitted, while any
view's bound still lets it be a pattern there.  Nodes have a column of sums a view; where a view has no
sequence of a node, they are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import cut, steps
from .mine import Search, positions, rendered


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def spans(raw: DataFrame, batches: int) -> DataFrame:
    """raw(sid, batch_id, ...) as versions of its sequences: rows of a sequence up to one of its batches, with span.

    A version is in the answers from its last batch (span div (batches + 1)) to the one before the
    sequence's next batch (span mod (batches + 1)).  Sequences that come in one batch each keep their sid;
    otherwise sid is text, and names the version, too.
    """
    raw = raw.where(F.col("batch_id") < batches).withColumn("batch_id", F.greatest("batch_id", F.lit(0)).cast("int"))
    later = F.lead("batch_id", 1, batches).over(Window.partitionBy("sid").orderBy("batch_id"))
    versions = raw.select("sid", "batch_id").distinct().select("sid", F.col("batch_id").alias("since"), later.alias("until"))
    versions = cut(versions.select("sid", "since", (F.col("since") * (batches + 1) + F.col("until")).cast("int").alias("span")))
    rows = raw.join(versions, "sid").where("batch_id <= since").drop("batch_id", "since")
    if versions.where(F.col("span") % (batches + 1) < batches).isEmpty():
        return rows
    return rows.withColumn("sid", F.concat_ws(":", F.col("sid").cast("string"), "span"))


def has(view: int, views: int) -> Column:
    """Whether a version with span is in a view."""
    return (F.floor(F.col("span") / (views + 1)) <= view) & (F.col("span") % (views + 1) > view)


class _Views(Search):
    """Search by views 0 to n - 1 of positions with span."""

    def __init__(self, pos: DataFrame, thetas: list[float]):
        self.thetas = thetas
        super().__init__(pos, 1)

    def has(self, view: int) -> Column:
        return has(view, len(self.thetas))

    def _swu(self) -> DataFrame:
        held = self.pos.select("sid", "item", "su", "span").distinct().groupBy("item", "span").agg(F.sum("su").alias("su"))
        return held.groupBy("item").agg(*[F.sum(F.when(self.has(v), F.col("su"))).alias(f"swu{v}") for v in range(len(self.thetas))])

    def reaches(self, name: str, length: int) -> Column:
        return _any([F.col(f"{name}{v}") >= F.lit(t) * length for v, t in enumerate(self.thetas)])

    def _enough(self) -> Column:
        return self.reaches("swu", self.least)  # the length, here

    def _carried(self) -> tuple[str, ...]:
        return ("span",)

    def _gathered(self, per: DataFrame) -> DataFrame:
        # few spans, so that the many sums by view are made of few rows
        return per.groupBy("parent", "inside", "item", "span").agg(F.sum("iu").alias("iu"), F.sum("reach").alias("reach"), F.count("*").alias("held"))

    def _sums(self) -> list[Column]:
        of = lambda c, name, v: F.sum(F.when(self.has(v), c)).cast("long").alias(f"{name}{v}")
        return [of(c, name, v) for v in range(len(self.thetas)) for c, name in ((F.col("iu"), "u"), (F.col("reach"), "bound"), (F.col("held"), "support"))]


def by_batch(raw: DataFrame, xi: float, batches: int) -> DataFrame:
    """Patterns after every batch of raw(batch_id, ...): each answer is over all rows so far, at xi of their utility, and all come from one search."""
    every, levels = range(batches), []
    with steps(raw.sparkSession):
        raw = raw.where("util > 0 and sid is not null and tid is not null and item is not null")
        rows = spans(cut(raw.select("sid", "batch_id", "tid", "item", "util")), batches)
        span = rows.groupBy("sid").agg(F.max("span").alias("span"))
        pos = cut(positions(rows).join(span, "sid"))
        totals = pos.agg(*[F.coalesce(F.sum(F.when(has(v, batches), F.col("util"))), F.lit(0)).cast("long") for v in every]).first()
        thetas = [xi * t for t in totals]
        search = _Views(pos, thetas)
        while True:
            n = search.length
            # others are neither patterns nor extended in any view
            nodes = search.nodes(search.reaches("u", n) | search.reaches("bound", n + 1))
            levels.append(nodes)
            open_ = nodes.where(search.reaches("bound", n + 1))
            count = open_.count()
            if not count:
                break
            search.advance(open_, count, n + 1)
    answers = F.array(*[F.struct(F.lit(v).alias("batch_id"), F.lit(thetas[v]).alias("theta"), F.col(f"u{v}").alias("utility"), F.col(f"support{v}").alias("support")) for v in every])
    found = reduce(DataFrame.unionByName, levels).select(rendered().alias("pattern"), "len", F.inline(answers)).where(F.col("utility") >= F.col("theta") * F.col("len"))
    return found.select("batch_id", "pattern", "len", "utility", (F.col("utility") / F.col("len")).cast("double").alias("avg_utility"), "support")
