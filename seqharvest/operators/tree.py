"""A pattern tree kept across batches of new sequences.

The tree holds, level by level, every node of the last search: its terms, its
occurrence ends, whether it was extended, and the items it was extended by.  A
batch of new sequences adds its own occurrences to stored nodes (utility, bound
and support are sums over sequences); stored sequences are searched again only
below nodes that are extended for the first time, or for items whose
sequence-weighted utility has just become high enough for a level.  Nodes whose
parent is no longer extended leave the tree.  The answer after each batch is
that of mining all sequences anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..storage import cut
from .mine import BROADCAST_ROWS, Mined, evaluate, grow_named, held_dealt, held_front, item_swu, positions, roots, total_utility


#: Where a row of a frontier comes from: the stored tree, stored sequences searched again, new sequences.
HELD, LATE, NEW = 0, 1, 2


@dataclass
class Level:
    nodes: DataFrame  # pat, len, u, bound, support
    front: DataFrame  # pat, sid, share, tid, k, iu, rem of all sequences so far, and origin in the last batch
    items: DataFrame  # the items that patterns of this length may end in
    extended: DataFrame | None = None  # pat of the nodes with children; None at the last level


def _terms(nodes: DataFrame, length: int) -> DataFrame:
    """Terms of the same node over several sets of sequences, added."""
    added = nodes.groupBy("pat").agg(F.sum("u").cast("long").alias("u"), F.sum("bound").cast("long").alias("bound"), F.sum("support").cast("long").alias("support"))
    return added.select("pat", F.lit(length).alias("len"), "u", "bound", "support")


def _below(df: DataFrame, extended: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of df whose pattern is a child of an extended node by one of the items."""
    parent = F.regexp_extract("pat", r"^(.*[0-9])(?:\)\(|,)[0-9]+$", 1)
    last = F.regexp_extract("pat", r"([0-9]+)$", 1).cast("int")
    keyed = df.withColumns({"parent": parent, "item": last})
    return keyed.join(extended.select(F.col("pat").alias("parent")), "parent", "left_semi").join(items, "item", "left_semi").select(*df.columns)


def _roots(pos: DataFrame, items: DataFrame) -> DataFrame:
    return roots(pos.join(items, "item", "left_semi"))


def _from(front: DataFrame, origin: int) -> DataFrame:
    return front.select("pat", "sid", "share", "tid", "k", "iu", "rem", F.lit(origin).alias("origin"))


class PatternTree:
    """Mining at the ratio xi after each batch: add() takes raw(sid, tid, item, util) of sequences not seen before."""

    def __init__(self, xi: float):
        self.xi, self.total = xi, 0
        self.pos: DataFrame | None = None
        self.swu: DataFrame | None = None
        self.levels: list[Level] = []

    def add(self, raw: DataFrame) -> Mined:
        """The answer over all sequences so far.  An empty batch changes nothing; a sequence that is stored already is an error."""
        fresh = cut(positions(raw))
        if self.pos is not None and not fresh.join(self.pos.select("sid").distinct(), "sid", "left_semi").isEmpty():
            raise ValueError("a batch of the tree must hold new sequences only")
        self.total += total_utility(fresh)
        theta = self.xi * self.total
        gained = item_swu(fresh)
        self.swu = cut(gained if self.swu is None else self.swu.unionByName(gained).groupBy("item").agg(F.sum("swu").cast("long").alias("swu")))
        fresh = held_dealt(fresh)
        stored = self.pos if self.pos is not None else fresh.where("false")
        admitted = lambda n: self.swu.where(F.col("swu") >= F.lit(theta) * n).select("item")

        items = admitted(1)
        held, ends = [], []
        late, new = _roots(stored, items), _roots(fresh, items)
        if self.levels:
            was, names = self.levels[0], items.select(F.col("item").cast("string").alias("pat"))
            held, ends = [was.nodes.join(names, "pat", "left_semi")], [was.front.join(names, "pat", "left_semi")]
            late = _roots(stored, items.join(was.items, "item", "left_anti"))

        out, levels, length, count = Mined(theta, self.total), [], 1, 0
        while True:
            front = _from(late, LATE).unionByName(_from(new, NEW))
            for kept in ends:
                front = front.unionByName(_from(kept, HELD))
            front = held_front(front, count)
            nodes = evaluate(front.where(F.col("origin") != HELD))
            for kept in held:
                nodes = nodes.unionByName(kept.select(*nodes.columns))
            nodes = cut(_terms(nodes, length))
            level = Level(nodes, front, items)
            levels.append(level)
            out.levels.append(nodes)
            open_ = nodes.where(F.col("bound") >= F.lit(theta) * (length + 1)).select("pat")
            count = open_.count()
            if not count:
                break
            level.extended = open_
            named = F.broadcast(open_) if count <= BROADCAST_ROWS else open_
            known = self.levels[length - 1].extended if len(self.levels) > length else None
            length += 1
            items = admitted(length)
            old = front.where(F.col("origin") != NEW)
            if known is None:
                held, ends = [], []
                late = grow_named(old.join(named, "pat", "left_semi"), stored.join(items, "item", "left_semi"), held=True)
            else:
                was = self.levels[length - 1]
                held, ends = [_below(was.nodes, open_, items)], [_below(was.front, open_, items)]
                first_time, again = open_.join(known, "pat", "left_anti"), open_.join(known, "pat", "left_semi")
                late = grow_named(old.join(first_time, "pat", "left_semi"), stored.join(items, "item", "left_semi"), held=True).unionByName(
                    grow_named(old.join(again, "pat", "left_semi"), stored.join(items.join(was.items, "item", "left_anti"), "item", "left_semi"), held=True)
                )
            new = grow_named(front.where(F.col("origin") == NEW).join(named, "pat", "left_semi"), fresh.join(items, "item", "left_semi"), held=True)
        self.levels = levels
        self.pos = cut(stored.unionByName(fresh), "sid", "share") if self.pos is not None else fresh
        return out
