"""Level-wise mining of high-average-utility sequential patterns.

A frontier row is an occurrence end of a pattern in a sequence: iu is the largest
utility of the occurrences that end at position k, rem the utility after k.  A
pattern is known by the number of its parent, the new item, and whether that item stands inside the
parent's last itemset; its name is made once, with its node.  Positions and the ends that are extended are
bucketed by (sid, share): growing a frontier, the windows over it and the first half of the
evaluation need no shuffle; only one row per pattern and partition is shuffled.
A sequence of more than ``HEAVY`` positions has several shares, each with the patterns that
begin with some of its items, so that no task has to do a long sequence alone; items are dealt in order of their
first position, and a share has no position before its own first item.

Pruning is by filters: an item extends a pattern of length L only if its
sequence-weighted utility reaches theta * (L + 1), and a pattern is extended
only if its bound does.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from math import ceil
from threading import Timer
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..storage import cut, release, steps

#: Rows up to which a table of pattern names is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000
#: Positions of a sequence for each share, and the most shares that a sequence has.
HEAVY, SHARES = 2_000, 64
#: Rows that a task grows a frontier by, as estimated, so that it is sorted and summed in memory; frontiers that make more lie in more buckets.
ROWS = 2_000_000
#: A level is sparse if it makes fewer rows than this for each node that it could have; and the most pairs that a task sums to find which of them can matter.
SPARSE, PAIRS = 1.0, 4_000_000


def positions(raw: DataFrame) -> DataFrame:
    """raw(sid, tid, item, util), repeats summed -> pos with k, pre, su, rem; rows with util <= 0 or nulls go."""
    raw = raw.where("util > 0 and sid is not null and tid is not null and item is not null")
    rows = raw.groupBy("sid", "tid", "item").agg(F.sum("util").cast("long").alias("util")).repartition("sid")
    by_sid = Window.partitionBy("sid")
    order = by_sid.orderBy("tid", "item")
    return rows.select(
        "sid",
        "tid",
        (F.row_number().over(order) - 1).cast("int").alias("k"),
        "item",
        "util",
        F.coalesce(F.sum("util").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("pre"),
        F.sum("util").over(by_sid).cast("long").alias("su"),
    ).withColumn("rem", F.col("su") - F.col("pre") - F.col("util"))


def item_swu(pos: DataFrame) -> DataFrame:
    return pos.select("sid", "item", "su").distinct().groupBy("item").agg(F.sum("su").cast("long").alias("swu"))


def total_utility(pos: DataFrame) -> int:
    return int(pos.agg(F.coalesce(F.sum("util"), F.lit(0)).cast("long")).first()[0])


def evaluate(front: DataFrame) -> DataFrame:
    """u, bound and support of each pattern."""
    keys = [c for c in ("pat", "sid", "share") if c in front.columns]
    per = front.groupBy(*keys).agg(F.max("iu").alias("iu"), F.max(F.col("iu") + F.col("rem")).alias("reach"))
    return per.groupBy("pat").agg(F.sum("iu").cast("long").alias("u"), F.sum("reach").cast("long").alias("bound"), F.count("*").alias("support"))


@dataclass
class Options:
    """Switches that change work, never results; max_len ends the search and must be reported."""

    eucs: bool = False
    length_swu: bool = True
    bound: bool = True
    max_len: int | None = None

    def __post_init__(self):
        if not self.bound and self.max_len is None:
            raise ValueError("a search without the bound needs max_len")


@dataclass
class Mined:
    theta: float
    total: int
    levels: list[DataFrame] = field(default_factory=list)  # nodes(pat, len, u, bound, support)
    cut_at: int | None = None  # the last whole level, if max_len or the deadline ended the search
    dropped: list[tuple[int, int, int, int]] = field(default_factory=list)  # by level: len, occurrences kept, dropped by SWU, dropped by the pair filter

    def nodes(self) -> DataFrame:
        out = self.levels[0]
        for more in self.levels[1:]:
            out = out.unionByName(more)
        return out

    def patterns(self) -> DataFrame:
        return patterns(self.nodes(), self.theta)


def rendered(pat: str | Column = "pat") -> Column:
    return F.concat(F.lit("<("), F.col(pat) if isinstance(pat, str) else pat, F.lit(")>"))


def patterns(nodes: DataFrame, theta: float) -> DataFrame:
    """The nodes that are patterns: u >= theta * len."""
    return nodes.where(F.col("u") >= F.lit(theta) * F.col("len")).select(
        rendered().alias("pattern"), "len", F.col("u").alias("utility"), (F.col("u") / F.col("len")).cast("double").alias("avg_utility"), "support"
    )


def grow(ends: DataFrame, items: DataFrame, *keys: str, parts: tuple[str, ...] = ("",), held: bool = False, hits: DataFrame | None = None) -> DataFrame:
    """All one-item extensions of occurrence ends (keys, parent, tid, k, iu) by later positions (keys, tid, k, item, util, ...) of the same keys.

    Rows: the positions' columns, and parent, inside, iu.  parts: endings of the columns iu and util, if there are several of both.
    held: both lie in the same buckets of the keys; else they are dealt out by them once, and what grows lies so.
    hits: (keys, parent, first, found) in the same buckets, if parents are extended only by some items, found, after position first.
    """
    if not held:
        n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ends, items = ends.repartition(n, *keys), items.repartition(n, *keys)
    if hits is None:
        first = ends.groupBy(*keys, "parent").agg(F.min("k").alias("first"))
        later = first.join(items, list(keys)).where("k > first")
    else:
        later = hits.join(items, list(keys)).where((F.col("k") > F.col("first")) & F.array_contains("found", F.col("item"))).drop("found")
    more = [c for c in items.columns if c not in (*keys, "tid", "k", "item")]
    sums = [f"iu{p}" for p in parts]
    # a union keeps its sides' partitioning only if its keys are columns of its own: under their old names they would be shuffled for each window
    own = [f"of_{c}" for c in keys]
    named = [F.col(c).alias(o) for c, o in zip(keys, own)]
    both = later.select(*named, "parent", "tid", "k", "item", *more, *[F.lit(None).cast("long").alias(c) for c in sums]).unionAll(
        ends.select(*named, "parent", "tid", "k", F.lit(None).cast("int").alias("item"), *[F.lit(None).cast(items.schema[c].dataType).alias(c) for c in more], *sums)
    )
    # running maxima give each position its best parent: over earlier positions of its itemset, and over earlier itemsets; one sort serves both
    within = Window.partitionBy(*own, "parent", "tid").orderBy("k").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*own, "parent").orderBy(F.col("tid").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    best = both.select("*", *[F.max(f"iu{p}").over(within).alias(f"i_best{p}") for p in parts])
    best = best.select("*", *[F.max(f"iu{p}").over(before).alias(f"s_best{p}") for p in parts]).where("item is not null")

    def child(inside: bool) -> Column:
        top = lambda p: F.col(f"{'i' if inside else 's'}_best{p}")
        return F.when(top(parts[0]).isNotNull(), F.struct(F.lit(inside).alias("inside"), *[(top(p) + F.col(f"util{p}")).alias(f"iu{p}") for p in parts]))

    children = F.filter(F.array(child(False), child(True)), lambda x: x.isNotNull())
    return best.select(*[F.col(o).alias(c) for c, o in zip(keys, own)], "parent", "tid", "k", "item", *more, F.inline(children))


def held_dealt(pos: DataFrame) -> DataFrame:
    """pos dealt, held in buckets of (sid, share)."""
    n = int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(dealt(pos).repartition(n, "sid", "share"), "sid", "share")


def held_front(front: DataFrame, count: int) -> DataFrame:
    """A frontier of named patterns held in the buckets of its positions; count: the names that it was joined with."""
    n = int(front.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # after joins with names that are broadcast, rows lie in the buckets already
    return cut(front if count <= BROADCAST_ROWS else front.repartition(n, "sid", "share"), "sid", "share")


def roots(pos: DataFrame, *more: str) -> DataFrame:
    """The frontier of single items in dealt positions; more: further columns of the positions."""
    return pos.where("own").select(F.col("item").cast("string").alias("pat"), "sid", "share", "tid", "k", F.col("util").alias("iu"), "rem", *more)


def grow_named(front: DataFrame, pos: DataFrame, *more: str, held: bool = False) -> DataFrame:
    """grow() for a frontier (pat, sid, share, tid, k, iu) of named patterns and dealt positions pos; more: further columns of pos; held: as in grow()."""
    ends = front.select("sid", "share", F.col("pat").alias("parent"), "tid", "k", "iu")
    grown = grow(ends, pos.select("sid", "share", "tid", "k", "item", "util", "rem", *more), "sid", "share", held=held)
    name = F.concat("parent", F.when(F.col("inside"), F.lit(",")).otherwise(F.lit(")(")), F.col("item").cast("string"))
    return grown.select(name.alias("pat"), "sid", "share", "tid", "k", "iu", "rem", *more)


def kept(front: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    names = nodes.select("pat")
    return front.join(F.broadcast(names) if count <= BROADCAST_ROWS else names, "pat", "left_semi")


def dealt(pos: DataFrame) -> DataFrame:
    """pos (read more than once) by share, with own: whether the share has the patterns that begin with the item."""
    heavy = pos.groupBy("sid").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items")).where(F.col("n") > HEAVY)
    shares = F.least(F.lit(SHARES), F.ceil(F.col("n") / HEAVY), F.col("items")).cast("int").alias("shares")
    heavy = heavy.select("sid", shares, "items")
    light = pos.withColumns({"share": F.lit(0), "own": F.lit(True)})
    if heavy.isEmpty():
        return light
    heavy = cut(heavy)
    long = pos.join(heavy, "sid")
    first = long.groupBy("sid", "item", "shares", "items").agg(F.min("k").alias("k"))
    turn = F.row_number().over(Window.partitionBy("sid").orderBy("k")) - 1
    own = cut(first.select("sid", "item", "k", F.floor(turn * F.col("shares") / F.col("items")).cast("int").alias("own_share")))
    begins = own.groupBy("sid", F.col("own_share").alias("share")).agg(F.min("k").alias("begin"))
    parts = long.join(begins, "sid").where("k >= begin").join(own.select("sid", "item", "own_share"), ["sid", "item"])
    parts = parts.select(*pos.columns, "share", (F.col("share") == F.col("own_share")).alias("own"))
    return light.join(heavy, "sid", "left_anti").unionByName(parts)


class Search:
    """A search level by level: nodes() evaluates the frontier, advance() extends it by one item.

    A frontier is never written: it is grown from the ends of the nodes above it, once to
    evaluate it, and once more for the ends of those of its nodes that are extended.  Only
    these are held, until the next level's are, and a row of them has no more than its place and utility.
    """

    def __init__(self, pos: DataFrame, least: float, pairs: float | None = None):
        """pos: positions, cut; least: the SWU that an item of any pattern has at least; pairs: the SWU that a pair of last and new item has at least, if pairs are tested."""
        self.pairs, self.length, self.names, self.pos = pairs, 1, None, pos
        #: (inside, last_item, item) of the extensions that their pair admits, from the third level on; whether rows are joined with them, or nodes.
        self.allowed, self.few = None, False
        self.ends, self.least = None, least
        #: Of a sparse level: the items by which the parents of each sequence are extended; and the number of items.
        self.hits, self.kinds = None, None
        swu = self._swu()
        known_pos = dealt(pos).join(swu.where(self._enough()), "item")
        self.n = int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        columns = ("sid", "share", "own", "tid", "k", "item", "util", "rem", *[c for c in swu.columns if c != "item"], *self._carried(), *(["su"] if pairs is not None else []))
        self.items = cut(known_pos.select(*columns).repartition(self.n, "sid", "share"), "sid", "share")
        per = self.items.groupBy("sid", "share").agg(F.count("*").cast("double").alias("n"))
        #: Positions of a sequence's share, as the mean position sees them.
        self.mean = per.agg(F.try_divide(F.sum(F.col("n") * F.col("n")), F.sum("n"))).first()[0] or 0.0

    def _swu(self) -> DataFrame:
        return item_swu(self.pos)

    def _enough(self) -> Column:
        """Whether an item's SWU admits it at the present length."""
        return F.col("swu") >= self.least

    def _carried(self) -> tuple[str, ...]:
        """Further columns of the positions that the frontier has."""
        return ()

    def _sums(self) -> list[Column]:
        """u, bound and support of the nodes, from iu and reach by sequence."""
        return [F.sum("iu").cast("long").alias("u"), F.sum("reach").cast("long").alias("bound"), F.count("*").alias("support")]

    def _gathered(self, per: DataFrame) -> DataFrame:
        """What _sums() sums up, of a row a node and sequence."""
        return per

    def front(self, only: DataFrame | None = None) -> DataFrame:
        """The frontier (sid, share, parent, inside, item, tid, k, iu, rem), not held; only: of some of its nodes, and few enough to be broadcast."""
        columns = ["sid", "share", "parent", "inside", "item", "tid", "k", "iu", "rem", *self._carried()]
        if self.pairs is not None and self.length == 2:
            columns.append("su")
        if self.ends is None:
            return self.items.where("own").withColumns({"parent": F.lit(-1).cast("long"), "inside": F.lit(False), "iu": F.col("util")}).select(*columns)
        ends, items = self.ends, self.items.where(self._enough())
        if only is not None:  # nothing grows below other parents or by other items
            ends = ends.join(F.broadcast(only.select("parent").distinct()), "parent", "left_semi")
            items = items.join(F.broadcast(only.select("item").distinct()), "item", "left_semi")
        grown = grow(ends, items, "sid", "share", held=True, hits=self.hits).select(*columns)
        return self._admitted(grown).select(*columns) if self.few else grown

    def _last(self) -> DataFrame:
        """The last item of each parent."""
        return self.names.select(F.col("id").alias("parent"), F.col("item").alias("last_item"))

    def _admitted(self, rows: DataFrame) -> DataFrame:
        """The rows (parent, inside, item, ...) whose pair is allowed."""
        allowed = F.broadcast(self.allowed) if self.few else self.allowed
        return rows.join(self._last(), "parent").join(allowed, ["inside", "last_item", "item"], "left_semi")

    def _allow(self, small: bool) -> None:
        """Sum up the pairs that the frontier would be grown by, and no others."""
        from .cooccurrence import reached

        grown = grow(self.ends, self.items.where(self._enough()), "sid", "share", held=True, hits=self.hits).select("parent", "inside", "item")
        wanted = cut(grown.join(self._last(), "parent").select("inside", "last_item", "item").distinct())
        few = wanted.count() <= BROADCAST_ROWS
        self.allowed = cut(reached(self.pos, wanted, self.pairs, few))
        self.few = few and small

    def nodes(self, keep: Column | None = None, counters: bool = False) -> DataFrame:
        """id, parent, inside, item, pat, len, u, bound, support of the frontier's patterns; keep: a test of u and bound, if not all are wanted; counters: rows, too, the occurrences.

        A pattern of two items stands in the sequences that its pair is summed over, so its pair's sum is made beside its own.
        """
        of_pair = self.pairs is not None and self.length == 2
        each = [F.max("iu").alias("iu"), F.max(F.col("iu") + F.col("rem")).alias("reach")] + [F.max(c).alias(c) for c in self._carried()] + [F.max("su").alias("su")] * of_pair + [F.count("*").alias("rows")] * counters
        per = self.front().groupBy("sid", "share", "parent", "inside", "item").agg(*each)
        nodes = self._gathered(per).groupBy("parent", "inside", "item").agg(*self._sums(), *[F.sum("su").alias("of_pair")] * of_pair, *[F.sum("rows").alias("rows")] * counters)
        if of_pair:
            nodes = nodes.where(F.col("of_pair") >= self.pairs)
        if keep is not None:
            nodes = nodes.where(keep)
        if self.allowed is not None and not self.few:
            nodes = self._admitted(nodes)
        sums = [c for c in nodes.columns if c not in ("parent", "inside", "item", "rows", "of_pair")]
        item = F.col("item").cast("string")
        if self.names is None:
            nodes = nodes.withColumn("pat", item)
        else:
            named = nodes.join(self.names.select(F.col("id").alias("parent"), F.col("pat").alias("start")), "parent")
            nodes = named.withColumn("pat", F.concat("start", F.when(F.col("inside"), F.lit(",")).otherwise(F.lit(")(")), item))
        named = nodes.select(F.monotonically_increasing_id().alias("id"), "parent", "inside", "item", "pat", F.lit(self.length).alias("len"), *sums, *["rows"] * counters)
        return cut(named, outlives=True)  # the search's result

    def _buckets(self, open_: DataFrame) -> int:
        """In how many buckets the nodes open_ are extended: a node's sequences (by view, of the view that has most) have a row a later position."""
        supports = [c for c in open_.columns if c.startswith("support")]
        most = F.greatest(*supports) if len(supports) > 1 else F.col(supports[0])
        self.made = (open_.agg(F.sum(most)).first()[0] or 0) * self.mean
        return self._tasks(self.made)

    def _tasks(self, rows: float) -> int:
        need = ceil(rows / ROWS)
        return self.n if need <= self.n else 2 * need  # so that the next levels seldom need more

    def _sparse(self, count: int) -> bool:
        """Whether the extensions of ``count`` nodes are mostly held by few sequences each, and many."""
        if self.made <= ROWS or self.mean > HEAVY:
            return False
        if self.kinds is None:
            self.kinds = self.items.select("item").distinct().count()
        return self.made < SPARSE * count * self.kinds

    def _hits(self, worth: float) -> DataFrame:
        """(sid, share, parent, first, found): the later items that may extend a parent to a node whose bound reaches worth.

        An occurrence reaches at most the largest utility of its parent's and what is left after the first of them.  That is sent
        once a parent and sequence, with the list of later items, to where the parent's extensions are summed, instead of a row an extension.
        """
        keys = ["sid", "share"]
        first = self.ends.groupBy(*keys, "parent").agg(F.min("k").alias("first"), F.max("iu").alias("top"))
        left = F.col("util") + F.col("rem")
        lists = self.items.where(self._enough()).groupBy(*keys).agg(F.collect_list(F.struct("k", "item", left.alias("left"))).alias("others"))
        later = first.join(lists, keys).withColumn("later", F.filter("others", lambda x: x["k"] > F.col("first"))).where(F.size("later") > 0)
        items = F.array_distinct(F.transform("later", lambda x: x["item"]))
        reach = F.col("top") + F.array_max(F.transform("later", lambda x: x["left"]))
        n = max(self.n, ceil(self.made / PAIRS))
        sent = cut(later.select(*keys, "parent", "first", reach.alias("reach"), items.alias("items")).repartition(n, "parent"), "parent", codec="zstd", buckets=n)
        sums = sent.select("parent", "reach", F.explode("items").alias("item")).groupBy("parent", "item").agg(F.sum("reach").alias("reach"))
        good = sums.where(F.col("reach") >= worth).groupBy("parent").agg(F.collect_list("item").alias("good"))
        found = sent.join(good, "parent").select(*keys, "parent", "first", F.array_intersect("items", "good").alias("found")).where(F.size("found") > 0)
        hits = cut(found.repartition(self.n, *keys), *keys, buckets=self.n)
        release(sent)
        return hits

    def advance(self, open_: DataFrame, count: int, least: float, counters: bool = False, worth: float | None = None) -> tuple[int, int] | None:
        """Extend the ``count`` nodes open_ by items whose SWU is at least ``least``; counters: return the occurrences that are made, and how many of them the SWU drops.

        worth: the bound that any wanted node of the next level has at least; others may be left out.
        """
        small = count <= BROADCAST_ROWS
        names = F.broadcast(open_) if small else open_
        front = self.front(open_ if small else None)
        ends = front.join(names.select("id", "parent", "inside", "item"), ["parent", "inside", "item"]).select("sid", "share", F.col("id").alias("parent"), "tid", "k", "iu")
        n = self._buckets(open_)
        sparse = worth is not None and self._sparse(count)
        if sparse:  # its extensions are not made; the ends are, about a row a node and sequence
            n = self._tasks(self.made / self.mean)
        if not small or n > self.n:  # the join may have been shuffled
            ends = ends.repartition(n, "sid", "share")
        before, self.ends = self.ends, cut(ends, "sid", "share", buckets=n)
        if before is not None:
            release(before)
        if n > self.n:
            coarse, self.items, self.n = self.items, cut(self.items.repartition(n, "sid", "share"), "sid", "share", buckets=n), n
            release(coarse)
        self.names, self.least = names, least
        self.length += 1
        if self.hits is not None:
            release(self.hits)
        self.hits = self._hits(worth) if sparse else None
        if self.pairs is not None and self.length > 2:
            self._allow(small)
        if counters:
            made = grow(self.ends, self.items, "sid", "share", held=True).agg(F.count("*"), F.count_if(F.col("swu") >= least)).first()
            return made[0], made[0] - made[1]


class DeadlinePassed(Exception):
    """The time of a search is over."""


@contextmanager
def deadline(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancel the jobs that the block runs after ``seconds``, and raise DeadlinePassed."""
    if seconds is None:
        yield
        return
    tag, end = f"deadline-{uuid4().hex}", time.monotonic() + seconds
    timer = Timer(seconds, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if time.monotonic() >= end:
            raise DeadlinePassed from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def mine(pos: DataFrame, xi: float | None = None, *, theta: float | None = None, options: Options | None = None, counters: bool = False, seconds: float | None = None, patterns_only: bool = False, held: bool = False) -> Mined:
    """Mine pos at theta, or at xi of its total utility.

    counters: count the occurrences that each layer drops; they are made first, so the search does more.
    seconds: a deadline; a search that it ends returns its whole levels, in Mined.cut_at the number of them.
    patterns_only: hold only nodes that are patterns or extended, for a caller that asks for patterns().
    held: pos is a table that its caller holds, so that it is not written again.
    """
    options = options or Options()
    spark = pos.sparkSession
    with steps(spark):
        pos = pos if held else cut(pos)
        total = total_utility(pos)
        out = Mined(xi * total if theta is None else theta, total)
        try:
            with deadline(spark, seconds):
                _levels(pos, out, options, counters, None if seconds is None else time.monotonic() + seconds, patterns_only)
        except DeadlinePassed:
            out.cut_at = len(out.levels)
            if not out.levels:
                out.levels.append(spark.createDataFrame([], "pat string, len int, u long, bound long, support long"))
    return out


def _levels(pos: DataFrame, out: Mined, options: Options, counters: bool, end: float | None, patterns_only: bool) -> None:
    """Add the search's levels to out, until nothing is open, max_len is reached or the time is over."""
    theta = out.theta
    search = Search(pos, theta, theta if options.eucs else None)
    made = None
    if counters:
        rows = pos.count()
        made = rows, rows - search.items.where("own").count()
    while True:
        extended = F.col("bound") >= F.lit(theta) * (search.length + 1)
        some = patterns_only and options.bound and not counters
        keep = (F.col("u") >= F.lit(theta) * search.length) | extended if some else None
        nodes = search.nodes(keep, counters)
        if counters:
            kept_ = nodes.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long")).first()[0]
            out.dropped.append((search.length, kept_, made[1], made[0] - made[1] - kept_))
        out.levels.append(nodes.select("pat", "len", "u", "bound", "support"))
        open_ = nodes.where(extended) if options.bound else nodes
        count = open_.count()
        if not count:
            return
        if options.max_len == search.length:
            out.cut_at = search.length
            return
        if end is not None and time.monotonic() >= end:  # between two jobs
            raise DeadlinePassed
        more = theta * (search.length + 1)  # a pattern's utility, and so its bound, reaches it; that of an extended node does, too
        made = search.advance(open_, count, more if options.length_swu else theta, counters, more if some else None)


def layer_counters(found: Mined) -> DataFrame:
    """(len, nodes, extended, cut, patterns, occurrences, dropped_swu, dropped_pair) of a search that counted; cut: nodes that their bound closed."""
    theta, n = F.lit(found.theta), F.col("len")
    per = found.nodes().groupBy("len").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("bound") >= theta * (n + 1)).alias("extended"),
        F.count_if(F.col("bound") < theta * (n + 1)).alias("cut"),
        F.count_if(F.col("u") >= theta * n).alias("patterns"),
    )
    dropped = per.sparkSession.createDataFrame(found.dropped, "len int, occurrences long, dropped_swu long, dropped_pair long")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(dropped).join(per, "len", "left").select("len", *[zero(c) for c in ("nodes", "extended", "cut", "patterns")], "occurrences", "dropped_swu", "dropped_pair")
