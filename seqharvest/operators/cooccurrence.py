"""Estimated utility of co-occurring items: self, sequence (S) and itemset (I) pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..storage import cut
from .mine import item_swu

#: Most rows of a group that one join key has; pairs of larger groups are made block by block.
BLOCK = 2_000
#: Most sequences of an item whose pairs are summed in one task; those of more frequent items are summed in parts first.
FREQUENT = 20_000
#: Pairs that a task sums at most, on average, so that their sums need no disk.
PAIRS = 4_000_000


def _ends(pos: DataFrame) -> DataFrame:
    return pos.groupBy("sid", "item").agg(F.min("tid").alias("first"), F.max("tid").alias("last"), F.max("su").alias("su"))


def self_pairs(pos: DataFrame) -> DataFrame:
    """Sum of u(S) over sequences that hold the item in two itemsets."""
    return _ends(pos).where("first < last").groupBy("item").agg(F.sum("su").cast("long").alias("swu"))


def _blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys, item, ...) held in buckets of the keys, with the block that each has in its group, and its group's number of blocks."""
    group = Window.partitionBy(*keys)
    block = F.floor((F.row_number().over(group.orderBy("item")) - 1) / BLOCK).cast("int")
    return cut(rows.withColumns({"block": block, "blocks": F.ceil(F.count("*").over(group) / BLOCK).cast("int")}), *keys)


def _sides(held: DataFrame, *keys: str) -> Iterator[tuple[DataFrame, DataFrame, list[str]]]:
    """Both sides and the keys of joins that pair all rows (keys, item, ...) of a group, held by _blocks().

    Groups of at most BLOCK rows are joined where they are held.  Larger ones are
    joined by pairs of blocks, so that no key of a join has more than BLOCK rows.
    """
    small = held.where("blocks = 1")
    yield small, small, list(keys)
    large = held.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = lambda i, j: large.withColumnsRenamed({"block": i, "other": j})
    yield named("i", "j"), named("j", "i"), [*keys, "i", "j"]


def _s_rows(held: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(a, b, su) of each sequence where a is first seen before b is last seen, of _ends() held by _blocks(); only: the items that a may be."""
    found = []
    for x, y, on in _sides(held, "sid"):
        x = x if only is None else x.join(only, "item", "left_semi")
        pairs = x.select(*on, F.col("item").alias("a"), "first", "su").join(y.select(*on, F.col("item").alias("b"), "last"), on)
        found.append(pairs.where("first < last").select("a", "b", "su"))
    return reduce(DataFrame.unionAll, found)


def _i_rows(pos: DataFrame) -> DataFrame:
    """(sid, a, b, su), a < b, of each itemset that a and b share."""
    n = int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for x, y, on in _sides(_blocks(pos.select("sid", "tid", "item", "su").repartition(n, "sid", "tid"), "sid", "tid"), "sid", "tid"):
        pairs = x.select(*on, F.col("item").alias("a"), "su").join(y.select(*on, F.col("item").alias("b")), on)
        found.append(pairs.where("a < b").select("sid", "a", "b", "su"))
    return reduce(DataFrame.unionAll, found)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a", "b").agg(F.sum("su").cast("long").alias("swu"))


def s_pairs(pos: DataFrame) -> DataFrame:
    """(a, b), a != b: sum of u(S) where a is first seen before b is last seen.

    A sequence sends each item once, with the list of those that are last seen later, to where the item's pairs are summed.  Items of
    more than FREQUENT sequences, or of any sequence of more than BLOCK items, send their pairs one by one, summed up before.
    """
    held = _blocks(_ends(pos), "sid")
    wide = cut(held.groupBy("item").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks")).where((F.col("n") > FREQUENT) | (F.col("blocks") > 1)).select("item"))
    small, none = held.where("blocks = 1"), wide.isEmpty()
    pairs = small.groupBy("sid").count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1)), F.lit(0)).cast("long")).first()[0]
    parts = max(int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    lists = small.groupBy("sid").agg(F.collect_list(F.struct("item", "last")).alias("others"))
    first = small.select("sid", F.col("item").alias("a"), "first", "su")
    first = first if none else first.join(wide.select(F.col("item").alias("a")), "a", "left_anti")
    later = F.filter("others", lambda other: (other["last"] > F.col("first")) & (other["item"] != F.col("a")))
    sent = first.join(lists, "sid").select("a", "su", F.transform(later, lambda other: other["item"]).alias("later"))
    narrow = _summed(sent.where(F.size("later") > 0).repartition(parts, "a").select("a", F.explode("later").alias("b"), "su"))
    return narrow if none else narrow.unionAll(_summed(_s_rows(held, wide).where("a != b")))


def i_pairs(pos: DataFrame) -> DataFrame:
    """(a, b), a < b: sum of u(S), once a sequence, where a and b share an itemset."""
    return _summed(_i_rows(pos).distinct())


def reached(pos: DataFrame, wanted: DataFrame, theta: float, few: bool) -> DataFrame:
    """Those of wanted(inside, last_item, item), held, whose pair's sum reaches theta; few: they can be broadcast.  No other pairs are summed."""
    at = lambda rows: F.broadcast(rows) if few else rows
    found = []
    for inside, rows in ((False, lambda p: _s_rows(_blocks(_ends(p), "sid"))), (True, lambda p: _i_rows(p).distinct())):
        pairs = wanted.where(F.col("inside") == inside).select(F.col("last_item").alias("a"), F.col("item").alias("b"))
        items = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()
        sums = _summed(rows(pos.join(at(items), "item", "left_semi")).join(at(pairs), ["a", "b"], "left_semi"))
        found.append(sums.where(F.col("swu") >= theta).select(F.lit(inside).alias("inside"), F.col("a").alias("last_item"), F.col("b").alias("item")))
    return found[0].unionAll(found[1])


def pair_filter(pos: DataFrame, theta: float) -> DataFrame:
    """(kind, last_item, new_item) of the extensions that reach theta; sound for patterns of any length.

    A pair's sum is at most that of either item, so items below theta form no pairs.
    """
    enough = F.col("swu") >= theta
    good = cut(item_swu(pos).where(enough).select("item"))
    pos = pos.join(good, "item", "left_semi")
    s = s_pairs(pos).where(enough).select(F.lit("s").alias("kind"), F.col("a").alias("last_item"), F.col("b").alias("new_item"))
    own = self_pairs(pos).where(enough).select(F.lit("s").alias("kind"), F.col("item").alias("last_item"), F.col("item").alias("new_item"))
    i = i_pairs(pos).where(enough).select(F.lit("i").alias("kind"), F.col("a").alias("last_item"), F.col("b").alias("new_item"))
    return s.unionAll(own).unionAll(i)


def append_delta(old: DataFrame, new: DataFrame, of=s_pairs) -> DataFrame:
    """Change of the S pairs (of: i_pairs, self_pairs) between the positions of touched sequences before and after an append."""
    both = of(new).unionAll(of(old).withColumn("swu", -F.col("swu")))
    keys = [c for c in both.columns if c != "swu"]
    return both.groupBy(*keys).agg(F.sum("swu").cast("long").alias("delta")).where("delta != 0")
