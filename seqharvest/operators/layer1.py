"""Per-sequence and per-item aggregates over pos (see mine.positions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .incremental import ranked
from .mine import item_swu


def seq_utility(pos: DataFrame) -> DataFrame:
    return pos.groupBy("sid").agg(F.sum("util").cast("long").alias("su"))


def threshold(pos: DataFrame, xi: float) -> DataFrame:
    """One row: total and theta = xi * total."""
    total = F.coalesce(F.sum("util"), F.lit(0)).cast("long")
    return pos.agg(total.alias("total")).select("total", (F.lit(xi) * F.col("total")).alias("theta"))


def promising_items(pos: DataFrame, xi: float) -> DataFrame:
    """Every item with its SWU and whether it reaches theta."""
    return item_swu(pos).crossJoin(F.broadcast(threshold(pos, xi))).select("item", "swu", (F.col("swu") >= F.col("theta")).alias("promising"))


def compact_order(pos: DataFrame, xi: float) -> DataFrame:
    """Promising items numbered by descending SWU, ties by item."""
    good = ranked(promising_items(pos, xi).where("promising"), F.desc("swu"), F.asc("item"))
    return good.select("item", "swu", F.col("number").cast("int").alias("compact_id"))


def length_aware_swu(pos: DataFrame, xi: float, lengths: range) -> DataFrame:
    """(len, item) pairs where the item may extend to that length: swu >= theta * len."""
    lens = F.explode(F.array(*[F.lit(n) for n in lengths])).alias("len")
    return item_swu(pos).crossJoin(F.broadcast(threshold(pos, xi))).select("item", "swu", "theta", lens).where(F.col("swu") >= F.col("theta") * F.col("len")).select("len", "item")


def root_lists(pos: DataFrame, xi: float) -> DataFrame:
    """Single items: u, bound (sum of the largest util + rem), support, and the root test u >= theta or swu >= 2 theta."""
    per = pos.groupBy("item", "sid").agg(F.max("util").alias("iu"), F.max(F.col("util") + F.col("rem")).alias("reach"), F.max("su").alias("su"))
    items = per.groupBy("item").agg(F.sum("iu").cast("long").alias("u"), F.sum("reach").cast("long").alias("bound"), F.count("*").alias("support"), F.sum("su").cast("long").alias("swu"))
    kept = (F.col("u") >= F.col("theta")) | (F.col("swu") >= F.col("theta") * 2)
    return items.crossJoin(F.broadcast(threshold(pos, xi))).select("item", "u", "bound", "support", "swu", kept.alias("kept"))


def dataset_stats(pos: DataFrame) -> DataFrame:
    """One row: sequences, items, mean itemsets and items per sequence, total utility."""
    # itemsets are counted per sequence first, so that no task holds all (sid, tid) pairs
    per = pos.groupBy("sid").agg(F.countDistinct("tid").alias("itemsets"), F.count("*").alias("n"), F.sum("util").alias("su"))
    items = pos.agg(F.countDistinct("item").alias("items"))
    means = per.agg(F.count("*").alias("sequences"), F.avg("itemsets").alias("mean_itemsets"), F.avg("n").alias("mean_items"), F.sum("su").cast("long").alias("total_utility"))
    return means.crossJoin(F.broadcast(items)).select("sequences", "items", "mean_itemsets", "mean_items", "total_utility")


def identifier_space(pos: DataFrame) -> DataFrame:
    """One row: largest item id, distinct items, density."""
    return pos.agg(F.max("item").alias("max_item"), F.countDistinct("item").alias("items")).select("max_item", "items", (F.col("items") / F.col("max_item")).alias("density"))


def item_total_rank(pos: DataFrame) -> DataFrame:
    """Items by total utility, ties to the lowest id."""
    totals = pos.groupBy("item").agg(F.sum("util").cast("long").alias("total"))
    return ranked(totals, F.desc("total"), F.asc("item")).select("item", "total", (F.col("number") + 1).cast("int").alias("rank"))
