"""Sequence databases from ordinary tables: raw(sid, tid, item, util)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence: customer; itemset: year; item: order priority 1-5; utility: price in cents."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sid"),
        F.year("o_orderdate").alias("tid"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("item"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("util"),
    )


ORDER_YEARS = """SELECT o_custkey AS sid, CAST(year(o_orderdate) AS INT) AS tid, CAST(substr(o_orderpriority, 1, 1) AS INT) AS item,
 CAST(round(o_totalprice * 100) AS BIGINT) AS util FROM orders"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence: customer; itemset: order day; item: part; utility: quantity times price in cents."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("profit"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01")).alias("tid"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.round("l_quantity").cast("long").alias("qty"))
    joined = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("o_custkey").alias("sid"), "tid", F.col("l_partkey").cast("int").alias("item"), (F.col("qty") * F.col("profit")).alias("util"))


LINES = """SELECT o_custkey AS sid, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS tid, CAST(l_partkey AS INT) AS item,
 CAST(round(l_quantity) AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) AS util
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


def event_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence: user; itemset: week of 2024; item: event type by alphabet, from 1; utility: value in hundredths."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"), F.expr("cast(datediff(ts, date'2024-01-01') div 7 as int)").alias("tid"), code.alias("item"), F.round(F.col("value") * 100).cast("long").alias("util")
    )


EVENT_WEEKS = """SELECT user_id AS sid, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INT) AS tid,
 CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INT) AS item, CAST(round(value * 100) AS BIGINT) AS util FROM events"""


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction rows (cust, basket, day, item, util)."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("basket"), F.col("o_custkey").alias("cust"), F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("util"))
    return rows.join(orders, "basket").select("cust", "basket", "day", "item", "util")


ORDER_ROWS = """SELECT o_custkey AS cust, o_orderkey AS basket, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day,
 l_partkey AS item, CAST(round(l_extendedprice * 100) AS BIGINT) AS util FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def retail(rows: DataFrame) -> DataFrame:
    """Transaction rows (cust, day, item, qty, amount) -> sequences: customer, customer-day, items with summed quantity and a median unit price of at least 1.

    A sequence has its customer's key; days of a customer and items get dense ids by ascending key.
    """
    from ..operators.incremental import ranked

    good = rows.where("qty > 0 and amount > 0")
    price = good.groupBy("item").agg(F.greatest(F.lit(1), F.bround(F.median(F.col("amount") / F.col("qty")))).cast("long").alias("profit"))
    items = ranked(price, "item").select("item", "profit", (F.col("number") + 1).alias("item_id"))
    days = good.groupBy("cust", "day", "item").agg(F.sum("qty").cast("long").alias("qty"))
    tid = (F.dense_rank().over(Window.partitionBy("cust").orderBy("day")) - 1).alias("tid")
    return days.select("cust", "item", "qty", tid).join(items, "item").select(F.col("cust").alias("sid"), "tid", F.col("item_id").alias("item"), "qty", "profit")
