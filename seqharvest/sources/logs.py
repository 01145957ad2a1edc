"""Shop logs as transaction rows, and transaction rows as sequence files.

rows(cust, basket, day, item, util): one row a line of a receipt; day is a day
number, util a whole number (a price times a scale, rounded half to even).
Rows whose util is not over 0, or that lack a field, go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.incremental import ranked
from .archives import read_workbook, read_zipped_csv
from .qsdb import numbered_lines, read_sequences


def _iso(name: str) -> Column:
    return F.unix_date(F.to_date(F.substring(name, 1, 10)))


def _scaled(value: Column, scale: int) -> Column:
    return F.rint(value.try_cast("double") * scale).cast("long")


def _joined(*names: str) -> Column:
    """Fields with bars between; null if one is, as in the logs' own keys."""
    return F.concat(*[x for n in names for x in (F.lit("|"), F.col(n))][1:])


# The logs' column names, keys of baskets and items, and scales of money.
#: Kind of log -> its columns as (cust, basket, day, item, util); all fields are read as text.
KINDS = {
    "tafeng": lambda: (F.col("CUSTOMER_ID"), _joined("CUSTOMER_ID", "TRANSACTION_DT"), F.unix_date(F.to_date("TRANSACTION_DT", "M/d/yyyy")), F.col("PRODUCT_ID"), _scaled(F.col("SALES_PRICE"), 1)),
    "dunnhumby": lambda: (F.col("household_key"), F.col("BASKET_ID"), F.col("DAY").try_cast("int"), F.col("PRODUCT_ID"), _scaled(F.col("SALES_VALUE"), 100)),
    "hm": lambda: (F.col("customer_id"), _joined("customer_id", "t_dat"), _iso("t_dat"), F.col("article_id"), _scaled(F.col("price"), 10**6)),
    "valued_shoppers": lambda: (F.col("id"), _joined("id", "date"), _iso("date"), _joined("category", "company", "brand"), _scaled(F.col("purchaseamount"), 100)),
    "rees46": lambda: (F.col("user_id"), F.concat("user_id", F.lit("|"), F.coalesce("user_session", F.lit(""))), _iso("event_time"), F.col("product_id"), _scaled(F.col("price"), 100)),
    "online_retail": lambda: (F.col("Customer ID").try_cast("double").cast("long").cast("string"), F.col("Invoice"), F.floor(F.col("InvoiceDate").try_cast("double")).cast("int"), F.col("StockCode"), _scaled(F.col("Quantity").try_cast("double") * F.col("Price").try_cast("double"), 1000)),
}


def from_log(fields: DataFrame, kind: str) -> DataFrame:
    """rows of a log whose fields are text columns under the log's own names."""
    if kind == "rees46":
        fields = fields.where("event_type = 'purchase'")
    names = ("cust", "basket", "day", "item", "util")
    rows = fields.select(*[c.alias(n) for c, n in zip(KINDS[kind](), names, strict=True)])
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    return rows.where(complete & (F.col("util") > 0) & (F.col("cust") != ""))


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """rows of CSV files with a header (rees46: in zip archives too; online_retail: a workbook)."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of log: {kind}")
    if kind == "online_retail":
        fields = read_workbook(spark, path, ["Invoice", "StockCode", "Quantity", "InvoiceDate", "Price", "Customer ID"])
    elif path.lower().endswith(".zip"):
        fields = read_zipped_csv(spark, path, ["event_time", "event_type", "product_id", "price", "user_id", "user_session"])
    else:
        fields = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return from_log(fields, kind)


def encoded(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with ``out``, a dense number from 0 of the column's values in ascending order.  Values are numbered range by range, so no task sorts them all."""
    codes = ranked(rows.select(column).where(F.col(column).isNotNull()).distinct(), column).withColumnRenamed("number", out)
    return rows.join(codes, column, "left")


def sequences(rows: DataFrame) -> DataFrame:
    """seq(sid, tid, item, qty): a customer's baskets in order of (day, basket); a basket's rows of one item are one, with the util as quantity; items from 1."""
    per = rows.groupBy("cust", "basket", "item").agg(F.min("day").alias("day"), F.sum("util").cast("long").alias("qty"))
    baskets = per.groupBy("cust", "basket").agg(F.min("day").alias("day"))
    placed = baskets.select("cust", "basket", (F.row_number().over(Window.partitionBy("cust").orderBy("day", "basket")) - 1).cast("int").alias("tid"))
    return per.join(placed, ["cust", "basket"]).select(F.col("cust").alias("sid"), "tid", (F.col("item") + 1).alias("item"), "qty")


def _line(sets: Column) -> Column:
    """The text of a sequence: arrays of tokens, an array an itemset."""
    return F.concat(F.array_join(F.transform(sets, lambda s: F.concat(F.array_join(s, " "), F.lit(" -1"))), " "), F.lit(" -2"))


def lines(seq: DataFrame, *keys: str) -> DataFrame:
    """(keys, line): each sequence's line, itemsets by tid, items ascending."""
    token = F.struct("item", F.format_string("%d[%d]", F.col("item").cast("long"), F.col("qty").cast("long")).alias("token"))
    sets = seq.groupBy(*keys, "tid").agg(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["token"]).alias("tokens"))
    return sets.groupBy(*keys).agg(_line(F.transform(F.array_sort(F.collect_list(F.struct("tid", "tokens"))), lambda x: x["tokens"])).alias("line"))


def export_lines(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """(batch, cust, line): what each customer adds in each batch, baskets in order of their number; the base is batch 0.  Baskets over two batches are refused."""
    sched = F.broadcast(schedule.select(F.col("batch").alias("b"), "first_day", "end_day"))
    dealt = rows.join(sched, (F.col("day") >= F.col("first_day")) & (F.col("day") < F.col("end_day")), "left").withColumn("batch", F.coalesce("b", F.lit(0)))
    if not dealt.groupBy("cust", "basket").agg(F.countDistinct("batch").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a basket lies in two batches")
    per = dealt.groupBy("batch", "cust", F.col("basket").alias("tid"), (F.col("item") + 1).alias("item")).agg(F.sum("util").alias("qty"))
    return lines(per, "batch", "cust")


def write_export(exported: DataFrame, path: str) -> None:
    """Files ``lines``, ``keys`` (a line each, in order of batch and customer) and ``sizes`` (lines per batch, comma-joined)."""
    spark = exported.sparkSession
    done = exported.repartitionByRange("batch", "cust").sortWithinPartitions("batch", "cust")
    done = done.select("batch", F.col("cust").cast("string").alias("cust"), "line")
    done.select("line").write.text(f"{path}/lines")
    done.select("cust").write.text(f"{path}/keys")
    sizes = {r["batch"]: r["count"] for r in exported.groupBy("batch").count().collect()}
    spark.createDataFrame([(",".join(str(sizes.get(b, 0)) for b in range(1 + max(sizes, default=0))),)], "sizes string").coalesce(1).write.text(f"{path}/sizes")


def read_keyed(spark: SparkSession, lines_path: str, keys_path: str, sizes_path: str, profits: DataFrame) -> DataFrame:
    """raw(sid, batch_id, part_seq, tid, item, qty, util): line n has key n and lies in the batch that the sizes put it in; part_seq is its place in the file."""
    found = read_sequences(spark, lines_path, profits).withColumnRenamed("sid", "line")
    keys = numbered_lines(spark, keys_path).select("line", F.trim("value").try_cast("long").alias("sid"))
    sizes = [int(x) for r in spark.read.text(sizes_path).collect() for x in r["value"].split(",") if x.strip()]
    here, named = numbered_lines(spark, lines_path).count(), keys.count()
    if not here == named == sum(sizes):
        raise ValueError(f"{here} lines, {named} keys, batches of {sum(sizes)} lines")
    batch = F.lit(len(sizes) - 1)
    for b in reversed(range(len(sizes) - 1)):
        batch = F.when(F.col("line") < sum(sizes[: b + 1]), F.lit(b)).otherwise(batch)
    return found.join(keys, "line").select("sid", batch.alias("batch_id"), F.col("line").alias("part_seq"), "tid", "item", "qty", "util")


def verified(spark: SparkSession, path: str, manifest: dict[str, str]) -> None:
    """Refuse input files whose SHA-256 is not the manifest's (file name -> digest), or that either side lacks."""
    from .qsdb import digests

    found = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in digests(spark, path).collect()}
    if wrong := sorted(n for n in manifest.keys() | found.keys() if manifest.get(n) != found.get(n)):
        raise ValueError(f"input files differ from the manifest: {', '.join(wrong)}")
