"""Text sequence databases.

A sequence line holds ``item[qty]`` tokens; -1 ends an itemset, -2 the sequence;
lines that are blank or start with # or @ are skipped.  A token without
brackets has quantity 1; an item without a profit has profit 1; a token that
can't be read is dropped; a repeated item of an itemset is summed; an empty
itemset doesn't count; a line without itemsets uses up a sid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): data lines in file order.  Lines are numbered inside file blocks, whose counts give the offsets."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seen"), "value")
    text = text.where(~F.trim("value").rlike(r"^(?:[#@].*)?$"))
    counts = sorted((r["file"], r["block"], r["count"]) for r in text.groupBy("file", "block").count().collect())
    rows, at = [], 0
    for file, block, n in counts:
        rows.append((file, block, at))
        at += n
    first = spark.createDataFrame(rows, "file string, block long, first long")
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("seen")) - 1
    return text.withColumn("inside", inside).join(F.broadcast(first), ["file", "block"]).select((F.col("first") + F.col("inside")).alias("line"), "value")


def read_profits(spark: SparkSession, path: str) -> DataFrame:
    """(item, profit); of repeated items the last line counts."""
    parts = F.split(F.trim("value"), r"[:\s,]+")
    rows = numbered_lines(spark, path).select("line", F.get(parts, F.lit(0)).cast("int").alias("item"), F.get(parts, F.lit(1)).cast("long").alias("profit"))
    return rows.where("item is not null and profit is not null").groupBy("item").agg(F.max_by("profit", "line").alias("profit"))


def read_sequences(spark: SparkSession, path: str, profits: DataFrame) -> DataFrame:
    """raw(sid, tid, item, qty, util)."""
    tokens = numbered_lines(spark, path).select(F.col("line").alias("sid"), F.split(F.regexp_replace(F.trim("value"), r"(?:^|\s)-2(?:\s.*)?$", ""), r"\s+").alias("tokens"))
    sets = F.split(F.array_join("tokens", " "), r"(?:^|(?<=\s))-1(?=\s|$)")
    each = tokens.select("sid", F.posexplode(sets).alias("at", "body")).select("sid", "at", F.explode(F.split(F.trim("body"), r"\s+")).alias("token"))
    item = F.regexp_extract("token", r"^(-?[0-9]+)(?:\[(-?[0-9]+)\])?$", 1)
    qty = F.regexp_extract("token", r"^(-?[0-9]+)(?:\[(-?[0-9]+)\])?$", 2)
    read = each.select("sid", "at", item.try_cast("int").alias("item"), F.when(qty == "", 1).otherwise(qty.try_cast("int")).alias("qty"))
    read = read.where("item >= 0 and qty is not null")
    read = read.withColumn("tid", F.dense_rank().over(Window.partitionBy("sid").orderBy("at")) - 1)
    merged = read.groupBy("sid", "tid", "item").agg(F.sum("qty").cast("long").alias("qty"))
    return merged.join(profits, "item", "left").select("sid", "tid", "item", "qty", (F.col("qty") * F.coalesce("profit", F.lit(1))).alias("util"))


def write_patterns(patterns: DataFrame, path: str) -> None:
    """Lines of pattern, average utility with two decimals, support."""
    lines = patterns.select(F.concat_ws("\t", "pattern", F.format_string("%.2f", "avg_utility"), F.col("support").cast("string")).alias("value"))
    lines.write.text(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of input files, to hold against a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
