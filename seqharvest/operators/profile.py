"""How a customer database grows: baskets, batch schedules, update profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def basket_table(rows: DataFrame) -> DataFrame:
    """A row per (cust, basket): day, util, rows (distinct items), maxrow (largest item utility)."""
    items = rows.groupBy("cust", "basket", "item").agg(F.min("day").alias("day"), F.sum("util").alias("util"))
    return items.groupBy("cust", "basket").agg(F.min("day").alias("day"), F.sum("util").cast("long").alias("util"), F.count("*").alias("rows"), F.max("util").cast("long").alias("maxrow"))


def min_baskets(baskets: DataFrame, least: int = 5) -> DataFrame:
    """Baskets of customers that have at least so many."""
    return baskets.join(baskets.groupBy("cust").count().where(F.col("count") >= least).select("cust"), "cust", "left_semi")


def schedule_l5(baskets: DataFrame) -> DataFrame:
    """(batch, first_day, end_day): the base ends on the day when half of the baskets are reached; five equal ranges follow, the last with the remainder."""
    per_day = baskets.groupBy("day").agg(F.count("*").alias("n"))  # a row per day: its windows are small
    running = per_day.withColumns({"upto": F.sum("n").over(Window.orderBy("day")), "all": F.sum("n").over(Window.partitionBy())})
    cut = running.where(F.col("upto") >= F.ceil(F.col("all") / 2)).agg((F.min("day") + 1).alias("start"))
    end = per_day.agg(F.max("day").alias("last"))
    step = F.expr("(last - start + 1) div 5")
    batches = cut.crossJoin(end).withColumn("step", step).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("batch"))
    first = F.col("start") + (F.col("batch") - 1) * F.col("step")
    return batches.select("batch", first.cast("int").alias("first_day"), F.when(F.col("batch") == 5, F.col("last") + 1).otherwise(first + F.col("step")).cast("int").alias("end_day"))


def schedule_w8(baskets: DataFrame) -> DataFrame:
    """The last 56 days as eight weeks."""
    start = baskets.agg((F.max("day") + 1 - 56).alias("start")).select("start", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("batch"))
    first = F.col("start") + (F.col("batch") - 1) * 7
    return start.select("batch", first.cast("int").alias("first_day"), (first + 7).cast("int").alias("end_day"))


def update_profile(baskets: DataFrame, schedule: DataFrame) -> DataFrame:
    """Per batch: shares r, t, g, a, median length l, rewrite factor w, kappa, touched and new sequences.

    Baskets are combined by (batch, customer) first; the schedule is a handful of rows.
    """
    first = baskets.groupBy("cust").agg(F.min("day").alias("first"))
    rows = baskets.join(first, "cust").join(F.broadcast(schedule), F.col("day") < F.col("end_day"))
    inside, known, before = F.col("day") >= F.col("first_day"), F.col("first") < F.col("first_day"), F.col("day") < F.col("first_day")
    total = lambda test, what: F.sum(F.when(test, F.col(what)).otherwise(0))
    number = lambda test: F.sum(F.when(test, 1).otherwise(0))
    per = rows.groupBy("batch", "cust").agg(
        number(inside).alias("n"),
        number(inside & known).alias("n_known"),
        number(before).alias("len"),
        total(inside, "util").alias("u"),
        total(inside & known, "util").alias("u_app"),
        total(before, "util").alias("u_before"),
        F.sum("rows").alias("rows_after"),
        total(inside & known, "rows").alias("rows_app"),
        F.max("maxrow").alias("maxrow"),
    )
    hit = F.col("n_known") > 0
    out = per.groupBy("batch").agg(
        F.sum("n").alias("baskets"),
        (F.sum("n_known") / F.sum("n")).alias("r"),
        (number(hit) / number(F.col("len") > 0)).alias("t"),
        (F.sum("u") / F.sum("u_before")).alias("g"),
        (F.sum("u_app") / F.sum("u")).alias("a"),
        F.median(F.when(hit, F.col("len"))).alias("l"),
        (F.sum(F.when(hit, F.col("rows_after"))) / F.sum("rows_app")).alias("w"),
        (F.sum("u") / F.max(F.when(F.col("n") > 0, F.col("maxrow")))).alias("kappa"),
        number(hit).cast("long").alias("touched"),
        number((F.col("n") > 0) & ~hit).cast("long").alias("new_sequences"),
    )
    return out.where("baskets > 0").withColumn("baskets", F.col("baskets").cast("long"))


def hash_sample(rows: DataFrame, share: float) -> DataFrame:
    """Rows of a share of the customers, chosen by a multiplicative hash of the key."""
    return rows.where(F.pmod(F.col("cust") * F.lit(2654435761), F.lit(1 << 32)) < F.lit(share) * F.lit(float(1 << 32)))


def batch_lines(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row per (batch, cust): its itemsets, items and utility; the base is batch 0.  Baskets over two batches are refused.  logs.export_lines gives the lines."""
    sched = F.broadcast(schedule.select(F.col("batch").alias("b"), "first_day", "end_day"))
    dealt = rows.join(sched, (F.col("day") >= F.col("first_day")) & (F.col("day") < F.col("end_day")), "left").withColumn("batch", F.coalesce("b", F.lit(0)))
    split = dealt.groupBy("basket").agg(F.countDistinct("batch").alias("n")).where("n > 1")
    if split.limit(1).count():
        raise ValueError("a basket lies in two batches")
    return dealt.groupBy("batch", "cust").agg(F.countDistinct("day").alias("itemsets"), F.count("*").alias("items"), F.sum("util").cast("long").alias("util"))
