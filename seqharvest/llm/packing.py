"""Packing into optimal length buckets.

The global histogram of lengths decides the bucket boundaries: dynamic
programming over the distinct lengths finds the ``buckets`` boundaries of least
total padding (each document is padded to its bucket's upper boundary).  Inside
a bucket, documents form batches of at most ``budget`` padded tokens.  A token is what
``length`` counts; the caller says what that is.

The histogram has a row for each distinct length, which is what the driver
gets.  Documents are numbered inside ``(bucket, share)``: a bucket is dealt into
shares of about ``SHARE`` documents by a hash of the row's number in the written
table of lengths, so that no task gets a whole bucket, however many rows are equal, and the counts of the shares before it complete a document's place in
the bucket.  Texts are not moved.

Defined results: a null or empty text has length 0 and is packed like any
other; a document longer than the budget is a batch of its own; equal rows get
places of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import written

SHARE = 1_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of least total padding.

    Padding of a bucket over the lengths i..j-1 is length[j-1] * documents -
    tokens, which obeys the quadrangle inequality: the best split of j never
    moves left as j grows, so each layer is found by divide and conquer.
    """
    d = len(lengths)
    if not d:
        return []
    buckets = min(buckets, d)
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(lengths.astype(np.float64) * counts)])
    up = np.concatenate([[0], lengths]).astype(np.float64)
    cost = lambda i, j: up[j] * (n[j] - n[i]) - (s[j] - s[i])
    best = np.where(np.arange(d + 1) == 0, 0.0, np.inf)
    splits = []
    for _ in range(buckets):
        new, split = np.full(d + 1, np.inf), np.zeros(d + 1, np.int64)
        new[0] = 0.0
        todo = [(1, d, 0, d - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            value = best[i] + cost(i, mid)
            k = int(value.argmin())
            new[mid], split[mid] = value[k], i[k]
            if lo < mid:
                todo.append((lo, mid - 1, a, int(i[k])))
            if mid < hi:
                todo.append((mid + 1, hi, int(i[k]), b))
        best = new
        splits.append(split)
    out, j = [], d
    for split in reversed(splits):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(split[j])
    return out[::-1]


def pack(rows: DataFrame, *, keep: list[str], length: Column, buckets: int = 8, budget: int = 16_384) -> DataFrame:
    """The ``keep`` columns with length, bucket (its upper boundary), batch (in the bucket, from 0), place (in the batch, from 0), padding."""
    if clash := {k.lower() for k in keep} & {"length", "bucket", "batch", "place", "padding"}:
        raise ValueError(f"kept columns clash with result columns: {sorted(clash)}")
    spark = rows.sparkSession
    kept = [f"kept_{i}" for i in range(len(keep))]  # names that no column made here has
    row = "row_number"
    sized = written(rows.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keep, kept, strict=True)], F.coalesce(length, F.lit(0)).cast("long").alias("length"), F.monotonically_increasing_id().alias(row)), "lengths")  # texts are read once
    found = sized.groupBy("length").agg(F.count("*").alias("n")).collect()
    lengths = np.array(sorted(r["length"] for r in found), np.int64)
    count = {r["length"]: r["n"] for r in found}
    counts = np.array([count[x] for x in lengths.tolist()], np.int64)
    upper = boundaries(lengths, counts, buckets) or [0]
    inside = [int(counts[(lengths <= b) & (lengths > a)].sum()) for a, b in zip([-1, *upper], upper)]
    shares = [max(1, -(-k // SHARE)) for k in inside]

    def by_bucket(values: list[int]) -> Column:
        out = F.lit(values[-1])
        for b, v in reversed(list(zip(upper[:-1], values[:-1], strict=True))):
            out = F.when(F.col("length") <= b, F.lit(v)).otherwise(out)
        return out.cast("long")

    dealt = sized.withColumn("bucket", by_bucket(upper)).withColumn("share", F.pmod(F.xxhash64(row), by_bucket(shares)))
    per = dealt.groupBy("bucket", "share").agg(F.count("*").alias("n"))
    # A running sum over the shares, of which there is one for each SHARE documents: the sums of blocks of shares come first.
    per = per.withColumn("block", F.expr("share div 1000"))
    blocks = per.groupBy("bucket", "block").agg(F.sum("n").alias("n"))
    ahead = Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    before_block = blocks.select("bucket", "block", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    in_block = per.select("bucket", "block", "share", F.coalesce(F.sum("n").over(ahead.partitionBy("bucket", "block")), F.lit(0)).alias("off"))
    first = in_block.join(before_block, ["bucket", "block"]).select("bucket", "share", (F.col("base") + F.col("off")).alias("first"))
    numbered = dealt.withColumn("in_share", F.row_number().over(Window.partitionBy("bucket", "share").orderBy("length", *kept, row)) - 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket")))).cast("long")
    at = F.col("first") + F.col("in_share")
    return (
        numbered.join(first, ["bucket", "share"])
        .withColumn("at", at)
        .withColumn("room", room)
        .select(
            *[F.col(n).alias(k) for k, n in zip(keep, kept, strict=True)],
            "length",
            "bucket",
            F.expr("at div room").alias("batch"),
            F.pmod("at", "room").alias("place"),
            (F.col("bucket") - F.col("length")).alias("padding"),
        )
    )
