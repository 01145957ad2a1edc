"""Answers that stay exact while the database grows in batches.

A batch adds sequences, or appends itemsets to stored ones: appended itemsets
come after all stored ones of their sequence, never inside them.  rem is always
derived from su, so stored positions need no rewrite.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import cut, written
from .mine import BROADCAST_ROWS, Mined, evaluate, grow_named, held_dealt, held_front, item_swu, mine, positions, roots, total_utility


# ---- schedules


def ratio_bounds(n: int, ratios: list[float], how: str = "round") -> list[int]:
    """Upper row numbers of batches; the last takes the remainder.  how: round (half up) or floor."""
    sizes = [int(n * r + 0.5) if how == "round" else int(n * r) for r in ratios[:-1]]
    return [min(n, x) for x in accumulate(sizes)] + [n]


def equal_schedule(k: int) -> list[float]:
    return [1 / k] * k


def warm_schedule(k: int, first: float) -> list[float]:
    return [first] + [(1 - first) / (k - 1)] * (k - 1)


def with_batch(raw: DataFrame, ratios: list[float], how: str = "round") -> DataFrame:
    """raw with batch_id: sequences in order of sid are dealt out by the ratios.

    No task sorts them all.
    """
    sids = raw.select("sid").distinct()
    numbered = ranked(sids, "sid")
    bounds = ratio_bounds(numbered.count(), ratios, how)
    batch = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        batch = F.when(F.col("number") < bounds[i], F.lit(i)).otherwise(batch)
    return raw.join(numbered.select("sid", batch.cast("int").alias("batch_id")), "sid")


def ranked(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with number, its rows' global position in the order, from 0.

    Ranges of the order (at sampled quantiles) are written, so that they stay; their counts give each
    range's first number.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranked")
    rows, before = [], 0
    for r in sorted(dealt.groupBy("range").count().collect()):
        rows.append((r["range"], before))
        before += r["count"]
    first = F.broadcast(df.sparkSession.createDataFrame(rows, "range int, first long"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.join(first, "range").withColumn("number", F.col("first") + inside).drop("range", "first")


# ---- appended sequences


def numbered_parts(raw: DataFrame) -> DataFrame:
    """raw(sid, batch_id, part_seq, tid, item, util) -> raw with tid over the whole sequence: parts in order of (batch_id, part_seq), each opening new itemsets."""
    order = Window.partitionBy("sid").orderBy("batch_id", "part_seq", "tid")
    return raw.withColumn("tid", (F.dense_rank().over(order) - 1).cast("int")).drop("part_seq")


def swu_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each item's SWU between the positions of touched sequences before and after: a known item gains u(A), a new one u(S')."""
    old = before.select("sid", "item", "su").distinct().groupBy("item").agg(F.sum(-F.col("su")).alias("d"))
    new = after.select("sid", "item", "su").distinct().groupBy("item").agg(F.sum("su").alias("d"))
    return old.unionAll(new).groupBy("item").agg(F.sum("d").cast("long").alias("delta"))


def root_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each item's utility, bound and support over touched sequences."""

    def terms(pos: DataFrame, sign: int) -> DataFrame:
        per = pos.groupBy("item", "sid").agg(F.max("util").alias("u"), F.max(F.col("util") + F.col("rem")).alias("b"))
        return per.select("item", (sign * F.col("u")).alias("u"), (sign * F.col("b")).alias("b"), F.lit(sign).alias("n"))

    both = terms(before, -1).unionAll(terms(after, 1))
    return both.groupBy("item").agg(F.sum("u").cast("long").alias("d_u"), F.sum("b").cast("long").alias("d_bound"), F.sum("n").cast("long").alias("d_support"))


def touched(old: DataFrame, batch: DataFrame) -> DataFrame:
    return old.join(batch.select("sid").distinct(), "sid", "left_semi")


def append(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored raw rows with a batch's rows appended in place: the prefix form, stored rows unchanged."""
    last = old.groupBy("sid").agg((F.max("tid") + 1).alias("base"))
    inside = F.dense_rank().over(Window.partitionBy("sid").orderBy("tid")) - 1
    moved = batch.withColumn("inside", inside).join(last, "sid", "left").select("sid", (F.coalesce("base", F.lit(0)) + F.col("inside")).cast("int").alias("tid"), "item", "util")
    return old.select("sid", "tid", "item", "util").unionByName(moved)


def rewrite(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The same database in the rewrite form: touched sequences are taken out whole and put back longer."""
    still = old.join(batch.select("sid").distinct(), "sid", "left_anti").select("sid", "tid", "item", "util")
    return still.unionByName(append(touched(old, batch), batch))


def maintenance_counts(old: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: positions that the prefix and the rewrite form write, sequences touched and new."""
    mine_ = batch.select("sid").distinct()
    seen = mine_.join(old.select("sid").distinct(), "sid", "left_semi").count()
    appended = batch.count()
    rewritten = old.join(mine_, "sid", "left_semi").count() + appended
    return old.sparkSession.createDataFrame([(appended, rewritten, seen, mine_.count() - seen)], "prefix_positions long, rewrite_positions long, touched long, new_sequences long")


def root_entries(pos: DataFrame) -> DataFrame:
    """One row: entries of all single items' lists, one for each position."""
    return pos.agg(F.count("*").alias("root_entries"))


# ---- what a batch changes


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each pattern of either set: kept, promoted or demoted."""
    b, a = before.select("pattern"), after.select("pattern")
    say = lambda df, what: df.select("pattern", F.lit(what).alias("status"))
    return say(b.join(a, "pattern", "left_semi"), "kept").unionAll(say(a.join(b, "pattern", "left_anti"), "promoted")).unionAll(say(b.join(a, "pattern", "left_anti"), "demoted"))


def batch_candidates(old: DataFrame, batch: DataFrame, xi: float) -> Mined:
    """Patterns that may be promoted by a batch of new sequences: the batch mined at xi of its own utility, over items whose SWU in the whole reaches 2 theta'."""
    whole = positions(old.unionByName(batch))
    theta = xi * total_utility(whole)
    good = item_swu(whole).where(F.col("swu") >= 2 * theta).select("item")
    threshold = xi * total_utility(positions(batch))
    return mine(positions(batch.join(good, "item", "left_semi")), theta=threshold)


# ---- pattern state: pre-large patterns kept across batches


def safety(xi: float, mu: float, total_at_rescan: int) -> tuple[float, float]:
    """(lower threshold ratio, utility that may arrive before a rescan)."""
    lower = max(1e-4, xi * (1 - mu))
    return lower, (xi - lower) / max(1e-12, 1 - xi) * total_at_rescan


def follow(pos: DataFrame, names: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """Length by length, the occurrence ends in dealt positions (mine.held_dealt) of the patterns names(pat) and of their prefixes; nothing else is followed."""
    ways = names.select("pat", F.explode(prefixes(F.col("pat"))).alias("way"))
    paths = cut(ways.groupBy(F.col("way").alias("pat")).agg(F.max(F.col("way") != F.col("pat")).alias("inner"), F.max(F.size(F.regexp_extract_all("way", F.lit("[0-9]+"), F.lit(0)))).alias("len")))
    count, longest = paths.agg(F.count("*"), F.max("len")).first()
    at = lambda rows: F.broadcast(rows.select("pat")) if count <= BROADCAST_ROWS else rows.select("pat")
    front = roots(pos).join(at(paths.where("len = 1")), "pat", "left_semi")
    for n in range(1, (longest or 0) + 1):
        yield n, front
        if n < longest:
            ends = front.join(at(paths.where(F.col("inner") & (F.col("len") == n))), "pat", "left_semi")
            front = held_front(grow_named(ends, pos, held=True).join(at(paths.where(F.col("len") == n + 1)), "pat", "left_semi"), count)


def delta_nodes(pos: DataFrame, names: DataFrame) -> DataFrame:
    """u, bound and support over pos of the patterns in names(pat, len) only: their prefixes guide the search."""
    known = cut(names.select("pat", "len"))
    found = [evaluate(front).select("pat", F.lit(n).alias("len"), "u", "bound", "support") for n, front in follow(held_dealt(cut(pos)), known)]
    empty = known.where("false").select("pat", "len", *[F.lit(0).cast("long").alias(c) for c in ("u", "bound", "support")])
    return reduce(DataFrame.unionByName, found, empty).join(known.select("pat"), "pat", "left_semi")


def decisions(sizes: list[int], xi: float, mu: float) -> list[dict]:
    """Of batches of these utilities, which ask for a rescan: the first, and those that don't fit into the safety utility since the last.  No pattern decides that."""
    at_rescan, held, total, log = None, 0, 0, []
    for b, size in enumerate(sizes):
        total += size
        room = 0.0 if at_rescan is None else safety(xi, mu, at_rescan)[1]
        rescan = at_rescan is None or held + size > room
        log.append({"batch_id": b, "rescan": rescan, "safety": room, "buffer": held + size})
        at_rescan, held = (total, 0) if rescan else (at_rescan, held + size)
    return log


def batch_sizes(raw: DataFrame, batches: int) -> list[int]:
    """The utility of each batch of raw(batch_id, ...), over the rows that positions() keeps."""
    good = raw.where("util > 0 and sid is not null and tid is not null and item is not null")
    found = dict(good.where(F.col("batch_id").between(0, batches - 1)).groupBy("batch_id").agg(F.sum("util").cast("long")).collect())
    return [found.get(b, 0) for b in range(batches)]


def prelarge(raw: DataFrame, xi: float, mu: float, batches: int) -> tuple[DataFrame, list[dict]]:
    """Pre-large maintenance over batches of new sequences.

    Returns the pattern state (pat, len, u, bound, support, large) after the
    last batch and a decision per batch.  A batch that fits into the safety
    utility only updates stored patterns; otherwise everything is mined anew at
    the lower ratio, and nodes are kept that reach it or lead to one that does.
    """
    sizes = batch_sizes(raw, batches)
    log, lower, state, total = decisions(sizes, xi, mu), safety(xi, mu, 0)[0], None, 0
    for b, size in enumerate(sizes):
        total += size
        if log[b]["rescan"]:
            whole = positions(raw.where(F.col("batch_id") <= b))
            found = mine(whole, theta=lower * total)
            nodes = found.nodes()
            good = nodes.where(F.col("u") >= F.lit(lower * total) * F.col("len")).select("pat")
            # every prefix of a kept pattern is kept
            ways = good.select(F.explode(prefixes(F.col("pat"))).alias("pat")).distinct()
            state = cut(nodes.join(ways, "pat", "left_semi"))
        else:
            gain = delta_nodes(positions(raw.where(F.col("batch_id") == b)), state)
            state = state.unionByName(gain).groupBy("pat", "len").agg(F.sum("u").cast("long").alias("u"), F.sum("bound").cast("long").alias("bound"), F.sum("support").cast("long").alias("support"))
            state = cut(state)
    return state.withColumn("large", F.col("u") >= F.lit(xi * total) * F.col("len")), log


def prefixes(pat):
    """All prefixes of a pattern that end after an item."""
    parts = F.regexp_extract_all(pat, F.lit(r"(?:\)\(|,)?[0-9]+"), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ""))
