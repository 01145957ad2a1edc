"""The answer of a search kept while rows arrive in batches: new sequences, and more of stored ones.

The store holds, by batch, what the batch added: positions, the sequences it touched, and
the occurrence ends of every node by sequence; and the nodes after the batch, with the items that each length admits.
Stored rows are never rewritten.  Appended itemsets come after all stored ones, so a
sequence's length, itemsets and utility so far are its high-water mark, and of a
stored utility list only two maxima count for what comes after: the largest utility, and the largest difference
of utility and the utility up to its end (remaining utility is that of the whole sequence less the latter).

A batch extends stored nodes by its own positions only, from the lists of the sequences that it
touches, and adds the changes of their terms.  Stored sequences are searched again only below nodes
that are extended for the first time, or for items that a length newly admits.  To make both
rare, nodes and items are taken into the tree from a ``margin`` below the threshold on, and
leave it twice as far below.  The answer after each batch is that of mining everything anew.

Tables by sequence are written by ``buckets`` of it, and a batch reads the buckets that it touches.  A batch
counts once its line in the manifest is written: one that broke off is done again, one that is
done is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..storage import cut, delete, steps
from .mine import BROADCAST_ROWS, Mined, grow

#: The hash of sid that deals out buckets: that of Spark's own shuffles, so that what is shuffled by sid into as many parts lies in buckets.
BUCKETS_BY = "murmur3"
NODE = ["parent", "inside", "item"]
ENDS = [*NODE, "sid", "tid", "k", "iu", "upto"]
#: Columns of the tables by sequence; sid has the type that it comes with.
TABLES = {
    "positions": "sid {}, tid int, k int, item int, util long, upto long",
    "sequences": "sid {}, su long, n int, sets int, su0 long",
    "ends": "parent long, inside boolean, item int, sid {}, tid int, k int, iu long, upto long",
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _beside(parts: list[DataFrame]) -> DataFrame:
    """The union of parts that lie in buckets of sid; it lies so, too, since the column that is united is its own."""
    return _union([p.withColumnRenamed("sid", "of_sid") for p in parts]).withColumnRenamed("of_sid", "sid")


class Maintained:
    """Mining at the ratio xi in a store of tables at path: add() takes raw(sid, tid, item, util), tid ordering a sequence's itemsets inside the batch."""

    def __init__(self, spark: SparkSession, path: str, xi: float, *, margin: float = 0.1, buckets: int | None = None, audit: bool = False):
        """buckets: of a new store, as many as shuffles have partitions if not given."""
        self.spark, self.path, self.xi, self.margin = spark, path.rstrip("/"), xi, margin
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: With audit: stored rows that each batch read, and rows that were stored before it.
        self.audit, self.read_rows, self.stored_rows = audit, {}, {}
        self.total, self.version, self.depth = 0, -1, {}
        if self._there(f"{self.path}/manifest"):
            for r in spark.read.parquet(f"{self.path}/manifest").orderBy("batch").collect():
                if "by" not in r or r["by"] != BUCKETS_BY:
                    raise ValueError("the store's buckets were dealt out by another hash")
                if r["batch"] == self.version + 1:
                    self.version, self.total, self.depth[r["batch"]] = r["batch"], r["total"], r["depth"]
                    if r["xi"] != xi or buckets not in (None, r["buckets"]):
                        raise ValueError("the store was made for another ratio or number of buckets")
                    self.buckets = r["buckets"]

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _bucket(self):
        return F.pmod(F.hash("sid"), F.lit(self.buckets)).cast("int")

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _held(self, df: DataFrame) -> DataFrame:
        """df held in buckets of sid while the batch is taken in."""
        return cut(df.repartition(self._parts(), "sid"), "sid")

    def _write(self, df: DataFrame, kind: str, batch: int, level: int | None = None, by_sequence: bool = True, lies: bool = False) -> DataFrame:
        """Write a batch's part of a table, and return it as read back.  lies: df was shuffled by sid, so that a task has rows of one bucket if there are as many."""
        at = f"{self.path}/{kind}/batch={batch}" + (f"/len={level}" if level else "")
        if by_sequence:
            schema = TABLES[kind].format(self.sid)
            df = df.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))])
        schema = df.schema
        if by_sequence:  # large buckets are split, small ones written by one task
            df = df.withColumn("bucket", self._bucket())
            df = df if lies and self.buckets == self._parts() else df.hint("rebalance", "bucket")
            df.write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(at)
        else:
            df.write.option("compression", "zstd").mode("overwrite").parquet(at)
        return self.spark.read.schema(schema).parquet(at).select(*schema.names)

    def _stored(self, kind: str, level: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """What all finished batches wrote, with its batch; of some buckets only, if they are given."""
        has = [b for b in range(self.version + 1) if not level or level <= self.depth[b]]
        paths = [x for b in has if self._there(x := f"{self.path}/{kind}/batch={b}" + (f"/len={level}" if level else ""))]
        if not paths or buckets == []:
            return None
        schema = f"{TABLES[kind].format(self.sid)}, batch int, len int, bucket int"
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)
        df = df if buckets is None else df.where(F.col("bucket").isin(buckets))
        if self.audit:
            self.read_rows[self.version + 1] = self.read_rows.get(self.version + 1, 0) + df.count()
        return df.drop("bucket", "len")

    def _last(self, kind: str, level: int | None = None) -> DataFrame | None:
        """A table as the last finished batch left it."""
        if self.version < 0 or level and level > self.depth[self.version]:
            return None
        at = f"{self.path}/{kind}/batch={self.version}" + (f"/len={level}" if level else "")
        return self.spark.read.parquet(at) if self._there(at) else None

    def answer(self) -> Mined:
        """The answer after the last finished batch."""
        out = Mined(self.xi * self.total, self.total)
        for level in range(1, self.depth.get(self.version, 0) + 1):
            out.levels.append(self._last("nodes", level).select("pat", "len", "u", "bound", "support"))
        return out

    def add(self, raw: DataFrame, batch: int | None = None) -> Mined:
        """Take in a batch and return the answer over all rows so far.  A batch that is stored already changes nothing."""
        now = self.version + 1 if batch is None else batch
        if now <= self.version:
            return self.answer()
        if now > self.version + 1:
            raise ValueError(f"batch {now} comes after batch {self.version}")
        self.sid = raw.schema["sid"].dataType.simpleString()
        with steps(self.spark):
            total, depth = self._search(raw, now)
        row = self.spark.createDataFrame([(self.xi, self.buckets, total, depth, BUCKETS_BY)], "xi double, buckets int, total long, depth int, by string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={now}")
        self.version, self.total, self.depth[now] = now, total, depth
        return self.answer()

    # ---- one batch

    def _fresh(self, raw: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
        """(positions that the batch adds, touched sequences: sid, su0 and su1 before and after, known), both held."""
        good = raw.where("util > 0 and sid is not null and tid is not null and item is not null")
        rows = cut(good.groupBy("sid", "tid", "item").agg(F.sum("util").cast("long").alias("util")))
        seen = rows.select("sid", self._bucket().alias("b"))
        marks = self._stored("sequences", buckets=sorted(r["b"] for r in seen.select("b").distinct().collect()))
        zero = lambda c: F.coalesce(c, F.lit(0))
        sids = rows.select("sid").distinct()
        if marks is None:
            state = sids.select("sid", F.lit(0).cast("long").alias("su0"), F.lit(0).alias("n0"), F.lit(0).alias("sets0"))
        else:
            marks = marks.join(sids, "sid", "left_semi").groupBy("sid").agg(F.max("su").alias("su0"), F.max("n").alias("n0"), F.max("sets").alias("sets0"))
            state = sids.join(marks, "sid", "left").select("sid", *[zero(F.col(c)).alias(c) for c in ("su0", "n0", "sets0")])
        order = Window.partitionBy("sid").orderBy("tid", "item")
        place = rows.join(state, "sid").select(
            "sid",
            (F.col("sets0") + F.dense_rank().over(Window.partitionBy("sid").orderBy("tid")) - 1).cast("int").alias("tid"),
            (F.col("n0") + F.row_number().over(order) - 1).cast("int").alias("k"),
            "item",
            "util",
            (F.col("su0") + F.sum("util").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long").alias("upto"),
        )
        fresh = self._write(place, "positions", now)
        ends = fresh.groupBy("sid").agg(F.max("upto").alias("su"), (F.max("k") + 1).alias("n"), (F.max("tid") + 1).alias("sets")).join(state.select("sid", "su0"), "sid")
        touched = self._write(ends, "sequences", now)
        return self._held(fresh), self._held(touched.select("sid", "su0", F.col("su").alias("su1"), (F.col("su0") > 0).alias("known")))

    def _search(self, raw: DataFrame, now: int) -> tuple[int, int]:
        """(total utility, length of the longest nodes) after the batch; writes all of the batch's tables."""
        for kind in ("positions", "sequences", "ends", "nodes", "items", "swu"):
            delete(self.spark, f"{self.path}/{kind}/batch={now}")
        if self.audit:
            self.read_rows[now] = 0
        fresh, touched = self._fresh(raw, now)
        known = touched.where("known").select("sid", self._bucket().alias("b"))
        buckets = sorted(r["b"] for r in known.select("b").distinct().collect())
        total = self.total + int(touched.agg(F.coalesce(F.sum(F.col("su1") - F.col("su0")), F.lit(0)).cast("long")).first()[0])
        theta, level, parents, sequences, swu = self.xi * total, 1, None, touched, None
        if self.audit:
            self.stored_rows[now] = sum(self.spark.read.parquet(f"{self.path}/{k}").where(F.col("batch") < now).count() for k in ("positions", "ends") if now)
        grown = fresh.select(F.lit(-1).cast("long").alias("parent"), F.lit(False).alias("inside"), "item", "sid", "tid", "k", F.col("util").alias("iu"), "upto")
        while True:
            ends = (grown if level == 1 else cut(grown, "sid")).select(*ENDS)
            self._write(ends, "ends", now, level, lies=True)
            lists = self._lists(level, parents, touched, buckets)
            merged = self._merged(ends, lists, sequences)
            if level == 1:
                swu = self._swu(merged, now)
            nodes = self._nodes(level, parents, merged, theta, now)
            kept_, first = nodes.agg(F.count_if(F.col("opened") < now), F.count_if(F.col("opened") == now)).first()
            if not kept_ and not first:
                return total, level
            admitted, newly, before = self._items(level + 1, swu, theta, now)
            small = kept_ + first <= BROADCAST_ROWS
            parents = nodes.where("opened is not null").select("id", *NODE, "pat", "opened")
            parents = F.broadcast(parents) if small else parents
            grown, late = self._children(level, parents, kept_, first, fresh, ends, lists, admitted, newly, before, now)
            if late and sequences is touched:
                sequences = self._all_sequences(touched)
            if grown is None:
                return total, level
            level += 1

    def _valid(self, ends: DataFrame, parents: DataFrame | None) -> DataFrame:
        """Stored ends of nodes whose parent is extended, and has been since before they were written."""
        if parents is None:
            return ends.drop("batch")
        since = parents.select(F.col("id").alias("parent"), "opened")
        return ends.join(since, "parent").where(F.col("batch") >= F.col("opened")).select(*ENDS)

    def _lists(self, level: int, grandparents: DataFrame | None, touched: DataFrame, buckets: list[int]) -> DataFrame | None:
        """top0 and lead0 of the stored lists of touched sequences (held)."""
        stored = self._stored("ends", level, buckets)
        if stored is None:
            return None
        mine = self._valid(stored.join(touched.where("known").select("sid"), "sid", "left_semi"), grandparents)
        return self._held(mine.groupBy(*NODE, "sid").agg(F.max("iu").alias("top0"), F.max(F.col("iu") - F.col("upto")).alias("lead0")))

    def _merged(self, ends: DataFrame, lists: DataFrame | None, sequences: DataFrame) -> DataFrame:
        """Each list that the batch changes, as it was (top0, lead0; null if new) and what came to it (top1, lead1), with su0 and su1."""
        new = ends.groupBy(*NODE, "sid").agg(F.max("iu").alias("top1"), F.max(F.col("iu") - F.col("upto")).alias("lead1"))
        none = F.lit(None).cast("long")
        rows = new.select(*NODE, "sid", none.alias("top0"), none.alias("lead0"), "top1", "lead1")
        if lists is not None:
            old = lists.select(*NODE, "sid", "top0", "lead0", none.alias("top1"), none.alias("lead1"))
            rows = _beside([rows, old]).groupBy(*NODE, "sid").agg(*[F.max(c).alias(c) for c in ("top0", "lead0", "top1", "lead1")])
        return rows.join(sequences, "sid")

    def _swu(self, merged: DataFrame, now: int) -> DataFrame:
        gain = F.when(F.col("top0").isNull(), F.col("su1")).otherwise(F.col("su1") - F.col("su0"))
        parts = [merged.select("item", gain.alias("swu"))]
        if (old := self._last("swu")) is not None:
            parts.append(old)
        return self._write(_union(parts).groupBy("item").agg(F.sum("swu").cast("long").alias("swu")), "swu", now, by_sequence=False)

    def _nodes(self, level: int, parents: DataFrame | None, merged: DataFrame, theta: float, now: int) -> DataFrame:
        """The nodes of a length after the batch, written: those below extended nodes, with their terms, and in which batch they were extended (opened)."""
        fresh_list = F.col("top0").isNull()
        top = F.greatest(F.coalesce("top0", F.lit(0)), F.coalesce("top1", F.lit(0))) - F.coalesce("top0", F.lit(0))
        bound = F.col("su1") + F.greatest("lead0", "lead1") - F.when(fresh_list, F.lit(0)).otherwise(F.col("su0") + F.col("lead0"))
        gained = merged.groupBy(*NODE).agg(F.sum(top).alias("u"), F.sum(bound).alias("bound"), F.count_if(fresh_list).alias("support"))
        none = F.lit(None)
        parts = [gained.select(*NODE, none.cast("long").alias("id"), none.cast("int").alias("opened"), "u", "bound", "support")]
        if (old := self._last("nodes", level)) is not None:
            parts.append(old.select(*NODE, "id", "opened", "u", "bound", "support"))
        added = _union(parts).groupBy(*NODE).agg(F.max("id").alias("id"), F.max("opened").alias("opened"), *[F.sum(c).cast("long").alias(c) for c in ("u", "bound", "support")])
        item = F.col("item").cast("string")
        if parents is None:
            named = added.withColumn("pat", item)
        else:
            named = added.join(parents.select(F.col("id").alias("parent"), F.col("pat").alias("start")), "parent")
            named = named.withColumn("pat", F.concat("start", F.when(F.col("inside"), F.lit(",")).otherwise(F.lit(")(")), item))
        need, was = F.lit(theta) * (level + 1), F.col("opened").isNotNull()
        keep = was & (F.col("bound") >= need * (1 - 2 * self.margin))
        first = ~was & (F.col("bound") >= need * F.when(F.col("id").isNull(), F.lit(1 - self.margin)).otherwise(F.lit(1.0)))
        # a number of 48 bits in the batch, below the batch's own
        own = F.lit((now + 1) << 48) + F.monotonically_increasing_id()
        done = named.select(F.coalesce("id", own).alias("id"), *NODE, "pat", F.lit(level).alias("len"), "u", "bound", "support", F.when(keep, F.col("opened")).when(first, F.lit(now)).alias("opened"))
        return self._write(done, "nodes", now, level, by_sequence=False)

    def _items(self, level: int, swu: DataFrame, theta: float, now: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(items that nodes of a length may end in, those of them that are new to it, those that aren't); None where there are none."""
        before = self._last("items", level)
        enough = lambda share: swu.where(F.col("swu") >= F.lit(theta * level * share)).select("item")
        if before is None:
            return self._write(enough(1 - self.margin), "items", now, level, by_sequence=False), None, None
        newly = cut(enough(1.0).join(before, "item", "left_anti"))
        return self._write(before.unionByName(newly), "items", now, level, by_sequence=False), None if newly.isEmpty() else newly, before

    def _children(self, level, parents, kept_, first, fresh, ends, lists, admitted, newly, before, now) -> tuple[DataFrame | None, bool]:
        """(ends of the next length that come to the store, whether stored sequences are searched again)."""
        named = parents.select(F.col("id"), *NODE, "opened")
        of = lambda rows, test: rows.join(named.where(test), NODE).select(F.col("id").alias("parent"), "sid", "tid", "k", "iu")
        old, again = F.col("opened") < now, F.col("opened") == now
        out, late = [], False
        if kept_ and before is not None:
            carried = [of(ends, old)]
            if lists is not None:  # of all stored ends, the best one counts, before any new position
                carried.append(of(lists.select(*NODE, "sid", F.lit(-1).alias("tid"), F.lit(-1).alias("k"), F.col("top0").alias("iu")), old))
            out.append(grow(_beside(carried), fresh.join(before, "item", "left_semi"), "sid", held=True))
        if first or kept_ and newly is not None:
            stored, positions = self._stored("ends", level), self._stored("positions")
            every = ends if stored is None else ends.unionByName(self._valid(stored, self._grandparents(level)))
            places = fresh if positions is None else fresh.unionByName(positions.drop("batch"))
            late = stored is not None
            if first:
                out.append(grow(of(every, again), places.join(admitted, "item", "left_semi"), "sid"))
            if kept_ and newly is not None:
                new = places.join(F.broadcast(newly), "item", "left_semi")
                out.append(grow(of(every.join(new.select("sid").distinct(), "sid", "left_semi"), old), new, "sid"))
        return (_beside([x.select(*ENDS) for x in out]) if out else None), late

    def _grandparents(self, level: int) -> DataFrame | None:
        """The extended nodes above a length, as this batch has just written them."""
        if level == 1:
            return None
        at = f"{self.path}/nodes/batch={self.version + 1}/len={level - 1}"
        return self.spark.read.parquet(at).where("opened is not null").select("id", "opened")

    def _all_sequences(self, touched: DataFrame) -> DataFrame:
        """su0 and su1 of every sequence (held)."""
        stored = self._stored("sequences")
        others = stored.groupBy("sid").agg(F.max("su").alias("su0")).join(touched, "sid", "left_anti")
        return cut(touched.unionByName(others.select("sid", "su0", F.col("su0").alias("su1"), F.lit(True).alias("known"))))
