"""Document fingerprints by winnowing.

A text is reduced to its letters and digits (A-Z lower-cased, other ASCII
dropped).  Every run of ``K`` characters gets a rolling hash; of every
``WINDOW`` consecutive hashes the smallest is chosen, the rightmost of equal
ones, and kept with the position of its first character in the text.  Two texts
that share ``K + WINDOW - 1`` reduced characters share a chosen hash, and no
match shorter than ``K`` counts.

A text with fewer than ``WINDOW`` hashes is one window, and one with fewer than
``K`` characters is one run.  A text without letters and digits, or null, has
an empty fingerprint; two empty fingerprints are alike (1.0), an empty and
another are not (0.0).  Long texts are hashed in pieces that overlap, so memory
stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, ship

K, WINDOW = 16, 16
PIECE = 1 << 20
#: Hashes of a batch of results.
OUT = 1 << 17
MULT, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
KEEP = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(128)], np.uint64)


def _powers(n: int) -> dict[int, np.uint64]:
    out, p, size = {}, MULT, 1
    with np.errstate(over="ignore"):
        while size < n:
            out[size] = p
            p, size = p * p, size * 2
    return out


POWERS = _powers(K)


def _rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n (a power of two) consecutive values, by doubling."""
    size = 1
    while size < n:
        x = x[:-size] * POWERS[size] + x[size:]
        size *= 2
    return x


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n (a power of two) consecutive values, by doubling."""
    size = 1
    while size < n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x


def winnow(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from a text, in order of position."""
    chars = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    low = chars < 128
    code = np.where(low, KEEP[np.where(low, chars, 0)], chars.astype(np.uint64))
    place = np.flatnonzero(code)
    code = code[place] + np.uint64(1)
    if not len(code):
        return np.zeros(0, np.uint32), place
    with np.errstate(over="ignore"):
        if len(code) < K:
            h = np.uint64(0)
            for c in code:
                h = h * MULT + c
            return np.array([(h ^ (h >> np.uint64(29))) * MIX >> np.uint64(32)], np.uint32), place[:1]
        grams = len(code) - K + 1
        span = min(WINDOW, grams)
        chosen, last = [], -1
        for lo in range(0, grams - span + 1, PIECE):
            hi = min(lo + PIECE, grams - span + 1)
            h = _rolling(code[lo : hi + span - 1 + K - 1], K)
            h = (h ^ (h >> np.uint64(29))) * MIX
            # hash above, and below it what is smaller further right: the minimum is the rightmost smallest hash
            both = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h) - 1, -1, -1).astype(np.uint64)
            least = _least(both, span) if span == WINDOW else both.min(keepdims=True)
            new = least[np.concatenate([[True], least[1:] != least[:-1]])]
            at = lo + len(h) - 1 - (new & np.uint64(0xFFFFFFFF)).astype(np.int64)
            fresh = at > last
            chosen.append((new[fresh] >> np.uint64(32), at[fresh]))
            last = int(at[-1])
    return np.concatenate([c for c, _ in chosen]).astype(np.uint32), place[np.concatenate([a for _, a in chosen])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sets of hashes (sorted, distinct)."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_string(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits a hash, ascending."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``hashes`` and ``positions`` (code points) of each text, in order of position."""
    if clash := {k.lower() for k in keep} & {"hashes", "positions"}:
        raise ValueError(f"kept columns clash with result columns: {sorted(clash)}")
    name = free_name(keep, "body")
    source = docs.select(*keep, F.col(text).cast("string").alias(name))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != name), "hashes array<bigint>, positions array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(name)
            got = [winnow(x) for x in batch.column(at).to_pylist()]
            rest = [(f.name, c) for i, (f, c) in enumerate(zip(batch.schema, batch.columns, strict=True)) if i != at]
            lists = [pa.array([x[k].astype(np.int64) for x in got], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *lists], names=[*(n for n, _ in rest), "hashes", "positions"])

    return source.mapInArrow(run, schema)


def _order_keys(hot: list[int], text: Column) -> tuple[Column, Column]:
    """Strings that sort like descending doc_id, and after them those of null ids; ids in ``hot`` and nulls are told apart by their text's hash."""
    sixteen = lambda x: F.lpad(F.hex(x), 16, "0")
    by_text = sixteen(F.xxhash64(text).bitwiseXOR(F.lit(-(2**63))))
    of_id = F.concat(F.lit("0"), sixteen(F.col("doc_id").bitwiseXOR(F.lit(2**63 - 1))))
    if hot:
        of_id = F.when(F.col("doc_id").isin(hot), F.concat(of_id, by_text)).otherwise(of_id)
    return of_id, F.concat(F.lit("1"), by_text)


def _deal(source: DataFrame, cuts: int) -> tuple[Column, Column]:
    """(key, range) of a row: about ``cuts`` ranges of the order, each of a like number of rows.

    Ranges begin at quantiles of doc_id.  Where many rows share one doc_id, or
    have none, their ranges begin at even steps of the hash of the text.
    """
    total, top, none = source.agg(F.count("*"), F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 100_000), F.count_if(F.col("doc_id").isNull())).first()
    times: dict[int, int] = {}
    for x in top or []:
        times[x] = times.get(x, 0) + 1
    hot = sorted(x for x, n in times.items() if n > 1)
    steps = lambda n: [f"{(k << 64) // n:016X}" for k in range(1, n)]
    of_id = lambda x: f"0{x ^ (2**63 - 1):016X}"
    bounds = [b for x, n in times.items() for b in ([of_id(x)] if n == 1 else [of_id(x) + y for y in ["", *steps(n + 1)]])]
    if none:
        bounds += ["1" + y for y in ["", *steps(max(1, cuts * none // total))]]
    some, null = _order_keys(hot, F.col("text"))
    key = F.when(F.col("doc_id").isNull(), null).otherwise(some) if none else some
    # the number of bounds up to the key, bit by bit from the highest: a binary search without Python
    bounds.sort()
    listed = F.split(F.lit(",".join(bounds)), ",")
    powers = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))] or [F.lit(0)])
    at = F.aggregate(powers, F.lit(0), lambda n, p: F.when((n + p <= len(bounds)) & (F.get(listed, n + p - 1) <= F.col("key")), n + p).otherwise(n))
    return key, at if bounds else F.lit(0)


def compare_with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text edited with the next one, and of the next one.

    Documents go round in descending order of doc_id (nulls last, ties in an
    order of the text's hash, then by text), and the last one's next is the
    first.  The order is dealt into ranges; the first row of a range is also sent to the
    range before it, so texts are shuffled once and every range is streamed by
    itself.  ``positions`` are the places (code points) at which the hashes of the
    fingerprint stand first, hash by hash.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    key, at = _deal(source, 4 * parts)
    keyed = source.withColumn("key", key).withColumn("range", at)
    firsts = sorted((r["range"], r["first"]) for r in keyed.groupBy("range").agg(F.min("key").alias("first")).collect())
    heads, before = [""] * (1 + max([r for r, _ in firsts], default=0)), ["0"] * (1 + max([r for r, _ in firsts], default=0))
    for k, (r, first) in enumerate(firsts):
        heads[r], before[r] = first, str(firsts[k - 1][0])
    by_range = lambda values: F.get(F.split(F.lit(",".join(values)), ","), F.col("range"))
    closes = F.when(by_range(heads) == F.col("key"), by_range(before).cast("int"))
    return _stream(keyed, closes, parts)


def _stream(keyed: DataFrame, closes: Column, parts: int) -> DataFrame:
    own = F.struct(F.col("range"), F.lit(0).alias("closes"))
    both = F.filter(F.array(own, F.struct(closes.alias("range"), F.lit(1).alias("closes"))), lambda x: x["range"].isNotNull())
    dealt = keyed.select("doc_id", "text", "key", F.inline(both).alias("range", "closes"))
    order = [F.col("range"), F.col("closes"), F.col("key"), F.col("text")]
    dealt = dealt.repartition(parts, "range").sortWithinPartitions(*order)
    fields = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "positions": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def pair(now: tuple, after: tuple) -> int:
            number, body, own, places = now
            n = len(body)
            edited = body[: n - n // 2] + after[1][: n // 2]
            other = np.unique(winnow(edited)[0])
            rows.append((number, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), as_string(own), as_string(other), likeness(own, other), likeness(own, after[2]), places))
            return len(own) + len(other)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))
            rows.clear()
            return out

        now, here, closed, size = None, None, False, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for k in range(batch.num_rows):
                r = columns[2][k].as_py()
                if r != here:
                    now, here, closed = None, r, False
                if closed:
                    continue
                body = columns[1][k].as_py()
                hashes, places = winnow(body)
                own, first = np.unique(hashes, return_index=True)
                this = (columns[0][k].as_py(), body, own, places[first].astype(np.int32))
                if now is not None:
                    size += pair(now, this)
                now, closed = this, columns[3][k].as_py() == 1
                if size >= OUT:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return dealt.select("doc_id", "text", "range", "closes").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>")


ship(__name__)
