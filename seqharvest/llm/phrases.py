"""Phrase collocations: contiguous pattern growth from projected prefixes.

A text is split at punctuation and line ends into pieces, a piece at spaces into words.
Phrases are grown to the right, and only from frequent ones.  Words are counted first, then pairs
of frequent words, by their hashes only, which finds all frequent ones.  Every occurrence of such a pair
is a pointer into its text: it is projected to the words that follow, as far as
each two in a row are such a pair, and equal projections are added up before and
after the shuffle; their sums are the exact counts of pairs.  The projections of a prefix go to one task, which sorts
them and extends the prefix to the right, depth first.  A prefix of more than ``ROWS`` projections is
extended by one word by a distributed count instead, and its longer prefixes have tasks of their own, so no task
is larger than the bound, whatever a prefix's share of the corpus.

Mappers know frequent words and pairs by a bitmap of fixed size, of their hashes: it passes all of
them, and what else it lets through is counted exactly like the rest and dropped by its count.

Defined results: a null text is empty, a null language ``und``; repeated rows count as often as they
occur; an empty table gives no rows.  Words are told apart by their bytes after A-Z are lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import steps, written
from .common import ship

LEAST, LONGEST, TOP, ABSORBED = 100, 5, 2_000, 100
#: Projections of a prefix up to which one task grows it.
ROWS = 20_000
#: log2 of the bits of a bitmap of frequent words or pairs.
BITS = 26
#: High bits of a hash that pairs are counted by: as many as a small key has room for.
KEPT = 40
#: Words and bytes of distinct words that a mapper gathers before it emits, and bytes of text split at once.
CHUNK, ROOM, BLOCK = 1_000_000, 1 << 25, 1 << 22
#: Words that a mapper knows to be rare or frequent, and rows that it adds up before it emits them.
RARE, HELD = 300_000, 1_500_000
#: Shares of a language in the first choice of its best phrases.
SHARES = 32

#: No byte of UTF-8: stands for the end of a piece.
END = b"\xff"
TABLE = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
BREAK = re.compile(rb"[ \xff]")


class Numbers(dict):
    """Word -> number in order of appearance; END is 0.  It is given up when it holds ``ROOM`` bytes."""

    def __init__(self):
        super().__init__({END: 0})
        self.words, self.size = [END], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.size += len(word)
        return n


class Frequent(Numbers):
    """Word -> number of the words that a bitmap lets through, with their hashes.  All others are 0, as ends are, for no phrase holds them."""

    def __init__(self, lang: str, bits: np.ndarray, width: int):
        super().__init__()
        self.seed, self.bits, self.down, self.hashes = xxhash.xxh64_intdigest(lang.encode()), bits, 64 - width, [0]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= RARE:  # forget the rare ones
            kept = {w: n for w, n in self.items() if n or w == END}
            self.clear()
            self.update(kept)
        h = xxhash.xxh64_intdigest(word, self.seed)
        slot = h >> self.down
        if not int(self.bits[slot >> 6]) >> (slot & 63) & 1:
            self[word] = 0
            return 0
        self.hashes.append(h)
        return super().__missing__(word)


def _blocks(body: bytes) -> Iterator[bytes]:
    """A text with marked ends of pieces, in parts of about BLOCK bytes that end before a space or mark."""
    body, lo = body.translate(TABLE), 0
    while len(body) - lo > BLOCK and (cut := BREAK.search(body, lo + BLOCK)):
        yield body[lo : cut.start()]
        lo = cut.start()
    yield body[lo:]


def chunks(batches: Iterator[pa.RecordBatch], ahead: int, numbers: Callable[[str], Numbers] | None = None) -> Iterator[tuple[str, np.ndarray, int, Numbers]]:
    """(language, word numbers with 0 between pieces, numbers that phrases may start at, the language's numbers) of batches (lang, text).

    Phrases of up to ahead + 1 words that start before the bound lie within the numbers; a long text is cut with so many words of overlap.
    Numbers are made by language, and hold for all chunks until they are replaced by new ones.
    """
    known: dict[str, Numbers] = {}
    held: dict[str, list[np.ndarray]] = {}
    size = 0
    make = numbers or (lambda _: Numbers())
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, body in zip(langs, batch.column(1).cast(pa.binary())):
            for block in _blocks(body.as_py()):
                own = known[lang] if lang in known else known.setdefault(lang, make(lang))
                marked = block.replace(END, b" \xff ").split()
                ids = np.fromiter(map(own.__getitem__, marked), np.int64, len(marked))
                held.setdefault(lang, []).append(ids)
                size += len(ids)
                if size < CHUNK and own.size < ROOM:
                    continue
                # within a text: the last words are carried over, as starts of phrases that go on
                rest = np.zeros(0, np.int64)
                for x, parts in held.items():
                    whole = np.concatenate(parts)
                    over = min(ahead, len(whole)) if x == lang else 0
                    rest = whole[len(whole) - over :] if x == lang else rest
                    yield x, whole, len(whole) - over, known[x]
                if own.size >= ROOM:
                    words = [own.words[i] for i in rest]
                    own = known[lang] = make(lang)
                    rest = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
                held, size = {lang: [rest]}, len(rest)
            held.setdefault(lang, []).append(np.zeros(1, np.int64))
            size += 1
    for lang, parts in held.items():
        ids = np.concatenate(parts)
        yield lang, ids, len(ids), known.setdefault(lang, make(lang))


def paired(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hashes of pairs from those of their words."""
    with np.errstate(over="ignore"):
        h = (one * np.uint64(0x9E3779B97F4A7C15) ^ (other + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def passes(bits: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    slot = h >> np.uint64(64 - width)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def bitmap(hashes: DataFrame, width: int) -> np.ndarray:
    """Bits of the hashes (column h, the high ``KEPT`` bits of one), 2**width of them, merged by Spark; the driver gets 2**width / 64 rows at most."""
    slot = F.shiftrightunsigned("h", KEPT - width)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.select(F.shiftrightunsigned(slot, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (width - 6), np.uint64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _word_hashes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [xxhash.xxh64_intdigest(w.encode(), xxhash.xxh64_intdigest(lang.encode())) >> (64 - KEPT) for lang, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], names=["h"])

    return words.select("lang", "w1").mapInArrow(run, "h long")


def _strings(words: list[bytes], at: np.ndarray) -> pa.Array:
    """Words by number as strings; 0 is null."""
    used, place = np.unique(at, return_inverse=True)
    return pa.array([words[i].decode() if i else None for i in used], pa.string()).take(pa.array(place.reshape(at.shape)))


def added(rows: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their summed counts.  Rows of several columns hold numbers of 31 bits."""
    keys = [rows[:, 0]] if rows.shape[1] == 1 else [sum(rows[:, j].astype(np.int64) << 32 * (1 - k) for k, j in enumerate(range(i, min(i + 2, rows.shape[1])))) for i in range(0, rows.shape[1], 2)]
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for key in keys:
        key = key[order]
        change[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(change)
    return rows[order[first]], np.add.reduceat(c[order], first) if len(first) else c


def _counted(batches: Iterator[pa.RecordBatch], ahead: int, numbers, count: Callable) -> Iterator[tuple[str, Numbers, np.ndarray, np.ndarray]]:
    """(language, its numbers, rows, how often) of count(numbers, ids, starts) -> rows of a chunk; rows are added up over chunks while that keeps them below ``HELD``."""
    held: dict[str, tuple[Numbers, list[np.ndarray], list[np.ndarray]]] = {}

    def summed(parts) -> tuple[np.ndarray, np.ndarray]:
        return (parts[1][0], parts[2][0]) if len(parts[1]) == 1 else added(np.concatenate(parts[1]), np.concatenate(parts[2]))

    for lang, ids, starts, own in chunks(batches, ahead, numbers):
        rows = count(own, ids, starts)
        if lang in held and held[lang][0] is not own:
            yield lang, held[lang][0], *summed(held.pop(lang))
        parts = held.setdefault(lang, (own, [], []))
        for column, x in zip(parts[1:], added(rows, np.ones(len(rows), np.int64))):
            column.append(x)
        if sum(map(len, parts[2])) >= HELD:
            rows, c = summed(held.pop(lang))
            if len(c) >= HELD // 2:
                yield lang, own, rows, c
            else:
                held[lang] = (own, [rows], [c])
    for lang, parts in held.items():
        yield lang, parts[0], *summed(parts)


def _mapped(source: DataFrame, ahead: int, numbers, count: Callable, schema: str) -> DataFrame:
    """Rows (lang, words, c) of _counted(), whose rows are word numbers."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own, rows, c in _counted(batches, ahead, numbers, count):
            for lo in range(0, len(c), 100_000):
                at = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c[at]), pa.string()), *(_strings(own.words, x) for x in rows[at].T), pa.array(c[at], pa.int64())], names=names)

    return source.mapInArrow(run, schema)


def _words(own: Numbers, ids: np.ndarray, starts: int) -> np.ndarray:
    return ids[:starts][ids[:starts] != 0][:, None]


def _frequent(bits, width: int) -> Callable[[str], Numbers]:
    return lambda lang: Frequent(lang, bits.value, width)


def _pairs_of(own: Frequent, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.array(own.hashes, np.uint64)
    return paired(h[ids[at]], h[ids[at + 1]])


def _pair_hashes(source: DataFrame, word_bits, width: int) -> DataFrame:
    """(h, c): hashes of pairs of frequent words, and how often they occur in a part of the texts."""

    def count(own: Frequent, ids: np.ndarray, starts: int) -> np.ndarray:
        at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
        return (_pairs_of(own, ids, at[at < starts]) >> np.uint64(64 - KEPT)).view(np.int64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows, c in _counted(batches, 1, _frequent(word_bits, width), count):
            for lo in range(0, len(c), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(rows[lo : lo + 100_000, 0]), pa.array(c[lo : lo + 100_000])], names=["h", "c"])

    return source.mapInArrow(run, "h long, c long")


def _projector(pair_bits, width: int, longest: int) -> Callable:
    def count(own: Frequent, ids: np.ndarray, starts: int) -> np.ndarray:
        pair = np.zeros(len(ids) + longest, bool)
        at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
        pair[at] = passes(pair_bits.value, _pairs_of(own, ids, at), width)
        at = np.flatnonzero(pair[:starts])
        padded = np.concatenate([ids, np.zeros(longest, np.int64)])
        columns, on = [padded[at], padded[at + 1]], np.ones(len(at), bool)
        for k in range(1, longest - 1):
            on = on & pair[at + k]
            columns.append(np.where(on, padded[at + k + 1], 0))
        return np.stack(columns, 1).astype(np.int32)

    return count


def grown(rows: list[tuple], known: int, least: int) -> Iterator[tuple[tuple[str, ...], int]]:
    """Frequent phrases that begin with the rows' common first ``known`` words, and are longer, depth first.  rows: (words or null ..., count), sorted."""
    longest = len(rows[0]) - 1 if rows else 0

    def extend(lo: int, hi: int, depth: int) -> Iterator[tuple[tuple[str, ...], int]]:
        while lo < hi and rows[lo][depth] is None:  # what ends here sorts first
            lo += 1
        while lo < hi:
            word, total, end = rows[lo][depth], 0, lo
            while end < hi and rows[end][depth] == word:
                total += rows[end][-1]
                end += 1
            if total >= least:
                yield rows[lo][: depth + 1], total
                if depth + 1 < longest:
                    yield from extend(lo, end, depth + 1)
            lo = end

    if known < longest:
        yield from extend(0, len(rows), known)


def _grow(rows: DataFrame, names: list[str], known: int, least: int) -> DataFrame:
    """One task grows a prefix of ``known`` words from its projections (lang, words, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([list(r[1]) for r in out], pa.list_(pa.string())), pa.array([r[2] for r in out], pa.int64())], names=["lang", "words", "a"])

        for batch in batches:
            for lang, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (now := (lang, *row[:known])) != key:
                    if held:
                        out += [(key[0], *x) for x in grown(held, known, least)]
                    held, key = [], now
                held.append(tuple(row))
                if len(out) >= 10_000:
                    yield emit()
                    out = []
        if held:
            out += [(key[0], *x) for x in grown(held, known, least)]
        if out:
            yield emit()

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "lang", *names[:known]).sortWithinPartitions("lang", *names)
    return dealt.mapInArrow(run, "lang string, words array<string>, a long")


def _deepened(runs: DataFrame, names: list[str], least: int, most: int) -> DataFrame:
    """Phrases of three words and more (lang, words, a) from the projections of frequent pairs."""
    found, rest = [], runs
    for known in range(2, len(names)):
        key, next_ = ["lang", *names[:known]], names[known]
        large = written(rest.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > most).select(*key), "large-prefixes")
        if large.isEmpty():
            found.append(_grow(rest, names, known, least))
            break
        found.append(_grow(rest.join(large, key, "left_anti").select("lang", *names, "c"), names, known, least))
        held = rest.join(large, key, "left_semi").where(F.col(next_).isNotNull())
        longer = held.groupBy(*key, next_).agg(F.sum("c").alias("a")).where(F.col("a") >= least)
        longer = written(longer, "longer-prefixes")
        found.append(longer.select("lang", F.array(*names[: known + 1]).alias("words"), "a"))
        rest = held.join(longer.drop("a"), [*key, next_], "left_semi").select("lang", *names, "c")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def frequent(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, rows: int = ROWS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases(lang, words, a) of one to ``longest`` words that occur at least ``least`` times, totals(lang, n) of all words), both written."""
    if longest < 2:
        raise ValueError("phrases have two words or more")
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    counted = _mapped(source, 0, None, _words, "lang string, w1 string, c long").groupBy("lang", "w1").agg(F.sum("c").alias("c"))
    counted = written(counted, "words")
    totals = written(counted.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    words = counted.where(F.col("c") >= least)
    word_bits = spark.sparkContext.broadcast(bitmap(_word_hashes(words), bits))
    hashes = _pair_hashes(source, word_bits, bits).groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    pair_bits = spark.sparkContext.broadcast(bitmap(hashes, bits))
    names = [f"w{k}" for k in range(1, longest + 1)]
    runs = _mapped(source, longest - 1, _frequent(word_bits, bits), _projector(pair_bits, bits, longest), ", ".join(["lang string", *(f"{w} string" for w in names), "c long"]))
    runs = written(runs.groupBy("lang", *names).agg(F.sum("c").alias("c")), "projections")
    one = words.select("lang", F.array("w1").alias("words"), F.col("c").alias("a"))
    pairs = runs.groupBy("lang", "w1", "w2").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
    phrases = one.unionByName(pairs.select("lang", F.array("w1", "w2").alias("words"), "a"))
    if longest > 2:
        phrases = phrases.unionByName(_deepened(runs.where("w3 is not null"), names, least, rows))
    return written(phrases, "phrases"), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, k, l, r, n, score) of the phrases of two words and more: the cut of the lowest score, ties to the smallest k."""
    counts = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "a")
    size, k = F.size("words"), F.col("k")
    cuts = phrases.where(size >= 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice("words", F.lit(1), k), " ")).withColumn("rest", F.array_join(F.slice("words", k + 1, size - k), " "))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # products of up to 38 digits are exact; the quotient is at most 1000 * n
    score = F.call_function("div", F.lit(1000).cast("decimal(5,0)") * (wide("a") * wide("n")), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("at"))
    return best.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", "at.k", "at.l", "at.r", "n", "at.score")


def collocations(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    absorbed: int = ABSORBED,
    rows: int = ROWS,
    bits: int = BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by score, a, and the phrase's bytes.

    A phrase goes if a longer candidate that holds it occurs at least ``absorbed`` per cent as often; one of a
    single word more then does, too.
    """
    with steps(docs.sparkSession):
        phrases, totals = frequent(docs, text=text, lang=lang, least=least, longest=longest, rows=rows, bits=bits)
        many = phrases.where(F.size("words") >= 3)
        inside = F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)))
        longer = many.select("lang", inside.alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("most"))
        kept = scored(phrases, totals).join(longer, ["lang", "words"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * absorbed))
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
        some = Window.partitionBy("lang", "share").orderBy(*order)
        best = kept.withColumn("share", share).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank", "share")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return written(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", outlives=True)


ship(__name__)
