"""Token ids in a compressed file: canonical length-limited Huffman blocks.

The file is a table.  Each of its rows is a block of whole documents, at least
``BLOCK`` ids where there are as many, which is decoded without any other:
``payload`` holds the codes bit by bit, ``checkpoints`` the bits that every run
of ``EVERY`` ids takes (so the bit offset of each run follows by a running sum
and all runs of a block are decoded in step, by one table look-up an id).
``doc_ids`` and ``n_tokens`` list the block's documents, ``start`` is the number
of ids before the block.  ``code`` beside it holds the code length of each id.

Documents come in ascending doc_id order (nulls first, then by text).  Spark
writes and reads the tables, so they may lie in any store, and a lost task is
simply run again.  What goes to the driver: one count per id of the vocabulary
and one total per partition.

Codes have 16 bits at most, or a bit more than the number of distinct ids asks for.

The tokenizer is used as its file sets it up, with special tokens as it knows them.
The file is read where the driver runs and goes to the executors by broadcast.

Defined results: a null text is empty and gives the end id alone; repeated
rows are written each; an empty table gives an empty file.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import steps, written
from .common import ship

BLOCK, EVERY, LIMIT = 1 << 17, 64, 16
#: Bytes of text that are encoded at a time.
PIECE = 8 << 20
#: All white space.
SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())
_ANY_SPACE = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in sorted(SPACES)) + "]"
#: A space between two white-space characters, or before the end: there a cut before the space could fall inside a token.
UNSAFE = rf"{_ANY_SPACE} (?:{_ANY_SPACE}|\z)"


class Numbers(dict):
    """Unit -> number, in order of appearance; take() gives the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.fresh.append(unit)
        return n

    def take(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct space-led unit encoded once.

    The tokenizer never joins text across a space that a non-space follows, so
    a text is the sequence of its units from one such space to the next.
    Texts in which single spaces don't mark such places, or that hold an added token,
    are encoded whole; so is every text if the tokenizer isn't a plain byte-level one.
    """

    #: Units kept; beyond it, those that only one call has asked for are forgotten.
    ROOM = 800_000

    def __init__(self, described: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(described)
        about = json.loads(described)
        before, model = about.get("pre_tokenizer") or {}, about["model"]
        self.by_unit = (
            not any(about.get(k) for k in ("normalizer", "truncation", "padding"))
            and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        self.added = sorted({t["content"] for t in about["added_tokens"]})
        if self.by_unit and hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # units come once: a cache of words inside would only cost time
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: one character of its name each
        for name, i in vocab.items():
            self.width[i] = len(name)
        self.reset()

    @classmethod
    def of_process(cls, described: str) -> Encoder:
        """The encoder that this worker process has kept from earlier tasks, or a new one."""
        kept = vars(sys.modules.setdefault("_seqharvest_process", types.ModuleType("_seqharvest_process"))).setdefault("encoders", {})
        if (key := hash(described)) not in kept:
            kept[key] = cls(described)
        return kept[key]

    def reset(self) -> None:
        self.units = Numbers()
        self.flat, self.starts, self.sizes, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _ids(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units n, one after another, and where each ends."""
        size = self.sizes[n].astype(np.int64)
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[n] - ends + size, size) + np.arange(size.sum())], ends

    def _shrink(self) -> None:
        """Keep the units that several calls have asked for, at most half the room: the most used, ties by age."""
        keep = np.flatnonzero(self.used > 1)
        keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: self.ROOM // 2]])
        names = np.array(list(self.units), object)[keep].tolist()
        self.flat, ends = self._ids(keep)
        self.sizes = self.sizes[keep]
        self.starts, self.used = ends - self.sizes, np.ones(len(keep), np.int32)
        self.units = Numbers()
        self.units.update(zip(names, range(len(names))))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Encode units, in their order; each gets a space in front."""
        hard = {i for i, u in enumerate(units) if not u or u[0] in SPACES}
        easy = [u for i, u in enumerate(units) if i not in hard] if hard else units
        sizes = np.zeros(len(units), np.int64)
        is_easy = np.ones(len(units), bool)
        is_easy[list(hard)] = False
        ids = np.zeros(0, np.int32)
        if easy:
            # many units in one call; the widths of the tokens tell where each unit ends
            ids = np.concatenate(self.whole([" " + " ".join(easy[i : i + 200]) for i in range(0, len(easy), 200)]))
            raw = np.frombuffer((" " + " ".join(easy)).encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
            at = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            sizes[is_easy] = np.diff(at, prepend=0)
        starts = np.zeros(len(units), np.int64)
        starts[is_easy] = np.cumsum(sizes[is_easy]) - sizes[is_easy]
        more = [ids]
        at = len(ids)
        for i, x in zip(sorted(hard), self.whole([" " + units[i] for i in sorted(hard)]), strict=True):
            starts[i], sizes[i] = at, len(x)
            at += len(x)
            more.append(x)
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.used = np.concatenate([self.used, np.zeros(len(units), np.int32)])
        self.flat = np.concatenate([self.flat, *more])

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if not self.by_unit:
            return self.whole(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        if len(self.units) > self.ROOM:
            self._shrink()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cannot = pc.or_(pc.invert(pc.match_substring(column, " ")), pc.match_substring_regex(column, UNSAFE))
        for x in self.added:
            cannot = pc.or_(cannot, pc.match_substring(column, x))
        out: list = [None] * len(column)
        odd = np.flatnonzero(cannot.to_numpy(zero_copy_only=False)).tolist()
        for i, ids in zip(odd, self.whole(column.filter(cannot).to_pylist()), strict=True):
            out[i] = ids
        plain = [i for i in range(len(out)) if out[i] is None]
        if not plain:
            return out
        split = pc.split_pattern(column.filter(pc.invert(cannot)), " ")
        edge = split.offsets.to_numpy()
        firsts = self.whole(split.values.take(pa.array(edge[:-1])).to_pylist())
        led = np.ones(edge[-1], bool)
        led[edge[:-1]] = False
        coded = split.values.filter(pa.array(led)).dictionary_encode()
        distinct = np.fromiter(map(self.units.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        if fresh := self.units.take():
            self._learn(fresh)
        self.used[distinct] += 1
        ids, ends = self._ids(distinct[coded.indices.to_numpy()])
        last = 0
        for i, first, to in zip(plain, firsts, ends[np.cumsum(np.diff(edge) - 1) - 1].tolist(), strict=True):
            out[i] = np.concatenate([first, ids[last:to]])
            last = to
        return out


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the rows, with ``PIECE`` bytes of text (column 1) each or a single longer text more."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(ends)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths of least total size with none over ``limit`` (package-merge), or over what so many ids need; 0 where the count is 0."""
    out = np.zeros(len(counts), np.int64)
    order = np.flatnonzero(counts)
    order = order[np.argsort(counts[order], kind="stable")]
    n = len(order)
    if n <= 1:
        out[order] = 1
        return out
    if n > 1 << limit:
        limit = (n - 1).bit_length() + 1
    weight = counts[order].astype(np.float64)
    level, leaves = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        leaves.append(rank < n)
    take, size = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(leaves):
        own = int(flags[:take].sum())
        size[:own] += 1
        take = 2 * (take - own)
    out[order] = size
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code = last = 0
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        codes[i] = code
        code, last = code + 1, int(lengths[i])
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of a block."""
    size = lengths[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ids) else 0
    at = ends - size
    # a code lies in 64 bits from the start of a 32-bit word: in that word and the next
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word, n = at >> 5, (total + 31) // 32 + 1
    out = np.bincount(word, value >> np.uint64(32), n) + np.bincount(word + 1, value & np.uint64(0xFFFFFFFF), n)
    marks = np.append(at[::EVERY], total)
    return out.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8], np.diff(marks).astype("<u2").tobytes()


def table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) of every window of ``limit`` bits, or of as many as the longest code has; and that number."""
    limit = max(limit, int(lengths.max(initial=0)))
    ids = np.zeros(1 << limit, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    reach = 1 << (limit - lengths[order])
    filled = np.repeat(order, reach)
    ids[: len(filled)] = filled
    return ids, np.where(np.arange(1 << limit) < len(filled), lengths[ids], 1), limit


def unpack(payload: bytes, checkpoints: bytes, n: int, ids: np.ndarray, size: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The n ids of a block; all its runs are decoded in step."""
    run = np.frombuffer(checkpoints, "<u2").astype(np.int64)
    at = np.cumsum(run) - run
    raw = np.frombuffer(payload + bytes(EVERY * limit // 8 + 8), np.uint8).astype(np.int64)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.empty((len(run), EVERY), np.int64)
    mask = (1 << limit) - 1
    for t in range(EVERY if n else 0):
        bits = (window[at >> 3] >> (32 - limit - (at & 7))) & mask
        out[:, t] = ids[bits]
        at = at + size[bits]
    return out.reshape(-1)[:n]


def tokenized(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Blocks of ids in ascending doc_id order (nulls first; rows of one id by their text's hash): part, start (in the part), doc_ids, n_tokens, ids.

    The last row of a part has no ids: it lists the part's distinct ids (as doc_ids) and how often each occurs (as n_tokens).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    with open(tokenizer, encoding="utf-8") as file:
        described = spark.sparkContext.broadcast(file.read())
    # rows of one id, or without one, may be many: the text's hash deals them out, and orders them
    order = (F.col("doc_id").asc(), F.xxhash64("text").asc())
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder.of_process(described.value)
        part, start, size = TaskContext.get().partitionId(), 0, 0
        total = np.zeros(1, np.int64)
        who: list[int] = []
        held: list[np.ndarray] = []

        def row(start, who: list, counts: list, raw: bytes | None) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, start, who, counts, raw), kinds)], names=["part", "start", "doc_ids", "n_tokens", "ids"])

        def block() -> pa.RecordBatch:
            nonlocal total
            ids = np.concatenate([x for pair in zip(held, repeat(np.array([end_id], np.int32))) for x in pair]).astype("<u4")
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
            return row(start, who, [len(x) + 1 for x in held], ids.tobytes() if ids.max() >= 65536 else ids.astype("<u2").tobytes())

        for batch in batches:
            for piece in pieces(batch):
                for number, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1)), strict=True):
                    who.append(number)
                    held.append(ids)
                    size += len(ids) + 1
                    if size >= BLOCK:
                        yield block()
                        start, size, who, held = start + size, 0, [], []
        if held:
            yield block()
        if len(seen := np.flatnonzero(total)):
            yield row(None, seen.tolist(), total[seen].tolist(), None)

    return rows.mapInArrow(run, "part long, start long, doc_ids array<long>, n_tokens array<long>, ids binary")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Tokenize, count all ids, and write the file (tables ``blocks`` and ``code`` under path)."""
    spark = docs.sparkSession
    with steps(spark):
        every = written(tokenized(docs, tokenizer, doc_id=doc_id, text=text, end_id=end_id), "token-ids")
        blocks = every.where("ids is not null")

        found = every.where("ids is null").select(F.inline(F.arrays_zip("doc_ids", "n_tokens")).alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(1 + max([r["id"] for r in found], default=0), np.int64)
        for r in found:
            counts[r["id"]] = r["n"]
        lengths = code_lengths(counts)
        sizes = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
        before, offset = 0, {}
        for r in sorted(blocks.groupBy("part").agg(F.sum(sizes).alias("n")).collect()):
            offset[r["part"]] = before
            before += r["n"]
        shared = spark.sparkContext.broadcast((canonical(lengths), lengths, offset))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, lengths, offset = shared.value
            for batch in batches:
                part, start, who, n, raw = (batch.column(i).to_pylist() for i in range(5))
                packed = [pack(_ids(x, sum(k)), codes, lengths) for x, k in zip(raw, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([offset[p] + s for p, s in zip(part, start, strict=True)], pa.int64()),
                        batch.column(2),
                        batch.column(3),
                        pa.array([c for _, c in packed], pa.binary()),
                        pa.array([p for p, _ in packed], pa.binary()),
                    ],
                    names=["start", "doc_ids", "n_tokens", "checkpoints", "payload"],
                )

        out = blocks.mapInArrow(encode, "start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, payload binary")
        out.write.option("compression", "none").parquet(f"{path}/blocks")
        code = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int")
        code.coalesce(1).write.parquet(f"{path}/code")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(1 + max([r["id"] for r in code], default=0), np.int64)
    for r in code:
        lengths[r["id"]] = r["bits"]
    shared = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = table(shared.value)
        for batch in batches:
            for start, who, n, marks, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ends = np.cumsum(n)
                raw = unpack(payload, marks, int(ends[-1]), *look).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(who, pa.int64()),
                        pa.array(start + ends - n, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([raw[4 * (b - k) : 4 * b] for b, k in zip(ends.tolist(), n, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    fields = blocks.select("start", "doc_ids", "n_tokens", "checkpoints", "payload")
    return fields.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


ship(__name__)
