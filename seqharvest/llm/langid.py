"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to segment it into pieces,
by the forward algorithm; the likelihood of a text is the product over its
words.  Piece probabilities are fitted by expectation maximisation over the
word counts of labelled texts.

A text is lower-cased; its words are the runs between ASCII non-letters.  A word gets the vocabulary's word mark in front; words of more than
``SPAN`` characters are scored in consecutive parts.  A character that no piece
covers is emitted by an escape of low probability, the same in all languages.
Pieces that are not lower case, or of more than ``LONGEST`` characters, are left out.

Defined results: a text that is null or has no letter is ``und`` with score 0;
ties go to the first language in sorted order.  With no labelled text at all,
every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import free_name, ship

SPAN = 32
#: Characters of the longest piece used.
LONGEST = 16
#: Rows and bytes of text that are scored at a time.
ROWS, BYTES = 500, 4 << 20
MARK = "▁"
ESCAPE = 1e-7
LETTER = re.compile(r"[^\W\d_]")
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
SLOTS = 18


def letter_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split()


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model file, control and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not any(f(i) for f in special)]


class Pieces:
    """Pieces by the hash of their characters, for arrays of words at once."""

    def __init__(self, pieces: list[str]):
        low = sorted({p for p in pieces if p == p.lower() and 0 < len(p) <= LONGEST})
        self.n = len(low)
        self.longest = max(map(len, low), default=0)
        hashes = np.zeros(self.n, np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(low):
                h = np.uint64(0)
                for c in p:
                    h = h * BASE + np.uint64(ord(c) + 1)
                hashes[i] = h
        self.slot_hash = np.zeros(1 << SLOTS, np.uint64)
        self.slot_piece = np.full(1 << SLOTS, self.n, np.int32)  # n: no piece
        for i, h in enumerate(hashes.tolist()):
            at = self._slot(h)
            while self.slot_piece[at] != self.n:
                at = (at + 1) & ((1 << SLOTS) - 1)
            self.slot_hash[at], self.slot_piece[at] = h, i
        full = self.slot_piece != self.n
        self.probes = 1
        run = 0
        for x in np.concatenate([full, full]).tolist():
            run = run + 1 if x else 0
            self.probes = max(self.probes, run)
        self.probes = min(self.probes, 64)

    @staticmethod
    def _slot(h: int) -> int:
        return ((h * int(SPREAD)) & ((1 << 64) - 1)) >> (64 - SLOTS)

    def find(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            at = ((h * SPREAD) >> np.uint64(64 - SLOTS)).astype(np.int64)
        got = self.slot_piece[at]
        out = np.where(self.slot_hash[at] == h, got, self.n)
        open_ = np.flatnonzero((out == self.n) & (got != self.n))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << SLOTS) - 1)
            got = self.slot_piece[at[open_]]
            hit = self.slot_hash[at[open_]] == h[open_]
            out[open_[hit]] = got[hit]
            open_ = open_[~hit & (got != self.n)]
        return out

    def lattices(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, dict]]:
        """For words grouped by length: (their numbers, length with the mark, {(start, end): piece of each})."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for m in np.unique(size).tolist():
            who = np.flatnonzero(size == m)
            for part in np.array_split(who, max(1, len(who) // 20_000)):
                chars = np.frombuffer("".join(MARK + words[i] for i in part.tolist()).encode("utf-32-le"), np.uint32).reshape(len(part), m)
                edges = {}
                with np.errstate(over="ignore"):
                    for i in range(m):
                        h = np.zeros(len(part), np.uint64)
                        for j in range(i + 1, min(m, i + self.longest) + 1):
                            h = h * BASE + (chars[:, j - 1].astype(np.uint64) + np.uint64(1))
                            ids = self.find(h)
                            if (ids != self.n).any():
                                edges[i, j] = ids
                yield part, m, edges


def _parts(word: str) -> list[str]:
    return [word[i : i + SPAN] for i in range(0, len(word), SPAN)]


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    prob: np.ndarray  # (pieces + 1) x languages; the last row is 0

    def sent(self) -> tuple[list[str], dict, np.ndarray]:
        """The model as plain values, which executors can read without this package."""
        return self.langs, vars(self.pieces), self.prob

    @classmethod
    def of(cls, langs: list[str], pieces: dict, prob: np.ndarray) -> Model:
        own = Pieces.__new__(Pieces)
        vars(own).update(pieces)
        return cls(langs, own, prob)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language), words x languages."""
        whole, owner = [], []
        for i, w in enumerate(words):
            for p in _parts(w) if len(w) > SPAN else (w,):
                whole.append(p)
                owner.append(i)
        out = np.zeros((len(words), len(self.langs)))
        owner_ = np.asarray(owner, np.int64)
        for who, m, edges in self.pieces.lattices(whole):
            ahead = self.forward(len(who), m, edges)
            np.add.at(out, owner_[who], np.log(ahead[m]))
        return out

    def forward(self, n: int, m: int, edges: dict) -> list[np.ndarray]:
        """Sums over the segmentations of each prefix.  The escape covers one character."""
        ahead = [np.ones((n, len(self.langs)))]
        for j in range(1, m + 1):
            a = ahead[j - 1] * ESCAPE
            for i in range(max(0, j - self.pieces.longest), j):
                if (ids := edges.get((i, j))) is not None:
                    a += ahead[i] * self.prob[ids]
            ahead.append(a)
        return ahead

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts by forward and backward sums; counts: words x languages."""
        total = np.zeros_like(self.prob)
        for who, m, edges in self.pieces.lattices(words):
            ahead = self.forward(len(who), m, edges)
            back = [None] * m + [np.ones_like(ahead[0])]
            for i in range(m - 1, -1, -1):
                b = back[i + 1] * ESCAPE
                for j in range(i + 1, min(m, i + self.pieces.longest) + 1):
                    if (ids := edges.get((i, j))) is not None:
                        b += back[j] * self.prob[ids]
                back[i] = b
            weight = counts[who] / ahead[m]
            for (i, j), ids in edges.items():
                part = ahead[i] * self.prob[ids] * back[j] * weight
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(ids, part[:, k], len(total))
        total[-1] = 0
        return total


def fit(
    docs: DataFrame,
    *,
    vocab_path: str,
    text: str = "text",
    lang: str = "lang",
    may_learn: Column | None = None,
    sample_by: Column,
    docs_per_lang: int = 300,
    rounds: int = 3,
    smoothing: float = 0.05,
) -> Model | None:
    """Fit piece probabilities on a bounded sample: about ``docs_per_lang`` whole texts of each language.

    ``sample_by`` is a long hash of the row; rows of a language are taken
    below a threshold on it, so that the same rows are taken at any layout.
    Languages must be few: their counts go to the driver.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if may_learn is None else may_learn))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang).cast("string")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    room = 1_000_000
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(max(1, min(room, round(room * docs_per_lang / sizes[k])))))])
    rows = known.where(F.pmod(sample_by, F.lit(room)) < share[F.col(lang).cast("string")])
    split = F.split(F.lower(F.col(text).cast("string")), r"[\x00-\x60\x7B-\x7F]+")
    counted = (
        rows.select(F.col(lang).cast("string").alias("l"), F.explode(split).alias("w"))
        .where((F.col("w") != "") & (F.length("w") <= SPAN))
        .groupBy("l", "w")
        .count()
        .collect()
    )
    index: dict[str, int] = {}
    for r in counted:
        index.setdefault(r["w"], len(index))
    counts = np.zeros((len(index), len(langs)))
    for r in counted:
        counts[index[r["w"]], langs.index(r["l"])] = r["count"]
    pieces = Pieces(vocabulary(vocab_path))
    prob = np.full((pieces.n + 1, len(langs)), 1 / max(1, pieces.n))
    prob[-1] = 0
    model = Model(langs, pieces, prob)
    words = list(index)
    for _ in range(rounds):
        total = model.expected(words, counts)
        shared = total.sum(1, keepdims=True) / max(1.0, total.sum())
        # a piece that a language has not shown gets a little of its overall rate
        total = total + smoothing * (1 + 200 * shared) * (np.arange(pieces.n + 1) < pieces.n)[:, None]
        model.prob = total / total.sum(0, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model | None, *, keep: list[str], text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns with the predicted language and its posterior (equal priors)."""
    if clash := {k.lower() for k in keep} & set(out):
        raise ValueError(f"kept columns clash with result columns: {sorted(clash)}")
    if model is None:
        return docs.select(*keep, F.lit("und").alias(out[0]), F.lit(0.0).alias(out[1]))
    name = free_name(keep, "body")
    source = docs.select(*keep, F.col(text).cast("string").alias(name))
    schema = T.StructType([f for f in source.schema if f.name != name] + [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model.sent())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordCache(Model.of(*shared.value))
        for batch in batches:
            langs, scores = [], []
            at = batch.schema.get_field_index(name)
            size = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero((np.diff(size // BYTES) > 0) | (np.arange(1, len(size)) % ROWS == 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                for lang, score in scorer.texts(batch.column(at).slice(lo, hi - lo).to_pylist()):
                    langs.append(lang)
                    scores.append(score)
            kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True) if f.name != name]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(n for n, _ in kept), *out])

    return source.mapInArrow(run, schema)


class WordCache(dict):
    """Word -> row of its scores; a word's lattice is summed once in a task until ``LIMIT`` words are held, then the cache starts anew."""

    LIMIT = 250_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.fresh: list[bytes] = []
        self.scores = np.zeros((0, len(model.langs)))

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def texts(self, bodies: list[str | None]) -> Iterator[tuple[str, float]]:
        if len(self) > self.LIMIT:
            self.clear()
            self.scores = self.scores[:0]
        look = self.__getitem__
        rows = []
        for body in bodies:
            if body is None or not LETTER.search(body):
                rows.append(None)
            else:
                ws = letter_words(body)
                rows.append(np.fromiter(map(look, ws), np.int64, len(ws)))
        if self.fresh:
            self.scores = np.concatenate([self.scores, self.model.word_scores([w.decode("utf-8", "replace") for w in self.fresh])])
            self.fresh = []
        for ids in rows:
            if ids is None:
                yield "und", 0.0
                continue
            total = self.scores[ids].sum(0)
            best = int(total.argmax())
            yield self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


@lru_cache(maxsize=1)
def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ship(__name__)
