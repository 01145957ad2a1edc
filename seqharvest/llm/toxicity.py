"""Toxicity by compression distance: two zstandard dictionaries and the windows' lengths.

One dictionary is trained on windows of ordinary text.  The other is trained on toxic text: first on
those of its windows that the ordinary dictionary shortens least, then, in a few rounds, on those that
the last round's dictionary shortens by ``GAIN`` bytes more than the ordinary one does.  So it comes to hold what toxic text has of its own,
and none of what all text has.  A window is compressed with the ordinary dictionary, and with the
toxic one before the ordinary one; the difference of the lengths is its gain.  A
document's score is a logistic function of the shares of its windows whose gain reaches the
thresholds in ``GAINS``, and of its mean gain, calibrated on labelled rows of their own.

Learning is bounded: about ``SAMPLE`` labelled documents of each kind at most, those of the smallest hashes of
their id, half for the dictionaries and half for the calibration; of the former about
``WINDOWS`` windows of each kind at most reach the driver, of the latter a few numbers a document.  Scoring reads every text
whole, in windows of about ``WIDTH`` bytes that end between words.

Defined results: a null text is empty; a text without words has no windows and the score of one without gains; with no
labelled rows every score is 0.5; with labels of one kind every score is near that label's share.
Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD_BYTES, ship

SAMPLE, WINDOWS, WIDTH = 4_000, 150_000, 128
#: Bytes of the ordinary dictionary, and of the toxic one in each round.
ORDINARY, TOXIC = 112_000, (8_192, 4_096, 3_072)
#: Share of the toxic windows in the first round: the ones that shorten least.
FIRST = 0.1
#: Gain of the windows for the next round, and of those that a document is measured by.
GAIN, GAINS = 4, (1, 2, 4)
BLOCK = 1 << 22
SPACE = re.compile(rb" +")


def windows(body: bytes, width: int = WIDTH) -> Iterator[bytes]:
    """The words of a text, lower-cased and a space apart, in windows that end with the word that reaches ``width`` bytes."""
    lo = 0
    body = body.translate(WORD_BYTES)
    held, size = [], 0
    while lo < len(body):
        hi = len(body) if len(body) - lo <= BLOCK else m.start() if (m := SPACE.search(body, lo + BLOCK)) else len(body)
        for word in body[lo:hi].split():
            held.append(word)
            size += len(word) + 1
            if size >= width:
                yield b" ".join(held)
                held, size = [], 0
        lo = hi
    if held:
        yield b" ".join(held)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples to train on, their end itself."""
    try:
        return zstandard.train_dictionary(size, samples, level=3, k=32, d=6, steps=4).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(samples)[-size:]


class Lengths:
    """Compressed lengths of windows by a dictionary."""

    def __init__(self, dictionary: bytes):
        plain = dict(write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        parameters = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, **plain)
        if dictionary:
            known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=parameters)
            self.compress = zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress
        else:
            self.compress = zstandard.ZstdCompressor(compression_params=parameters).compress

    def of(self, texts: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self.compress(t)) for t in texts), np.int64, len(texts))


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) trained on windows."""
    usual = _dictionary(ordinary, ORDINARY)
    if not toxic:
        return usual, b""
    before = Lengths(usual).of(toxic)
    ratio = before / np.fromiter(map(len, toxic), np.int64, len(toxic))
    chosen = np.argsort(-ratio, kind="stable")[: max(1, int(len(toxic) * FIRST))]
    found = b""
    for size in TOXIC:
        found = _dictionary([toxic[i] for i in chosen], size)
        gain = before - Lengths(found + usual).of(toxic)
        if not (gain >= GAIN).any():
            break
        chosen = np.flatnonzero(gain >= GAIN)
    return usual, found


def measured(gains: np.ndarray) -> list[float]:
    """What a document is scored by."""
    n = max(1, len(gains))
    return [*(float((gains >= g).sum() / n) for g in GAINS), float(gains.sum() / n), float(np.log1p((gains >= GAINS[1]).sum()))]


FEATURES = len(GAINS) + 2


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the intercept last) by Newton's method on scaled columns."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty * len(x) + 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


@dataclass
class Model:
    usual: bytes = b""
    toxic: bytes = b""
    mean: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))


def _measures(docs: DataFrame, usual: bytes, toxic: bytes, *, keep: list[str], text: str, width: int) -> DataFrame:
    """The ``keep`` columns and ``measures`` of each text."""
    sent = docs.sparkSession.sparkContext.broadcast((usual, toxic))
    kept = docs.select(*keep, F.lit(None).cast("array<double>").alias("measures")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, toxic = sent.value
        one, other = Lengths(usual), Lengths(toxic + usual)
        for batch in batches:
            out = []
            for body in batch.column(batch.num_columns - 1).cast(pa.binary()):
                gains, part = [], []
                for window in windows(body.as_py() or b"", width):
                    part.append(window)
                    if len(part) == 4_096:
                        gains.append(one.of(part) - other.of(part))
                        part = []
                gains.append(one.of(part) - other.of(part))
                out.append(measured(np.concatenate(gains)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*keep, "measures"])

    return docs.select(*keep, F.col(text).cast("string").alias("body")).mapInArrow(run, kept)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    may_learn: Column | None = None,
    sample: int = SAMPLE,
    most_windows: int = WINDOWS,
    width: int = WIDTH,
) -> Model:
    """may_learn is a condition on the column doc_id.  Only doc_id, text and label are read."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(F.lit(True) if may_learn is None else may_learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not total:
        return Model()
    room = 1_000_000
    share = lambda y: min(room, max(1, room * sample // total.get(y, 1)))
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(room))
    chosen = known.where(place < F.when(F.col("y") == 1, share(1)).otherwise(share(0))).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body")).where("doc_id is not null")
    texts = texts.join(F.broadcast(chosen), "doc_id").select("y", "half", "body")  # about 2 * sample rows of some 20 bytes

    # places without replacement: a window is kept by its hash, at a rate that the number of windows gives
    n = texts.where("half = 0").groupBy("y").agg(F.sum(F.length(F.coalesce("body", F.lit("")))).alias("n")).collect()
    rates = {r["y"]: min(1.0, most_windows * width / max(1, r["n"])) for r in n}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ys, out = [], []
            for y, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for w in windows(body.as_py() or b"", width):
                    if xxhash.xxh64_intdigest(w) < rates.get(y, 1.0) * 2**64:
                        ys.append(y)
                        out.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(out, pa.binary())], names=["y", "w"])

    table = texts.where("half = 0").select("y", "body").mapInArrow(cut, "y int, w binary").toArrow()
    by: dict[int, list[bytes]] = {0: [], 1: []}
    for y, w in zip(table["y"].to_pylist(), table["w"].to_pylist()):
        by[y].append(w)
    # in an order of the windows' own, so that the layout of the data doesn't matter
    usual, toxic = dictionaries(*(sorted(by[y], key=lambda w: (hash_of(w), w)) for y in (0, 1)))
    rows = _measures(texts.where("half = 1"), usual, toxic, keep=["y"], text="body", width=width).collect()
    if not rows:
        base = total.get(1, 0) / sum(total.values())
        return Model(usual, toxic, weights=[0.0] * FEATURES + [float(np.log((base + 1e-3) / (1 - base + 1e-3)))])
    data = np.array(sorted((*r["measures"], r["y"]) for r in rows))
    # kinds weigh as they do in all labels that may be learned from, not as in the sample
    mean, scale, w = logistic(data[:, :-1], data[:, -1])
    seen = data[:, -1].mean()
    true = total.get(1, 0) / sum(total.values())
    if 0 < seen < 1 and 0 < true < 1:
        w[-1] += np.log(true / (1 - true)) - np.log(seen / (1 - seen))
    return Model(usual, toxic, mean.tolist(), scale.tolist(), w.tolist())


def hash_of(w: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(w, 5)


def score(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text", width: int = WIDTH, out: str = "score") -> DataFrame:
    """The ``keep`` columns with the probability of label 1."""
    if clash := {k.lower() for k in keep} & {"measures", "body"}:
        raise ValueError(f"kept columns clash with measures: {sorted(clash)}")
    z = F.lit(model.weights[-1])
    for i, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights)):
        z = z + (F.get("measures", F.lit(i)) - m) / s * w
    return _measures(docs, model.usual, model.toxic, keep=keep, text=text, width=width).select(*keep, (1 / (1 + F.exp(-z))).alias(out))


ship(__name__)
