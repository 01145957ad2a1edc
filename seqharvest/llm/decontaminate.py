"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items become one automaton over word ids.  Documents are
streamed through it word by word; the automaton gives at each word the length
of the longest item substring that ends there.  A match of at least ``window``
words covers only windows of the item, so its words are hit; an item shorter
than the window counts as one window of its own length.

The items are a query set: they are read in blocks of at most ``block_words``
words, and one automaton of such a block is all that is broadcast.  It is held in
flat arrays, some 50 bytes a word.  Documents are never shuffled; with more
blocks than one, what a block's pass has found goes along with the row to the
next block's pass, by a table in the shared folder.  Results don't depend on
the blocks.

Defined results: a null or empty text has no words and no hit.  Items without
words never occur; a null item_id is listed as ``null``, besides one that is so
named.  Repeated item ids count once.  Repeated documents are scanned each.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from ..storage import written
from .common import free_name, ship, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLOCK_WORDS = 2_000_000


class Automaton:
    """Generalised suffix automaton of word sequences.

    A state's first transition lies in flat arrays (its word and its target), any other in
    one dict under state * width + word: most states have one.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        rows = [(key, array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in ws])) for key, ws in items if ws]
        self.shortest = min([window, *(len(ws) for _, ws in rows)])
        self.width = width = len(self.vocab)
        self.word, self.to, self.link, self.length = word, to, link, length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.step: dict[int, int] = {}
        step = self.step
        others: dict[int, list[int]] = {}  # state -> the words of its transitions in the dict

        def target(p: int, c: int) -> int:
            return to[p] if word[p] == c else step.get(p * width + c, -1)

        def put(p: int, c: int, q: int) -> None:
            if word[p] < 0 or word[p] == c:
                word[p], to[p] = c, q
                return
            if p * width + c not in step:
                others.setdefault(p, []).append(c)
            step[p * width + c] = q

        def state(size: int, suffix: int) -> int:
            for column, x in ((word, -1), (to, -1), (link, suffix), (length, size)):
                column.append(x)
            return len(length) - 1

        def split(p: int, c: int) -> int:
            """The state of exactly the strings of length length[p] + 1 that reach over c; split off if need be."""
            q = target(p, c)
            if length[q] == length[p] + 1:
                return q
            copy = state(length[p] + 1, link[q])
            word[copy], to[copy] = word[q], to[q]
            for d in others.get(q, ()):
                put(copy, d, step[q * width + d])
            link[q] = copy
            while p >= 0 and target(p, c) == q:
                put(p, c, copy)
                p = link[p]
            return copy

        for _, ws in rows:
            last = 0
            for c in ws:
                if target(last, c) >= 0:
                    last = split(last, c)
                    continue
                cur, p = state(length[last] + 1, 0), last
                while p >= 0 and target(p, c) < 0:
                    put(p, c, cur)
                    p = link[p]
                if p >= 0:
                    link[cur] = split(p, c)
                last = cur

        #: Items by number, and for each state of a whole window the numbers of its items (sorted pairs).
        self.names = list(dict.fromkeys(key for key, _ in rows))
        number = {key: i for i, key in enumerate(self.names)}
        at, whose = array("i"), array("i")
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> short items that are one of its strings
        for key, ws in rows:
            s = size = 0
            for c in ws:
                s, size = target(s, c), size + 1
                if size >= window:
                    s, size = self.window_state(s), window
                    at.append(s)
                    whose.append(number[key])
            if len(ws) < window:
                self.short.setdefault(s, []).append((len(ws), number[key]))
        pairs = np.unique(np.frombuffer(at, np.int32).astype(np.int64) << 32 | np.frombuffer(whose, np.int32))
        self.window_states, self.window_items = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        self.marked = array("i")  # nearest state on the suffix path that has short items
        if self.short:
            self.marked = array("i", bytes(4 * len(length)))
            for s in np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist()[1:]:
                self.marked[s] = s if s in self.short else self.marked[link[s]]

    @classmethod
    def of(cls, state: dict) -> Automaton:
        """The automaton of a state that was sent as vars()."""
        auto = cls.__new__(cls)
        vars(auto).update(state)
        return auto

    def window_state(self, s: int) -> int:
        """The state of the last ``window`` words of a match that ended in s."""
        while self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Word spans (start, end exclusive) that are hit, merged, and the items they come from."""
        ids = np.fromiter(map(self.vocab.get, ws, repeat(-1)), np.int64, len(ws))
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[int] = set()
        word, to, step, link, length, width, window = self.word, self.to, self.step, self.link, self.length, self.width, self.window
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # an unknown word ends every match: none here can be long enough
                continue
            s = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                t = to[s] if word[s] == c else step.get(s * width + c, -1)
                while t < 0 and s:
                    s = link[s]
                    size = length[s]
                    t = to[s] if word[s] == c else step.get(s * width + c, -1)
                s, size = (0, 0) if t < 0 else (t, size + 1)
                if size >= window:
                    states.add(s)
                    best = size
                else:
                    best = 0
                if self.short:
                    m = self.marked[s]
                    while m:
                        for k, item in self.short[m]:
                            if k <= size:
                                items.add(item)
                                best = max(best, k)
                        m = self.marked[link[m]]
                if best:
                    spans.append((i - best, i))
        if states:
            at = np.unique(np.fromiter(map(self.window_state, states), np.int32))
            lo, hi = (np.searchsorted(self.window_states, at, side) for side in ("left", "right"))
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                items.update(self.window_items[a:b].tolist())
        return merged(spans), {self.names[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union: sorted, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of at most ``limit`` words (or one item); the driver holds one block at a time."""
    block, size = [], 0
    for key, text in items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).toLocalIterator():
        ws = words(text)
        if block and size + len(ws) > limit:
            yield block
            block, size = [], 0
        block.append((key, ws))
        size += len(ws)
    yield block


def _automata(spark, items: DataFrame, item_id: str, item_text: str, window: int, limit: int) -> list[Broadcast]:
    # what is sent are plain arrays and dicts, so that executors can read it without this package
    return [spark.sparkContext.broadcast(vars(Automaton(block, window))) for block in _blocks(items, item_id, item_text, limit)]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": _SPANS}


def _pairs(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in spans or ()]


def scan(
    docs: DataFrame,
    items: DataFrame,
    *,
    keys: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row per document: its key columns, n_words, n_hit, items (sorted ids), spans (word positions, end exclusive)."""
    if clash := {k.lower() for k in keys} & set(HITS.names):
        raise ValueError(f"key columns clash with result columns: {sorted(clash)}")
    spark = docs.sparkSession
    source = docs.select(*keys, F.col(text).cast("string").alias(name := free_name(keys, "body")))
    kept = [f for f in source.schema if f.name != name]
    automata = _automata(spark, items, item_id, item_text, window, block_words)

    def one_pass(shared: Broadcast, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = Automaton.of(shared.value)
            for batch in batches:
                rows = {k: [] for k in _HITS}
                before = [None] * batch.num_rows if first else list(zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist(), strict=True))
                for body, old in zip(batch.column(name), before, strict=True):
                    ws = words(body.as_py())
                    spans, found = auto.scan(ws)
                    if old:
                        spans, found = merged([*spans, *_pairs(old[1])]), {*found, *old[0]}
                    rows["n_words"].append(len(ws))
                    rows["n_hit"].append(sum(b - a for a, b in spans))
                    found = sorted(found, key=lambda x: (x is not None, x))
                    rows["items"].append(sorted("null" if x is None else x for x in found) if last else found)
                    rows["spans"].append([{"start": a, "end": b} for a, b in spans])
                columns = {f.name: batch.column(f.name) for f in kept} | ({} if last else {name: batch.column(name)})
                columns |= {k: pa.array(rows[k], t) for k, t in _HITS.items()}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return run

    for i, shared in enumerate(automata):
        last = i + 1 == len(automata)
        out = T.StructType(kept + ([] if last else [source.schema[name]]) + HITS.fields)
        source = source.mapInArrow(one_pass(shared, i == 0, last), out)
        if not last:
            source = written(source, "decontaminate")
    return source


def strip(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_coverage: float = 0.8,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without their hit spans; a document of which hits cover ``max_coverage`` of the words or more goes.

    All columns stay as they are but for the text.  Coverage is that of all items
    together, before anything is cut.  What is cut leaves a line break; a text is
    scanned again, for all items, until nothing is hit, since the words around a
    cut may form a window of their own.
    """
    automata = _automata(docs.sparkSession, items, item_id, item_text, window, block_words)
    if len(automata) == 1:
        return _strip_at_once(docs, automata[0], text, max_coverage)
    return _strip_in_rounds(docs, automata, text, max_coverage)


def _strip_at_once(docs: DataFrame, shared: Broadcast, text: str, max_coverage: float) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton.of(shared.value)
        for batch in batches:
            keep, bodies = [], []
            for body in batch.column(at).to_pylist():
                first, gone = True, False
                while body and (spans := auto.scan(ws := words(body))[0]):
                    if first and sum(b - a for a, b in spans) >= max_coverage * len(ws):
                        gone = True
                        break
                    body, first = _cut(body, spans), False
                keep.append(not gone)
                bodies.append(body)
            columns = list(batch.columns)
            columns[at] = pa.array(bodies, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _strip_in_rounds(docs: DataFrame, automata: list[Broadcast], text: str, max_coverage: float) -> DataFrame:
    """Every round, texts pass all blocks before they are cut; those that were cut go into the next round."""
    at, columns = docs.columns.index(text), docs.columns
    name = free_name(columns, "hit_spans")
    rest: list[DataFrame] = []
    first = True
    while True:
        for shared in automata:

            def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                auto = Automaton.of(shared.value)
                for batch in batches:
                    olds = batch.column(len(columns)).to_pylist() if batch.num_columns > len(columns) else repeat(None, batch.num_rows)
                    spans = [merged([*auto.scan(words(body.as_py()))[0], *_pairs(old)]) for body, old in zip(batch.column(at), olds, strict=True)]
                    found = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], found], names=[*columns, name])

            docs = written(docs.mapInArrow(find, T.StructType([*docs.schema.fields[: len(columns)], T.StructField(name, SPANS)])), "decontaminate")

        def apply(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, bodies = [], []
                for body, found in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                    spans = _pairs(found)
                    gone = bool(spans) and first and sum(b - a for a, b in spans) >= max_coverage * len(words(body))
                    keep.append(not gone)
                    bodies.append(_cut(body, spans) if spans and not gone else body)
                out = [*batch.columns[: len(columns)]]
                out[at] = pa.array(bodies, out[at].type)
                yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep, pa.bool_()))

        hit = F.size(name) > 0
        rest.append(docs.where(~hit).drop(name))
        again = written(docs.where(hit).mapInArrow(apply, T.StructType(docs.schema.fields[: len(columns)])), "decontaminate")
        if again.isEmpty():
            break
        docs, first = again, False
    out = rest[0]
    for more in rest[1:]:
        out = out.unionAll(more)
    return out


def _cut(body: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of its words; each leaves a line break."""
    place = [m.span() for m in WORD.finditer(body)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(body[at : place[a][0]])
        at = place[b - 1][1]
    return "\n".join([*kept, body[at:]])


ship(__name__)
