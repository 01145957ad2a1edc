"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A document is the set of its ``NGRAM``-word shingles (A-Z lower-cased; one of
fewer words has one shingle).  Documents of equal sets form one node.  Every
node has ``trees`` MinHash signatures.  A signature is kept as a label whose high bits
stand for its prefix of ``depth`` hashes and whose lower bytes for the hash after it and the one after that, so
labels in order are the leaves of the tree's trie: neighbours share a prefix of ``depth`` hashes, of
one more, or of two more, as far as their high bits agree.

Each node begins with the longest prefix in every tree.  It shortens its prefixes by a hash, one
after another, until a pair at the threshold is found with a probability of ``recall``, as the lengths of its
prefixes give it: first where that brings in the fewest other nodes.  Trees in which nothing stands under a
shorter prefix can't find anything by it and never count as shortened.  A node whose trees are all
shortened, or hold nothing more, finds what prefixes of ``depth`` find in all trees, which is at least as much.
So a prefix that much dissimilar text shares (boilerplate) stays long where others suffice.  Two nodes are a candidate pair of a tree if they
share what the one that has shortened more still asks for.

Candidates are verified before anything is closed: every subtree that somebody
asks for is dealt into chunks, and each pair of chunks is a tile, a task of bounded
size.  A tile takes the pairs that no earlier tree has, so each pair is compared once,
exactly, by its whole shingle sets, and returns a link count for each node and a
spanning forest of its links: no list of all pairs is made, and no verified link is lost.
Classes are the components of those links only.

Defined results: documents without words (or null) have no shingles, link to
nothing and are a class each.  Nodes are told apart by 64-bit hashes of their
sets.  Repeated rows are documents of their own, linked to one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import steps, written
from .common import free_name, ship, words
from .graph import components

NGRAM, THRESHOLD, TREES, MAX_DEPTH, RECALL = 5, 0.8, 30, 8, 0.9995
#: Nodes and shingles of a chunk.
CHUNK_NODES, CHUNK_SHINGLES = 512, 1_000_000
#: Rows of 16 bytes up to which a table of chosen rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000
#: Rows of a batch of results.
OUT = 4_096
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Bits of a label for each of the hashes after its prefix, and how many of them.
STEP, STEPS = 8, 2
#: Trees whose levels one number holds, two bits each.
MOST_TREES = 31


def prefix_depth(threshold: float, trees: int, recall: float, longest: int = MAX_DEPTH) -> int:
    """The most hashes that all trees' prefixes may have for a pair at the threshold to be found with probability ``recall``."""
    missed = lambda d: log1p(-(threshold**d)) if threshold**d < 1 else -1e9
    return next((d for d in range(longest, 1, -1) if trees * missed(d) <= log(1 - recall)), 1)


def levels(entries: list[tuple[int, int, int, int]], threshold: float, depth: int, trees: int, recall: float) -> list[tuple[int, int]]:
    """(tree, level) of a node's trees in which anything shares its shortest prefix; level: hashes that its prefix has over ``depth``.

    entries: tree, and the nodes under its prefixes of depth, depth + 1 and depth + 2 hashes (itself among them).
    """
    missed = [log1p(-(threshold ** (depth + k))) if threshold < 1 else -1e9 for k in range(STEPS + 1)]
    level = {tree: STEPS for tree, *_ in entries}
    # a step to a shorter prefix, after the steps before it; one that brings in nobody is made along with the next
    steps_ = []
    for tree, *under in entries:
        before, work = STEPS, 0
        for k in reversed(range(STEPS)):
            if under[k] > under[before]:
                work = max(work, under[k] - under[before])
                steps_.append((work, tree, -k, missed[k] - missed[before]))
                before = k
    chance, most = trees * missed[STEPS], log(1 - recall)
    for _, tree, k, gain in sorted(steps_):
        if chance <= most:
            break
        chance += gain
        level[tree] = -k
    return sorted(level.items())


class WordHash(dict):
    """Word -> 64-bit hash.  trim() empties it when it holds many, so that a worker's memory stays small."""

    ROOM = 150_000

    def trim(self) -> None:
        if len(self) > self.ROOM:
            self.clear()

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(ws: list[bytes], hashes: WordHash, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    if not len(h):
        return h
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(31))) * MIX[1] + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _signer(trees: int, depth: int):
    rng = np.random.default_rng(20_240_601)
    size = depth + STEPS
    mult = rng.integers(0, 1 << 63, trees * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, trees * size, dtype=np.uint64)
    low = np.uint64((1 << STEP * STEPS) - 1)

    def sign(sets: list[np.ndarray]) -> np.ndarray:
        """Labels of many sets at once, sets x trees."""
        starts = np.cumsum([0, *map(len, sets[:-1])])
        h = np.concatenate(sets)
        labels = np.zeros((len(sets), trees), np.uint64)
        least = lambda d: np.minimum.reduceat((h ^ flip[d]) * mult[d], starts)
        with np.errstate(over="ignore"):
            for t in range(trees):
                key = np.full(len(sets), t + 1, np.uint64)
                for d in range(t * size, t * size + depth):
                    key = (key ^ least(d)) * MIX[2]
                    key ^= key >> np.uint64(29)
                label = key & ~low
                for k in range(STEPS):
                    after = least(t * size + depth + k) * MIX[1]
                    label |= (after >> np.uint64(64 - STEP)) << np.uint64(STEP * (STEPS - 1 - k))
                labels[:, t] = label
        return labels.view(np.int64)

    return sign


def signatures(docs: DataFrame, row: str, *, doc_id: str, text: str, ngram: int, trees: int, depth: int) -> DataFrame:
    """doc_id, row, node (hash of the shingle set, null without words), n (shingles), labels (one a tree)."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(text).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = WordHash(), _signer(trees, depth)
        for batch in batches:
            held, size, lo = [], 0, 0
            bodies = batch.column(2)
            for i in range(len(bodies)):
                held.append(shingles(words(bodies[i].as_py()), hashes, ngram))
                size += len(held[-1])
                if size < 65_536 and i + 1 < len(bodies):
                    continue
                full = [s for s in held if len(s)]
                labels = iter(sign(full) if full else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(held)),
                        batch.column(1).slice(lo, len(held)),
                        pa.array([int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None for s in held], pa.int64()),
                        pa.array([len(s) for s in held], pa.int64()),
                        pa.array([next(labels) if len(s) else None for s in held], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "row", "node", "n", "labels"],
                )
                lo, held, size = i + 1, [], 0
                hashes.trim()

    return source.mapInArrow(run, "doc_id long, row long, node long, n long, labels array<long>")


def _links(left: list[np.ndarray], right: list[np.ndarray], asked: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs asked for have a Jaccard similarity of the threshold or more; exact."""
    if asked.sum() * 16 <= asked.size or asked.size <= 256:  # one by one
        out = np.zeros(asked.shape, bool)
        for x, y in zip(*np.nonzero(asked)):
            common = len(np.intersect1d(left[x], right[y], assume_unique=True))
            out[x, y] = common / max(1, len(left[x]) + len(right[y]) - common) >= threshold
        return out
    # products of incidence matrices over slices of the shingles
    both = left + right
    size = np.array([len(s) for s in both], np.int64)
    values, column = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), size)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    inter = np.zeros(asked.shape, np.int64)
    step = 4096
    for lo in range(0, len(values), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((len(both), min(step, len(values) - lo)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        inter += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    union = size[: len(left), None] + size[None, len(left) :] - inter
    return asked & (inter / np.maximum(union, 1) >= threshold)


def _forest(mask: np.ndarray) -> np.ndarray:
    """The smallest number each node reaches over a symmetric mask."""
    label = np.arange(len(mask))
    while True:
        new = np.minimum(label, np.where(mask, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


TILE = ("level", "bucket", "i", "j")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each tile, sorted by tile, as arrays; a node once."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {}
        for name, c in zip(batch.schema.names, batch.columns, strict=True):
            x = c.flatten().to_numpy().reshape(len(c), -1) if name == "labels" else c.to_numpy(zero_copy_only=False)
            now[name] = np.concatenate([held[name], x]) if held else x
        change = np.any([now[k][1:] != now[k][:-1] for k in TILE], axis=0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield {k: v[a:b] for k, v in now.items()}
        held = {k: v[edges[-1] :] for k, v in now.items()}
    if held and len(held["node"]):
        yield held


def _new_pairs(tile: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the left and of the right rows of a tile, and which of their pairs the tile has to verify."""
    level, i, j, tree = (int(tile[k][0]) for k in ("level", "i", "j", "tree"))
    _, first = np.unique(tile["node"], return_index=True)
    chunk = tile["chunk"][first]
    left, right = first[chunk == i], first[chunk == j]
    # bits of the label that a node doesn't ask for in each tree so far
    spare = STEP * (STEPS - ((tile["levels"][:, None] >> (2 * np.arange(tree + 1))) & 3))
    label, n = tile["labels"], tile["n"]
    asked = np.minimum(n[left, None], n[None, right]) >= threshold * np.maximum(n[left, None], n[None, right]) - 1e-9
    asked &= np.maximum(spare[left, None, tree], spare[None, right, tree]) == STEP * (STEPS - level)

    def found(x, y, a, b) -> np.ndarray:
        return (x != 0) & ((x ^ y) >> np.maximum(a, b) == 0)

    if len(left) * len(right) * tree <= 100_000:
        asked &= ~found(label[left, None, :tree], label[None, right, :tree], spare[left, None, :tree], spare[None, right, :tree]).any(2)
    else:
        for t in range(tree):
            asked &= ~found(label[left, None, t], label[None, right, t], spare[left, None, t], spare[None, right, t])
    return left, right, np.triu(asked, 1) if i == j else asked


def _dealt(tiles: DataFrame) -> DataFrame:
    parts = max(1, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return tiles.repartition(4 * parts, *TILE).sortWithinPartitions(*TILE, "node")


def _joined(parts: list[list[np.ndarray]], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts, strict=True), kinds, strict=True)], names=names)


def _asked(tiles: DataFrame, threshold: float) -> DataFrame:
    """The rows of the tiles that have a pair to verify; ``pairs``: how many with a row further on."""
    names = [*TILE, "tree", "chunk", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
        for tile in _tiles(batches):
            left, right, asked = _new_pairs(tile, threshold)
            pairs = np.zeros(len(tile["node"]), np.int64)
            pairs[left] = asked.sum(1)
            has = np.union1d(left[asked.any(1)], right[asked.any(0)])
            if not len(has):
                continue
            out.append([*(tile[k][has] for k in names), pairs[has]])
            size += len(has)
            if size >= OUT:
                yield _joined(out, [*names, "pairs"], kinds)
                out, size = [], 0
        if out:
            yield _joined(out, [*names, "pairs"], kinds)

    return _dealt(tiles.select(*names, "n", "labels", "levels")).mapInArrow(run, "level int, bucket long, i int, j int, tree int, chunk int, node long, pairs long")


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """Links inside tiles.  Rows (a, b, n): an edge of a spanning forest if b is given, else n documents that a links to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, edges, size = [], [], 0

        def flush() -> pa.RecordBatch:
            a, n = (np.concatenate([x[k] for x in counts]) for k in (0, 1))
            c, d = (np.concatenate([x[k] for x in edges]) for k in (0, 1))
            b = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(d, pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, c]), pa.int64()), b, pa.array(np.concatenate([n, np.zeros(len(c), np.int64)]), pa.int64())], names=["a", "b", "n"])

        for tile in _tiles(batches):
            left, right, asked = _new_pairs(tile, threshold)
            if not asked.any():
                continue
            sets = [[np.frombuffer(s, np.uint64) for s in tile["set"][side]] for side in (left, right)]
            got = _links(*sets, asked, threshold)
            both = np.union1d(left, right)
            full = np.zeros((len(both), len(both)), bool)
            at = [np.searchsorted(both, side) for side in (left, right)]
            full[np.ix_(*at)] = got
            full |= full.T
            names, copies = tile["node"][both], tile["copies"][both]
            label = _forest(full)
            linked = full @ copies
            has, edge = np.flatnonzero(linked), np.flatnonzero(label != np.arange(len(label)))
            counts.append((names[has], linked[has]))
            edges.append((names[edge], names[label[edge]]))
            size += len(has)
            if size >= OUT:
                yield flush()
                counts, edges, size = [], [], 0
        if counts:
            yield flush()

    return _dealt(tiles).mapInArrow(run, "a long, b long, n long")


def _paths(nodes: DataFrame, threshold: float, depth: int, trees: int, recall: float) -> DataFrame:
    """Nodes that share a prefix with others (written): node, row, n, copies, entries (tree, label, level), labels (0 where nothing is shared), levels (two bits a tree)."""
    keyed = nodes.select("node", F.posexplode("labels").alias("tree", "label"))
    per = keyed.groupBy("label").agg(F.count("*").alias("m2"))
    # labels under one prefix of ``depth`` hashes are at most 2 ** (STEP * STEPS)
    short = Window.partitionBy(F.shiftright("label", STEP * STEPS))
    runs = per.withColumn("m0", F.sum("m2").over(short)).where("m0 > 1")
    middle = Window.partitionBy(F.shiftright("label", STEP * STEPS), F.shiftright("label", STEP))
    runs = written(runs.withColumn("m1", F.sum("m2").over(middle)), "prefixes")  # so that both sides of the join are plain shuffles, which Spark splits at hot labels
    entry = F.struct("tree", "label", "m0", "m1", "m2")
    paths = keyed.join(runs, "label").groupBy("node").agg(F.sort_array(F.collect_list(entry)).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = part.column(1)
                size = np.diff(found.offsets.to_numpy())
                tree, label, *under = (found.flatten().field(c).to_numpy() for c in ("tree", "label", "m0", "m1", "m2"))
                row, at = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(size)])
                level = np.empty(len(tree), np.int32)
                for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                    level[x:y] = [k for _, k in levels(list(zip(*(c[x:y].tolist() for c in (tree, *under)))), threshold, depth, trees, recall)]
                labels, packed = np.zeros((len(size), trees), np.int64), np.zeros(len(size), np.int64)
                labels[row, tree] = label
                np.add.at(packed, row, level.astype(np.int64) << (2 * tree.astype(np.int64)))
                entries = pa.StructArray.from_arrays([pa.array(tree, pa.int32()), pa.array(label), pa.array(level)], names=["tree", "label", "level"])
                every = pa.array(np.arange(0, (len(size) + 1) * trees, trees), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), entries), pa.ListArray.from_arrays(every, pa.array(labels.ravel())), pa.array(packed)],
                    names=["node", "entries", "labels", "levels"],
                )

    paths = paths.mapInArrow(run, "node long, entries array<struct<tree: int, label: long, level: int>>, labels array<long>, levels long")
    return written(paths.join(nodes.select("node", "row", "n", "copies"), "node"), "paths")


def _dealt_out(paths: DataFrame) -> DataFrame:
    """A row for each tile that a node is in: the tile's key, tree, chunk (of the node), node.

    A bucket is a subtree: that of a prefix which some of its nodes ask for (their level is the bucket's), with the nodes
    below it that ask for longer ones.  Chunks of the latter meet only chunks of those that ask.
    """
    chosen = paths.select("node", "n", F.inline("entries")).withColumnRenamed("level", "own_level")
    # a node stands under its own prefix and all shorter ones
    at = chosen.select("node", "n", "tree", "label", "own_level", F.explode(F.sequence(F.lit(0), F.col("own_level"))).alias("level"))
    bits = STEP * (STEPS - F.col("level"))
    at = at.select("node", "n", "tree", "level", F.call_function("shiftright", "label", bits.cast("int")).alias("bucket"), (F.col("level") == F.col("own_level")).alias("asks"))
    chunks = lambda test: F.greatest(F.ceil(F.count_if(test) / CHUNK_NODES), F.ceil(F.sum(F.when(test, F.col("n")).otherwise(0)) / CHUNK_SHINGLES)).cast("int")
    asked = at.groupBy("level", "bucket").agg(F.count("*").alias("m"), chunks(F.col("asks")).alias("own"), chunks(~F.col("asks")).alias("others"))
    asked = written(asked.where("m > 1 and own > 0").drop("m"), "asked-prefixes")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    asks, own, others = F.col("asks"), F.col("own"), F.col("others")
    dealt = at.join(asked, ["level", "bucket"]).select(
        "level", "bucket", "tree", "node",
        F.when(asks, place(own)).otherwise(own + place(F.greatest(others, F.lit(1)))).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.when(asks, own + others).otherwise(own) - 1)).alias("other"),
    )
    return dealt.select("level", "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "tree", "chunk", "node")


def candidates(nodes: DataFrame, *, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(paths, tiles) of nodes (node, row, n, copies, labels), both written; the sum of the tiles' ``pairs`` is the number of pairs to verify."""
    if trees > MOST_TREES:
        raise ValueError(f"at most {MOST_TREES} trees")
    paths = _paths(nodes, threshold, prefix_depth(threshold, trees, recall), trees, recall)
    tiles = _dealt_out(paths).join(paths.select("node", "n", "labels", "levels"), "node")
    return paths, written(_asked(tiles, threshold), "tiles")


def signed_nodes(docs: DataFrame, row: str, *, doc_id: str, text: str, ngram: int, threshold: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(documents with their node, nodes), both written."""
    signed = written(signatures(docs, row, doc_id=doc_id, text=text, ngram=ngram, trees=trees, depth=prefix_depth(threshold, trees, recall)), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.max("n").alias("n"), F.first("labels").alias("labels"))
    return signed.drop("labels"), written(nodes, "nodes")


def join(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """A row per document: doc_id, row (hash of all its columns), node, root (of its class), n_links (documents at the threshold or above)."""
    hashed, row = _with_row(docs)
    signed, nodes = signed_nodes(hashed, row, doc_id=doc_id, text=text, ngram=ngram, threshold=threshold, trees=trees, recall=recall)
    paths, tiles = candidates(nodes, threshold=threshold, trees=trees, recall=recall)

    chosen = paths.join(tiles.select("node").distinct(), "node", "left_semi").select("node", "row", "n", "copies", "labels", "levels")
    chosen = written(chosen, "chosen")
    rows = chosen.select(F.col("row"), F.col("node"))
    if chosen.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    texts = hashed.select(F.col(row).alias("row"), F.col(text).cast("string").alias("body")).join(rows, "row").select("node", "body")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            made, lo, size = [], 0, 0
            for k, x in enumerate(batch.column(1)):
                made.append(shingles(words(x.as_py()), hashes, ngram).tobytes())
                size += len(made[-1])
                hashes.trim()
                if size >= 1 << 22 or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(made)), pa.array(made, pa.binary())], names=["node", "set"])
                    made, lo, size = [], k + 1, 0

    filled = written(texts.mapInArrow(sets, "node long, set binary"), "sets")
    work = tiles.drop("pairs").join(chosen.drop("row"), "node").join(filled, "node")
    found = written(_verified(work, threshold), "links")

    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "node")
    roots = components(found.where("b is not null"), "a", "b")
    about = nodes.select("node", "copies").join(degree, "node", "left").join(roots, "node", "left")
    about = about.select("node", F.coalesce("root", "node").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    about = written(about, "about")
    with_words = signed.where("node is not null").select("doc_id", "row", "node").join(about, "node").select("doc_id", "row", "node", "root", "n_links")
    without = signed.where("node is null").select("doc_id", "row", "node", F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionAll(without)


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    row = free_name(docs.columns, "row_hash")
    return docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), row


def classes(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, class_id (the smallest doc_id of those it is linked to, directly or through others), n_links."""
    with steps(docs.sparkSession):
        rows = written(join(docs, **options), "joined", outlives=True)
    least = written(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id")), "classes")
    return (
        rows.where("root is not null").join(least, "root").select("doc_id", "class_id", "n_links")
        .unionAll(rows.where("root is null").select("doc_id", F.col("doc_id").alias("class_id"), "n_links"))
    )


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without all but the first (by doc_id, nulls last) of each class; columns as they are."""
    with steps(docs.sparkSession):
        rows = written(join(docs, doc_id=doc_id, **options), "joined", outlives=True).where("root is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.groupBy("root").agg(F.min(rank).alias("first")).select("root", F.col("first.row").alias("kept"))
    first = written(first, "firsts")
    gone = rows.join(first, "root").where("row != kept").select("row")
    twice = rows.groupBy("row").agg(F.count("*").alias("times")).where("times > 1").select("row")
    hashed, row = _with_row(docs)
    again = hashed.join(twice.withColumnRenamed("row", row), row, "left_semi").dropDuplicates([row])
    gone = gone.select("row").unionAll(twice).distinct()
    kept = hashed.join(gone.withColumnRenamed("row", row), row, "left_anti")
    # rows that occur more than once, if they are the first of their class, come back once
    again = again.join(first.select(F.col("kept").alias(row)), row, "left_semi")
    return kept.unionByName(again).drop(row)


ship(__name__)
