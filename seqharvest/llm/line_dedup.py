"""Line dedup by a log-template tree (native: DataFrame functions only).

A line's tokens are what stands between white space; a token with a digit is a
variable field, written ``<*>``.  The tree has a fixed depth: token count, then
``leading`` tokens.  Those are the first ones, or, below a wildcard child, the
first ones but for one position and the token after them; so a line lies in
``leading + 1`` leaves.  Inside a leaf, a line's other tokens are ranked by the
documents that have them at their positions.  The measure is the last token that
must stay so that ``similarity`` of the line's tokens (variable fields left out)
do; it must be held by ``min_docs`` documents.  A token is constant if it is held
by ``common`` of the measure's documents and by ``min_docs``; other tokens are
generalised to ``<*>``.  Counts are compared with counts of the same line only,
so a template stays one when the corpus or other lines of the leaf grow.  A line
without such a measure, or with constant tokens only, is no template of the leaf.
Of a line's templates that ``min_docs`` documents could take, the one that most could
counts (ties: the first ones' leaf, then by the wildcard's position); a line without
one counts as it stands.  What stands in ``exact_docs`` documents recurs, and its
lines are dropped, except for the first by (doc_id, row, line).

Lines of at most ``leading`` tokens are never generalised: with the default similarity none
of their tokens could differ.  Wildcard children hold lines of twice as many tokens, since
in a shorter line a leading token is too much of it to be taken for a field.

Counts are combined before each shuffle, and texts are shuffled once: they are written in buckets of
their rows' hashes, which both the look at single lines and the decisions are joined with as they lie.  All other shuffles are of hashes.
Documents per leaf and token are
summed over distinct lines, so a document that has two lines of one leaf counts
twice there; documents per template are counted exactly.

Defined results: null and empty texts stay as they are; blank lines are no
templates and stay; lines without any constant token are never generalised nor
dropped.  Rows equal in all columns count as one document and are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import cut, steps, written
from .common import free_name

LEADING, MIN_DOCS, SIMILARITY = 3, 3, 0.8
#: Share of the measure's documents that a constant token is held by.
COMMON = 0.8
#: Documents from which on a (masked) line recurs as it stands.
EXACT_DOCS = 2
#: Rows up to which a table of hashes is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000
SPACE = r" \t\r\x0B\f"


def canonical(text: Column) -> Column:
    """The text with variable fields masked and single spaces, line for line."""
    # most texts hold no digit or no wide space at all: a look for one costs less than building the text anew
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, rf"(?<![^\n{SPACE}])[^\n{SPACE}0-9]*+[0-9][^\n{SPACE}]*+", "<*>")).otherwise(text)
    single = F.when(text.rlike(r"[\t\r\x0B\f]|  "), F.regexp_replace(masked, f"[{SPACE}]+", " ")).otherwise(masked)
    return F.trim(F.replace(F.replace(single, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))


def anchors(leading: int) -> list[list[int]]:
    """Positions of the leading tokens of each kind of leaf: the first ones, then those with a wildcard at each position."""
    return [list(range(leading)), *([i for i in range(leading + 1) if i != w] for w in range(leading))]


def least_size(kind: int, leading: int) -> int:
    """Tokens that a line of such a leaf has at least: one that may differ, or below a wildcard twice the leading ones."""
    return 2 * leading if kind else leading + 1


def _leaves(tokens: Column, leading: int) -> list[Column]:
    """A line's leaves, null where the line is too short."""
    leaf = lambda kind, at: F.when(F.size(tokens) >= least_size(kind, leading), F.xxhash64(F.lit(kind), F.size(tokens), *[F.get(tokens, F.lit(i)) for i in at]))
    return [leaf(kind, at).alias(f"leaf{kind}") for kind, at in enumerate(anchors(leading))]


def _small(df: DataFrame) -> DataFrame:
    """df, a written table, for a join: broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def decisions(docs: DataFrame, row: str, *, doc_id: str, text: str, leading: int = LEADING, min_docs: int = MIN_DOCS, exact_docs: int = EXACT_DOCS, similarity: float = SIMILARITY, common: float = COMMON) -> DataFrame:
    """doc, row, and for each of the document's lines whether it is dropped (``drops``, by position); documents that lose nothing are left out."""
    some = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(row).alias("row"), F.col(text).alias("body"))
    lines = some.select("doc", "row", F.posexplode(F.split(canonical(F.col("body")), "\n")).alias("at", "line"))
    tokens = lines.withColumn("tokens", F.split("line", " "))
    constant = F.col("line").rlike(r"(?:^| )(?!<\*>(?: |$))[^ ]")
    held = tokens.select("doc", "row", "at", F.when(constant, F.xxhash64("line")).alias("line_id"), *_leaves(F.col("tokens"), leading))
    held = written(held.where("line_id is not null"), "lines")

    template = _generalised(some, held, leading, min_docs, similarity, common)
    placed = held.join(_small(template), "line_id", "left").select("doc", "row", "at", F.coalesce("template", "line_id").alias("template"))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "at")
    recurring = (
        placed.groupBy("template", "doc", "row").agg(F.min("at").alias("at"))
        .groupBy("template").agg(F.count("*").alias("docs"), F.min(order).alias("first"))
        .where(F.col("docs") >= exact_docs)
    )
    recurring = written(recurring.select("template", "first"), "templates")
    gone = placed.join(_small(recurring), "template").where(order != F.col("first")).select("doc", "row", "at")
    gone = gone.groupBy("doc", "row").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # sorted positions -> one flag a line, so that a text is filtered in one pass
    flags = F.zip_with(
        F.concat(F.array(F.lit(-1)), "at"),
        "at",
        lambda a, b: F.when(b.isNull(), F.array().cast("array<boolean>")).otherwise(F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))),
    )
    return gone.select("doc", "row", F.flatten(flags).alias("drops"))


def _generalised(some: DataFrame, held: DataFrame, leading: int, min_docs: int, similarity: float, common: float) -> DataFrame:
    """line_id, template of the lines that are generalised (written)."""
    kinds = anchors(leading)
    names = [f"leaf{k}" for k in range(len(kinds))]
    least_of = lambda: [F.min(n).alias(n) for n in names]
    once = held.where("leaf0 is not null").groupBy("line_id", "row").agg(F.min("at").alias("at"), *least_of())
    per_line = once.groupBy("line_id").agg(F.count("*").alias("docs"), F.min_by("at", "row").alias("at"), F.min("row").alias("row"), *least_of())
    per_line = written(per_line, "distinct-lines")
    leafed = per_line.select("line_id", "docs", "row", "at", F.posexplode(F.array(*names)).alias("kind", "leaf")).where("leaf is not null")
    shared = written(leafed.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs")).where(f"lines > 1 and docs >= {min_docs}").select("leaf"), "leaves")
    near = written(leafed.join(_small(shared), "leaf", "left_semi"), "near-lines")

    # the tokens of each line, from the first row that has it
    wanted = near.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "line_id"))).alias("wanted"))
    wanted = written(wanted.withColumnRenamed("row", "wanted_row"), "wanted-lines")
    found = some.select("row", "body").join(wanted, F.col("row") == F.col("wanted_row")).select("wanted", F.split(canonical(F.col("body")), "\n").alias("lines"))
    found = found.select("lines", F.inline("wanted")).select("line_id", F.split(F.get("lines", F.col("at")), " ").alias("tokens")).dropDuplicates(["line_id"])
    counted = written(near.select("line_id", "leaf", "kind", "docs").join(found, "line_id"), "leaf-lines")

    by_kind = lambda f: F.get(F.array(*[f(at) for at in kinds]), F.col("kind"))
    fixed = by_kind(lambda at: F.array(*map(F.lit, at)))
    places = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: ~F.array_contains(fixed, i))
    counted = counted.join(_small(_open_leaves(counted, places, min_docs, similarity)), "leaf", "left_semi")
    lead = F.size(F.filter(fixed, lambda i: F.get("tokens", i) != "<*>"))
    free = F.filter(F.transform(places, lambda i: F.struct(i.alias("at"), F.get("tokens", i).alias("token"))), lambda x: x["token"] != "<*>")
    pairs = counted.select(F.xxhash64("line_id", "leaf").alias("pair"), "line_id", "leaf", "kind", "docs", lead.alias("lead"), F.size(free).alias("n"), F.transform(free, lambda x: F.xxhash64("leaf", x["at"], x["token"])).alias("keys"))
    pairs = written(pairs.where("n > 0"), "leaf-keys")
    place = pairs.select("pair", "docs", F.explode("keys").alias("key"))
    # written, so that both sides of the join are plain shuffles, which Spark splits at hot keys
    often = written(place.groupBy("key").agg(F.sum("docs").alias("held")).where(F.col("held") >= min_docs), "leaf-tokens")
    # most held first; tokens below min_docs are never constant and need no key
    ranked = place.select("pair", "key").join(often, "key").groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("held", "key")), asc=False).alias("ranked"))
    per = pairs.drop("keys", "docs").join(ranked, "pair")
    least = F.ceil(F.lit(similarity) * (F.col("lead") + F.col("n")) - 1e-9) - F.col("lead")
    per = per.withColumn("measure", F.get("ranked", F.greatest(F.lit(0), least - 1).cast("int"))["held"]).where("measure is not null")
    per = per.withColumn("stay", F.transform(F.filter("ranked", lambda x: x["held"] >= F.lit(common) * F.col("measure")), lambda x: x["key"]))
    could = per.where(F.size("stay") < F.col("n")).select("line_id", "kind", F.xxhash64("leaf", F.array_sort("stay")).alias("template"))
    could = written(could, "generalised")

    docs_of = held.select("line_id", "row").join(_small(could), "line_id").select("template", "row").distinct().groupBy("template").agg(F.count("*").alias("docs"))
    docs_of = written(docs_of.where(F.col("docs") >= min_docs), "template-documents")
    best = could.join(_small(docs_of), "template").groupBy("line_id").agg(F.max_by("template", F.struct("docs", -F.col("kind"))).alias("template"))
    return written(best, "line-templates")


def _open_leaves(counted: DataFrame, places: Column, min_docs: int, similarity: float) -> DataFrame:
    """The leaves in which a line could have a measure (written).

    A line may miss at most a share of 1 - similarity of its tokens, so one of its first ones, one more than
    that, must be held by ``min_docs`` documents.  A leaf's lines are equally long, so they are looked at in the same places.
    """
    probes = F.floor((1 - F.lit(similarity)) * F.size("tokens") + 1e-9).cast("int") + 1
    first = F.transform(F.slice(places, F.lit(1), probes), lambda i: F.struct(i.alias("at"), F.get("tokens", i).alias("token")))
    probed = counted.select("leaf", "docs", first.alias("first"))
    masked = probed.where(F.exists("first", lambda x: x["token"] == "<*>")).select("leaf")
    key = F.xxhash64("leaf", "at", "token")
    held = probed.select("leaf", "docs", F.inline("first")).select("leaf", "docs", key.alias("key")).groupBy("leaf", "key").agg(F.sum("docs").alias("held"))
    return written(masked.unionAll(held.where(F.col("held") >= min_docs).select("leaf")).distinct(), "open-leaves")


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None, drop_emptied: bool = False, **options) -> DataFrame:
    """The documents with their recurring lines dropped; columns as they are.

    counts: names of two more columns, lines before and lines dropped.
    drop_emptied: documents of which every line that is not blank is dropped go.
    """
    row = free_name(docs.columns, "row_hash")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    names = [free_name([*docs.columns, row], x) for x in ("dedup_doc", "dedup_row", "dedup_drops")]
    with steps(docs.sparkSession):
        hashed = cut(hashed.repartition(parts, row), row, codec="zstd", outlives=True)
        found = written(decisions(hashed, row, doc_id=doc_id, text=text, **options).toDF(*names), "line-decisions", outlives=True)
    who, which, drops = (F.col(n) for n in names)
    # the documents' ids are compared, but not joined by, so that the buckets serve the join
    same = F.coalesce(F.col(f"`{doc_id}`") == who, F.col(f"`{doc_id}`").isNull() & who.isNull())
    joined = hashed.join(found, (F.col(row) == which) & same, "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda line, i: ~F.coalesce(F.get(drops, i), F.lit(False)))
    out = F.when(drops.isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    extra = []
    if counts:
        extra = [
            F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counts[0]),
            F.coalesce(F.size(F.filter(drops, lambda x: x)), F.lit(0)).cast("long").alias(counts[1]),
        ]
    done = joined.select(*[out.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *extra, drops.isNotNull().alias(names[2]))
    if drop_emptied:
        done = done.where(~F.col(names[2]) | F.col(text).rlike(r"\S"))
    return done.drop(names[2])
