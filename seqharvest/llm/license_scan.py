"""License scans by an exact set-similarity join (native: DataFrame functions only).

Templates are license notices.  A text block is a line, or a window of the text's
words that is a quarter longer than the template, whatever the line breaks; all are
sets of words.  A block meets a template if it holds at least ``threshold`` of the
template's words (containment).  The join finds every such pair without comparing all:

* words of the templates are ordered by their frequency over all documents,
  rarest first (ties by the word);
* prefix filter: of a template with n words, of which k must be found, at least
  one of the first n - k + 1 in that order must be in the block, so in its document;
  documents and templates are joined by these words;
* length filter: the document must have k of the template's words;
* positional filter: after its first common word, at place i of the template,
  at most n - i of the template's words can be common;
* the blocks of the few candidates left are verified by their whole intersection.

Templates, their words and the prefix index are tables; the plan is the same for
any number of them.  They are a query set, and are broadcast while they have at most
``BROADCAST_ROWS`` rows.  Of the documents, only the template's words that each
holds are kept and shuffled; texts are read once for them, and again where a
candidate stands.

Windows are tried from each word of the template on, which is where a best window
can begin.  Besides, base phrases are looked for in the words of the whole text.

Defined results: a null text is empty, has no words, no labels and score 0.  Equal rows
get equal results, a row each.  A template without words never occurs.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import steps, written
from .common import LOWER, UPPER, free_name, word_array

#: Rows up to which a table of templates, words or found blocks is broadcast.
BROADCAST_ROWS = 200_000
THRESHOLD = 0.8
#: Words of a window for one word of the template.
SLACK = 1.25

# Phrases whose consecutive words give a base label.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# License notices, label -> text.
TEMPLATES = {
    "agpl-notice": "licensed under the gnu affero general public license version 3",
    "apache-notice": "licensed under the apache license version 2.0",
    "apache-warranty": "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by": "licensed under cc by 4.0",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl-notice": "licensed under the gnu lesser general public license version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license version 2.0",
    "rights-reserved": "all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def _words(text: str) -> list[str]:
    return sorted(set(text.replace(".", " ").split()))


def plan(templates: dict[str, str], counts: dict[str, int], threshold: float) -> tuple[list[tuple[str, list[str], int]], list[str]]:
    """(label, words rarest first, least common words) of each template, and all prefix words."""
    rows = []
    for label, body in sorted(templates.items()):
        ws = sorted(_words(body), key=lambda w: (counts.get(w, 0), w))
        if ws:
            rows.append((label, ws, max(1, ceil(threshold * len(ws) - 1e-9))))
    return rows, sorted({w for _, ws, k in rows for w in ws[: len(ws) - k + 1]})


def _lower(text: Column) -> Column:
    """A-Z in lower case; quick where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _listed(spark: SparkSession, rows: list[dict], schema: str, name: str) -> DataFrame:
    """A written table of the rows, made without Python on executors."""
    return written(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))), name)


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _places(ws: Column, phrases: dict[str, str]) -> Column:
    """Where the phrases' words stand, one after another."""
    ends = sorted({p.split()[-1] for p in phrases.values()})

    def here(i: Column, phrase: str) -> Column:
        test = F.lit(True)
        for k, w in enumerate(reversed(phrase.split())):
            test = test & (F.get(ws, i - k) == w)
        return F.coalesce(test, F.lit(False))

    at_end = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(ends), i)), lambda i: i.isNotNull())
    each = F.transform(at_end, lambda i: F.array(*[F.when(here(i, p), F.struct(F.lit(label).alias("label"), (i - len(p.split()) + 1).cast("long").alias("at"))) for label, p in sorted(phrases.items())]))
    return F.filter(F.flatten(each), lambda x: x.isNotNull()).cast(PLACE)


PLACE = "array<struct<label:string,at:bigint>>"
BLOCK = "array<struct<line:int,label:string,containment:double>>"
NOTICE = "array<struct<at:bigint,label:string,containment:double>>"


def _line_blocks(lines: Column, names: Column, least: Column, label: Column) -> Column:
    """Lines (arrays of distinct words) that hold enough of the template's words."""
    sized = F.transform(lines, lambda ws, i: F.struct(i.alias("line"), F.when(F.size(ws) >= least, F.size(F.array_intersect(names, ws))).alias("common")))
    return F.transform(F.filter(sized, lambda x: x["common"] >= least), lambda x: F.struct(x["line"], label.alias("label"), (x["common"] / F.size(names)).cast("double").alias("containment"))).cast(BLOCK)


def _best_window(ws: Column, names: Column, span: Column, least: Column, label: Column) -> Column:
    """The window of ``span`` words with most of the template's words, the first of such, if they are enough."""
    hits = F.filter(F.transform(ws, lambda w, i: F.when(F.array_contains(names, w), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())

    def begun(all_hits: Column) -> Column:
        def at(h: Column, j: Column) -> Column:
            near = F.filter(F.slice(all_hits, j + 1, span), lambda x: x["i"] < h["i"] + span)
            return F.struct(F.size(F.array_distinct(F.transform(near, lambda x: x["w"]))).alias("common"), (-h["i"]).cast("bigint").alias("back"))

        return F.array_max(F.transform(all_hits, at))

    # a one-element array binds the hits, so that they are found once
    best = F.transform(F.array(hits), begun)
    met = F.filter(best, lambda b: b["common"] >= least)
    return F.transform(met, lambda b: F.struct((-b["back"]).alias("at"), label.alias("label"), (b["common"] / F.size(names)).cast("double").alias("containment"))).cast(NOTICE)


def scan(
    docs: DataFrame,
    *,
    keep: list[str],
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The ``keep`` columns with n_words, places (label, word position) of phrases, blocks (line, label, containment) that meet a template, and notices (word position, label, containment), the best window of each template that one meets."""
    made = ("n_words", "places", "blocks", "notices")
    if clash := {k.lower() for k in keep} & {*made}:
        raise ValueError(f"kept columns clash with result columns: {sorted(clash)}")
    spark = docs.sparkSession
    row, body, word, number = (free_name([*keep, *made], x) for x in ("row_hash", "body", "word", "number"))
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in keep], F.lit("/"), text_of)

    with steps(spark):
        # one reading of the texts: a row with the document's results of its own, and one for each word that it has of the templates
        vocabulary = sorted({w for t in templates.values() for w in _words(t)})
        known = _listed(spark, [{number: i, word: w} for i, w in enumerate(vocabulary)], f"`{number}`: int, `{word}`: string", "license-vocabulary")
        ends = sorted({p.split()[-1] for p in phrases.values()})
        source = docs.select(*keep, hashed.alias(row), text_of.alias(word), word_array(text_of).alias(body))
        some = F.col(word).rlike("(?i)(?:" + "|".join(ends) + ")")
        places = F.when(some, _places(F.transform(body, _lower), phrases)).otherwise(F.array().cast(PLACE))
        # a document's own results come first, so that they aren't made again for each of its words
        sized = source.select(*keep, row, F.size(body).cast("long").alias("n_words"), places.alias("places"), F.array_distinct(body).alias(body))
        wide = sized.select(*keep, row, "n_words", "places", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col(body))).alias(word))
        own = F.col(word).isNull()
        wide = wide.withColumn(word, _lower(F.col(word))).join(_near(known, len(vocabulary)), word, "left").where(own | F.col(number).isNotNull())
        wide = written(wide.select(row, number, *[F.when(own, F.col(f"`{c}`")).alias(c) for c in [*keep, "n_words", "places"]]), "license-words", outlives=True)
        base, words = wide.where(F.col(number).isNull()).drop(number), wide.where(F.col(number).isNotNull()).select(F.col(row).alias("id"), F.col(number).alias("number"))

        held = written(words.groupBy("id").agg(F.collect_set("number").alias("held")), "license-held")
        counts = {vocabulary[r["number"]]: r["n"] for r in held.select(F.explode("held").alias("number")).groupBy("number").agg(F.count("*").alias("n")).collect()}
        rows, _ = plan(templates, counts, threshold)
        place = {w: i for i, w in enumerate(vocabulary)}
        listed = [{"template": t, "label": label, "numbers": [place[w] for w in ws], "names": ws, "least": k, "span": ceil(SLACK * len(templates[label].replace(".", " ").split()))} for t, (label, ws, k) in enumerate(rows)]
        table = _near(_listed(spark, listed, "template: int, label: string, numbers: array<int>, names: array<string>, least: int, span: int", "license-templates"), len(listed))
        prefixes = [{"number": n, "template": x["template"], "place": i} for x in listed for i, n in enumerate(x["numbers"][: len(x["numbers"]) - x["least"] + 1])]
        index = _near(_listed(spark, prefixes, "number: int, template: int, place: int", "license-prefixes"), len(prefixes))

        pairs = held.select("id", "held", F.explode("held").alias("number")).join(index, "number").join(table, "template")
        n = F.size("numbers")
        head = F.slice("numbers", F.lit(1), n - F.col("least") + 1)
        # a pair comes once: by the first of the template's words that the document has
        pairs = pairs.where((F.size("held") >= F.col("least")) & (n - F.col("place") >= F.col("least")) & (F.get(F.array_intersect(head, "held"), F.lit(0)) == F.col("number")))
        pairs = pairs.where(F.size(F.array_intersect("numbers", "held")) >= F.col("least")).groupBy("id").agg(F.array_sort(F.collect_set("template")).alias("templates"))
        pairs = written(pairs, "license-candidates")

        texts = docs.select(hashed.alias("id"), text_of.alias("body")).join(_near(pairs, pairs.count()), "id")
        texts = texts.withColumn("body", _lower(F.col("body")))
        parted = texts.select("id", "templates", word_array(F.col("body")).alias("ws"), F.transform(F.split("body", "\n"), lambda s: F.array_distinct(word_array(s))).alias("lines"))
        each = parted.select("id", "ws", "lines", F.explode("templates").alias("template")).join(table, "template")
        met = each.select("id", _line_blocks(F.col("lines"), F.col("names"), F.col("least"), F.col("label")).alias("blocks"), _best_window(F.col("ws"), F.col("names"), F.col("span"), F.col("least"), F.col("label")).alias("notices"))
        met = met.where((F.size("blocks") > 0) | (F.size("notices") > 0)).groupBy(F.col("id").alias("found_id"))
        met = written(met.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("blocks", "notices")]), "license-blocks", outlives=True)
    found = base.join(_near(met, met.count()), F.col(row) == F.col("found_id"), "left")
    return found.select(*[F.col(f"`{k}`") for k in keep], "n_words", "places", F.coalesce("blocks", F.array().cast(BLOCK)).alias("blocks"), F.coalesce("notices", F.array().cast(NOTICE)).alias("notices"))
