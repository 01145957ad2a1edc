"""Text operators against plain restatements: fingerprints, cuts in blocks, codes, rules and weights."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqharvest.llm import decontaminate, quality_rules, queries, token_output, winnowing

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_winnow(text, k=winnowing.K, window=winnowing.WINDOW):
    """(hash, position) chosen, one window after another."""
    kept = [(i, ord(c.lower()) + 1 if c.isascii() else ord(c) + 1) for i, c in enumerate(text) if not c.isascii() or c.isalnum()]
    if not kept:
        return []

    def value(codes):
        h = 0
        for c in codes:
            h = (h * int(winnowing.MULT) + c) % 2**64
        return ((h ^ (h >> 29)) * int(winnowing.MIX)) % 2**64 >> 32

    hashes = [value([c for _, c in kept[i : i + k]]) for i in range(max(1, len(kept) - k + 1))]
    out = []
    for lo in range(max(1, len(hashes) - window + 1)):
        part = hashes[lo : lo + window]
        at = lo + max(i for i, h in enumerate(part) if h == min(part))
        if not out or out[-1][0] != at:
            out.append((at, hashes[at]))
    return [(h, kept[at][0]) for at, h in out]


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_winnow_against_plain_windows(monkeypatch, piece):
    monkeypatch.setattr(winnowing, "PIECE", piece)
    rng = random.Random(9)
    texts = ["", " \n", "a", "aaaaaaaaaa" * 12, "ab" * 60, "Üñ漢 😀" * 30]
    texts += ["".join(rng.choice("aB c.é") for _ in range(rng.randint(0, 260))) for _ in range(60)]
    for t in texts:
        hashes, places = winnowing.winnow(t)
        assert list(zip(hashes.tolist(), places.tolist())) == slow_winnow(t), t[:40]


def test_winnow_of_a_very_long_text():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefgh "), winnowing.PIECE + 5000))
    hashes, places = winnowing.winnow(text)
    # windows about the piece's end are chosen as in the text cut out around it
    lo = winnowing.PIECE - 2000
    part = [(h, p + lo) for h, p in slow_winnow(text[lo : lo + 6000])]
    got = list(zip(hashes.tolist(), places.tolist()))
    assert set(part[20:-20]) <= set(got) and len([p for _, p in got if part[20][1] <= p <= part[-20][1]]) == len(part[20:-19])


def test_fingerprint_query_against_plain_windows(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    some = set(sorted(ids, key=lambda i: len(texts[i]))[:60])
    got = {r["doc_id"]: r for r in queries.op7_winnowing(spark, DATA).collect()}
    assert set(got) == set(ids)
    as_text = lambda pairs: "".join(f"{h:08x}" for h in sorted({h for h, _ in pairs}))
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        if a not in some:
            continue
        t, r, n = texts[a], got[a], len(texts[a])
        edited = t[: n - n // 2] + texts[b][: n // 2]
        own, other, after = (slow_winnow(x) for x in (t, edited, texts[b][:40_000]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_text(own), as_text(other))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [{h for h, _ in x} for x in (own, other, after)]
        assert np.isclose(r["near_edited"], alike(*sets[:2]))
        if len(texts[b]) <= 40_000:
            assert np.isclose(r["near_next"], alike(sets[0], sets[2]))
        first = {}
        for h, p in own:
            first.setdefault(h, p)
        assert r["positions"] == [first[h] for h in sorted(first)]


def test_next_document_with_ties_nulls_and_hot_ids(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 - i, f"text number {i // 6} of the table", "en", "s", 1) for i in range(600)]
    rows += [(-(2**63), "least", "en", "s", 1), (2**63 - 1, "most", "en", "s", 1), (2**60 + 1, "large", "en", "s", 1)]
    got = winnowing.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] and abs(r["doc_id"]) > 2**59}
    edited = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    assert by_id[2**63 - 1]["edited_sha256"] == edited("most", "large")
    # rows of a tie follow one another: of 100 equal texts of an id, all but the last are followed by their like, wherever ranges end
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] is None) == 100
    # the last one's next is the first
    last = [r for r in got if r["doc_id"] is None and r["edited_sha256"] in {edited(t, "most") for _, t, *_ in rows}]
    assert len(last) == 1


def test_cuts_do_not_depend_on_blocks(spark):
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (None, "null item"), (4, "null item")], "item_id long, text string")
    rows = [
        (1, " ".join([*a, *b, "five", "more", "words", "stand", "here"])),  # both items cover 24 of 29 words
        (2, " ".join(["x"] * 9 + a[:6] + b + a[6:] + ["y"] * 30)),  # the cut of b joins the halves of a
        (3, "clean text"),
        (4, None),
        (4, ""),
        (5, "a null item here and more words than that"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    cut = lambda n: sorted(map(str, decontaminate.strip(docs, items, max_coverage=0.8, block_words=n).collect()))
    assert cut(3) == cut(14) == cut(10**6)
    kept = {r["doc_id"]: r["text"] for r in decontaminate.strip(docs, items, block_words=3).collect()}
    assert 1 not in kept and kept[2].split() == ["x"] * 9 + ["y"] * 30 and kept[3] == "clean text"
    found = lambda n: sorted(map(str, decontaminate.scan(docs, items, keys=["doc_id"], block_words=n).collect()))
    assert found(3) == found(14) == found(10**6)
    assert decontaminate.scan(docs, items, keys=["doc_id"]).where("doc_id = 5").first()["items"] == ["4", "null"]


@pytest.mark.parametrize("seed", range(6))
def test_many_blocks_find_what_one_finds(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = spark.createDataFrame([(i, text(rng.randint(0, 9))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, text(rng.randint(0, 40)), "en", "s", 1) for i in range(12)], SCHEMA).coalesce(2)
    cut = lambda n: sorted(map(str, decontaminate.strip(docs, items, window=4, max_coverage=0.99, block_words=n).collect()))
    assert cut(3) == cut(10**6)


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(30)
    token_output.write(docs, str(tmp_path / "f"), name)
    tok = Tokenizer.from_file(name)
    want = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_output.read(spark, str(tmp_path / "f")).collect()} == want


def test_codes_of_more_than_65536_ids():
    rng = np.random.default_rng(2)
    counts = rng.zipf(1.5, 90_000) % 10**6 + 1
    size = token_output.code_lengths(counts)
    assert token_output.LIMIT < size.max() <= 18
    ids = np.concatenate([rng.permutation(90_000), rng.choice(90_000, 5000, p=counts / counts.sum())])
    payload, marks = token_output.pack(ids, token_output.canonical(size), size)
    assert (token_output.unpack(payload, marks, len(ids), *token_output.table(size)) == ids).all()


def test_lasso_weights_are_optimal():
    rng = np.random.default_rng(5)
    r = (rng.random((600, 25)) < 0.4).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1] + 0.2)))).astype(float)
    penalty = 0.01
    start, w = quality_rules.lasso(r, y, penalty)
    p = 1 / (1 + np.exp(-(start + r @ w)))
    slope = r.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-3
    assert np.all(np.abs(slope[w == 0]) <= penalty + 1e-3) and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-3)
    assert 0 < (w != 0).sum() < 25


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    values = np.asarray(score)[order]
    edge = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    for a, b in zip(edge, [*edge[1:], len(values)]):
        rank[order[a:b]] = (a + b + 1) / 2
    pos = np.asarray(label) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_query_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    got = queries.op9_quality(spark, data)
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert {r["held_out"] for r in got.collect()} == {True, False}
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert auc([r["score"] for r in rows], [r["quality"] for r in rows]) > 0.9


def test_compiled_rules_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality_rules.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert model.rules
    stats = {r["doc_id"]: r.asDict() for r in quality_rules.statistics(docs, keep=["doc_id"]).collect()}
    for r in quality_rules.score(docs, model, keep=["doc_id"]).collect():
        x = stats[r["doc_id"]]
        total = model.intercept + sum(w for conditions, w in model.rules if all((x[f] > bound) == over for f, over, bound in conditions))
        assert np.isclose(r["score"], 1 / (1 + np.exp(-total)), rtol=1e-9)


def test_clashing_names_in_every_operator(spark):
    from seqharvest.llm import langid, license_scan, packing, pii

    extra = "body int, row_hash int, hit_spans int, key int, range int, closes int, hashes_ int, all_words_ int"
    docs = spark.createDataFrame([(1, "hello there my friend of old", *range(8)), (2, None, *range(8))], f"doc_id long, text string, {extra}")
    items = spark.createDataFrame([(1, "there my friend")], "item_id long, text string")
    assert decontaminate.strip(docs, items, block_words=1).columns == docs.columns
    assert decontaminate.scan(docs, items, keys=["doc_id", "body"]).count() == 2
    assert winnowing.compare_with_next(docs).count() == 2
    assert winnowing.fingerprints(docs, keep=["doc_id", "body"]).count() == 2
    assert packing.pack(docs, keep=["doc_id", "body", "key"], length=F.length("text")).count() == 2
    assert license_scan.scan(docs, keep=["doc_id", "row_hash"]).count() == 2
    assert pii.find(docs, keep=["doc_id", "row_hash"]).count() == 2
    model = langid.fit(docs.withColumn("lang", F.lit("en")), vocab_path=queries.piece_vocabulary(), sample_by=F.xxhash64("doc_id"))
    assert langid.predict(docs, model, keep=["doc_id", "row_hash"]).count() == 2
    assert quality_rules.score(docs, quality_rules.Model(0.0), keep=["doc_id", "row_hash"]).count() == 2


def test_leading_fields_and_shared_values(spark):
    from seqharvest.llm import line_dedup

    names = ["alpha", "alpha", "alpha", "beta", "gamma"]
    rows = [(i, f"we thank you {x} for visiting our shop today", "en", "s", 1) for i, x in enumerate(names)]
    rows += [(10 + i, f"Hello dear {x} and welcome to the shop", "en", "s", 1) for i, x in enumerate(["ann", "bob", "cid", "dan"])]
    rows += [(20 + i, f"{x} has sent you a new message", "en", "s", 1) for i, x in enumerate(["Ann", "Bob", "Cid"])]
    # two documents are no template, nor are other words in other places
    rows += [(30, "good morning uma and have a nice day", "en", "s", 1), (31, "good morning ugo and have a nice day", "en", "s", 1)]
    rows += [(40 + i, t, "en", "s", 1) for i, t in enumerate(["the old man and his sea boat", "the red fox and her den hole", "the new sun and our moon light"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = {0, 10, 20, 30, 31, 40, 41, 42}
    assert got == {i: t if i in kept else "" for i, t, *_ in rows}


def test_notices_against_every_window(spark):
    from math import ceil

    from seqharvest.llm import license_scan

    rng = random.Random(3)
    templates = {f"t{i}": " ".join(rng.choice("abcdefghijklm") + rng.choice("xyz") for _ in range(rng.randint(2, 14))) for i in range(12)}
    pool = sorted({w for t in templates.values() for w in t.split()}) + ["other", "words"]

    def text():
        out = []
        for _ in range(rng.randint(0, 5)):
            ws = rng.choice(list(templates.values())).split()
            out += [w if rng.random() < 0.85 else rng.choice(pool) for w in ws] + [rng.choice(pool) for _ in range(rng.randint(0, 8))]
        return "".join(w + rng.choice([" ", " ", "\n", ", "]) for w in out)

    rows = [(i, text(), "en", "s", 1) for i in range(60)] + [(60, None, "en", "s", 1), (61, rng.choice(list(templates.values())), "en", "s", 1)] * 2
    got = license_scan.scan(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"], templates=templates)
    assert got.count() == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    split = lambda t: t.replace(",", " ").split()
    met = 0
    for r in got.collect():
        lines, windows = set(), {}
        for label, body in templates.items():
            want, span = set(body.split()), ceil(license_scan.SLACK * len(body.split()))
            least = ceil(0.8 * len(want) - 1e-9)
            for n, line in enumerate(texts[r["doc_id"]].split("\n")):
                if len(want & set(split(line))) >= least:
                    lines.add((n, label, len(want & set(split(line))) / len(want)))
            ws = split(texts[r["doc_id"]])
            best = max([(len(want & set(ws[i : i + span])), -i) for i in range(len(ws)) if ws[i] in want], default=(0, 0))
            if best[0] >= least:
                windows[label] = (-best[1], best[0] / len(want))
        assert {tuple(b) for b in r["blocks"]} == lines
        assert {b["label"]: (b["at"], b["containment"]) for b in r["notices"]} == windows
        met += len(lines) + len(windows)
    assert met > 50


def test_plan_does_not_grow_with_templates(spark):
    from seqharvest.llm import license_scan

    rng = random.Random(1)
    templates = {f"t{i}": " ".join(f"w{rng.randint(0, 20_000)}" for _ in range(300)) for i in range(500)}
    rows = [(1, "first " + "\n".join(templates["t7"].split()) + " last", "en", "s", 1), (2, "w1 w2 w3 nothing", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = license_scan.scan(docs, keep=["doc_id"], templates=templates)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {r["doc_id"]: r for r in out.collect()}
    assert [(b["label"], b["at"], b["containment"]) for b in got[1]["notices"]] == [("t7", 1, 1.0)] and not got[2]["notices"]


def signed(spark, texts):
    from seqharvest.llm import jaccard_join

    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    hashed, row = jaccard_join._with_row(docs)
    options = {"threshold": 0.8, "trees": jaccard_join.TREES, "recall": jaccard_join.RECALL}
    _, nodes = jaccard_join.signed_nodes(hashed, row, doc_id="doc_id", text="text", ngram=5, **options)
    return docs, nodes


def found_pairs(spark, sets, trees, recall):
    """(share of the pairs (0, 1), (2, 3) ... of sets that are candidates, nodes with a tree whose prefix isn't the shortest, and with one that isn't the longest)."""
    import numpy as np
    import pandas as pd

    from seqharvest.llm import jaccard_join

    sign = jaccard_join._signer(trees, jaccard_join.prefix_depth(0.8, trees, recall))
    rows = [(i, i, len(s), 1, x.tolist()) for lo in range(0, len(sets), 500) for i, (s, x) in enumerate(zip(sets[lo : lo + 500], sign(sets[lo : lo + 500])), lo)]
    nodes = spark.createDataFrame(pd.DataFrame(rows, columns=["node", "row", "n", "copies", "labels"]), "node long, row long, n long, copies long, labels array<long>")
    paths, tiles = jaccard_join.candidates(nodes, trees=trees, recall=recall)
    # a tile's rows may hold several pairs: each pair is looked for in its own right
    about = {r["node"]: (np.array(r["labels"]), r["levels"]) for r in paths.select("node", "labels", "levels").collect()}
    met = 0
    for i in range(0, len(sets), 2):
        if i in about and i + 1 in about:
            (x, a), (y, b) = about[i], about[i + 1]
            met += any(x[t] and (x[t] ^ y[t]) >> 8 * (2 - min(a >> 2 * t & 3, b >> 2 * t & 3)) == 0 for t in range(trees))
    long = sum(any(x[t] and level >> 2 * t & 3 for t in range(trees)) for x, level in about.values())
    short = sum(any(x[t] and level >> 2 * t & 3 < 2 for t in range(trees)) for x, level in about.values())
    return met / (len(sets) // 2), long, short, tiles


def made_pairs(n, templates, seed=5):
    """Pairs of sets of Jaccard 0.8, 80 of 100; sets of a template have 40 in common, pairs of them 0.29 at most."""
    import numpy as np

    rng = np.random.default_rng(seed)
    fresh = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    parts = [fresh(40) for _ in range(templates)]
    out = []
    for i in range(n):
        common = np.concatenate([parts[i % templates], fresh(40)]) if templates else fresh(80)
        out += [np.unique(np.concatenate([common, fresh(10)])) for _ in range(2)]
    return out


@pytest.mark.parametrize("recall,templates", [(0.97, 0), (0.99, 0), (0.97, 60), (0.99, 60)])
def test_the_forest_finds_what_it_is_asked_for(spark, recall, templates):
    got, long, short, tiles = found_pairs(spark, made_pairs(6_000, templates), 10, recall)
    assert got >= recall - 2 * (recall * (1 - recall) / 6_000) ** 0.5, got
    assert short > 5_000  # prefixes are shortened ...
    assert not templates or long > 1_000  # ... but not all of them where much is shared


def test_the_forest_of_the_query_finds_almost_all(spark):
    assert found_pairs(spark, made_pairs(3_000, 0), 30, 0.9995)[0] >= 0.999


def test_levels_of_a_node():
    from math import log1p

    from seqharvest.llm.jaccard_join import levels

    # nothing but what shares the longest prefix: nothing to shorten
    assert levels([(0, 2, 2, 2), (3, 5, 5, 5)], 0.8, 4, 10, 0.99) == [(0, 2), (3, 2)]
    # few trees hold anything: all are shortened
    assert levels([(0, 2, 1, 1), (3, 9, 4, 1)], 0.8, 4, 10, 0.99) == [(0, 0), (3, 0)]
    # the cheapest steps come first, and no more of them than are needed
    entries = [(t, 2 + t, 1, 1) for t in range(10)]
    got = levels(entries, 0.8, 4, 10, 0.985)
    missed = [log1p(-(0.8 ** (4 + k))) for k in range(3)]
    n = sum(k == 0 for _, k in got)
    assert [k for _, k in got] == [0] * n + [2] * (10 - n) and n * missed[0] + (10 - n) * missed[2] <= log1p(-0.985) < (n - 1) * missed[0] + (11 - n) * missed[2]


def test_a_chain_is_compared_in_linear_time(spark):
    from seqharvest.llm import jaccard_join

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(40 * 600 + 200)]
    counted = {}
    for n in (150, 600):
        # neighbours share 80 of 160 shingles: Jaccard 0.5
        docs, nodes = signed(spark, [" ".join(words[40 * i : 40 * i + 124]) for i in range(n)])
        counted[n] = jaccard_join.candidates(nodes)[1].groupBy().sum("pairs").first()[0] or 0
        got = jaccard_join.classes(docs).collect()
        assert all((r["class_id"], r["n_links"]) == (r["doc_id"], 0) for r in got)
    assert counted[600] <= 600 and counted[600] <= 8 * max(20, counted[150])


@pytest.mark.parametrize("chunk", [4, 512])
def test_links_of_a_large_group(spark, monkeypatch, chunk):
    from seqharvest.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", chunk)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(70):
        ws = base[:]
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(ws))
    texts += texts[:9] + ["", "one two"] * 2
    docs, _ = signed(spark, texts)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [[j for j, b in enumerate(sets) if j != i and a and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    got = {r["doc_id"]: r for r in jaccard_join.classes(docs).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == [len(x) for x in links]
    for i, x in enumerate(links):
        assert all(got[j]["class_id"] == got[i]["class_id"] for j in x)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as pipe

    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n ", "en", "a", 3), (None, "no id here at all", "en", "a", 1), (5, "same words same words same words", "en", "a", 1)]
    rows += [rows[-1], (6, "word " * 30_000, "en", "a", 1), (7, "x" * 150_000, "en", "a", 1)]
    odd = spark.createDataFrame(rows, SCHEMA)
    with_extra = odd.withColumn("row_hash", F.lit(1)).withColumn("body", F.lit("x"))
    for docs in (odd, with_extra, odd.limit(0)):
        n = docs.count()
        for name, stage in pipe.STAGES[1:]:
            out = stage(spark, docs, DATA)
            assert out.count() <= n, name
            if name != "packing":
                assert tuple(out.columns) == pipe.COLUMNS, name
    kept = {r["doc_id"] for r in pipe.near_copies(spark, odd, DATA).collect()}
    assert kept == {1, 2, 3, None, 5, 6, 7} and pipe.near_copies(spark, odd, DATA).count() == len(rows) - 1
    assert pipe.lines(spark, odd, DATA).count() == len(rows) == pipe.packed(spark, odd, DATA).count() == pipe.benchmark(spark, odd, DATA).count()
    assert pipe.language(spark, odd.limit(0), DATA).count() == 0
