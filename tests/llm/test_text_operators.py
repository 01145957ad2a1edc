"""Text operators: brute force on small tables, and defined results for odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqharvest.llm import decontaminate, graph, jaccard_join, langid, license_scan, line_dedup, packing, pii, quality_rules, queries, token_output, winnowing

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, "   \n\n ", None, "a", 3),
    (4, "one", "en", "a", 3),
    (None, "no id here at all", "en", "a", 1),
    (5, "same same same same same same", "en", "a", 1),
    (5, "same same same same same same", "en", "a", 1),
    (6, "word " * 30_000, "en", "a", 1),
    (7, "x" * 150_000, "en", "a", 1),
    (8, "12 " * 2_000, "en", "a", 1),
    (9, "Ünïcode é £ 漢字 \U0001f600 tail", "de", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("seed", range(40))
def test_automaton(seed):
    rng = random.Random(seed)
    for _ in range(20):
        abc, window = [b"a", b"b", b"c"][: rng.randint(1, 3)], rng.randint(2, 4)
        items = [(str(i), [rng.choice(abc) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(1, 5))]
        ws = [rng.choice([*abc, b"z"]) for _ in range(rng.randint(0, 25))]
        hit, seen = set(), set()
        for key, it in items:
            for win in [it] if 0 < len(it) < window else [it[i : i + window] for i in range(len(it) - window + 1)]:
                for p in range(len(ws) - len(win) + 1):
                    if ws[p : p + len(win)] == win:
                        seen.add(key)
                        hit |= set(range(p, p + len(win)))
        spans, got = decontaminate.Automaton(items, window).scan(ws)
        assert ({j for a, b in spans for j in range(a, b)}, got) == (hit, seen)


def test_decontaminate_in_blocks_and_cut(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "short item"), (3, None), (4, "same same same")], "item_id long, text string")
    rows = [(20, "x a b c d e f g h i j k y short item z", "en", "s", 1), (21, "clean text", "en", "s", 1)]
    both = odd.unionByName(spark.createDataFrame(rows, SCHEMA))
    one = decontaminate.scan(both, items, keys=["doc_id"])
    many = decontaminate.scan(both, items, keys=["doc_id"], block_words=3)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(one) == order(many)
    r = one.where("doc_id = 20").first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (16, 13, ["1", "2"])
    kept = {r["doc_id"]: r["text"] for r in decontaminate.strip(both, items, max_coverage=0.9).collect()}
    assert words(kept[20]) == ["x", "y", "z"] and kept[21] == "clean text" and 5 not in kept and kept[1] is None
    assert decontaminate.scan(empty, items, keys=["doc_id"]).count() == 0
    assert decontaminate.scan(both, items.limit(0), keys=["doc_id"]).where("n_hit > 0").count() == 0


def test_decontaminate_query(spark, texts):
    windows = {}
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r["text"])
        for p in [tuple(w)] if 0 < len(w) < 10 else [tuple(w[k : k + 10]) for k in range(len(w) - 9)]:
            windows.setdefault(p, set()).add(str(r["item_id"]))
    for r in queries.op2_decontaminate(spark, DATA).collect():
        w, hit, items = words(texts[r["doc_id"]]), set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit |= set(range(k, k + n))
        want = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
        assert tuple(r)[1:] == want


def test_language(spark, odd, empty, docs):
    got = queries.op3_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    model = langid.fit(odd.unionByName(docs.select(odd.columns)), vocab_path=queries.piece_vocabulary(), sample_by=F.xxhash64("doc_id"))
    rows = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.predict(odd, model, keep=["doc_id"]).collect()}
    assert rows[1, "und"] == rows[2, "und"] == rows[3, "und"] == rows[8, "und"] == 0
    assert langid.predict(empty, langid.fit(empty, vocab_path=queries.piece_vocabulary(), sample_by=F.xxhash64("doc_id")), keep=["doc_id"]).count() == 0


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a", "ba"])
    rng = np.random.default_rng(1)
    prob = np.vstack([rng.random((pieces.n, 2)) / 10, np.zeros((1, 2))])
    model = langid.Model(["x", "y"], pieces, prob)
    low = sorted(["▁", "a", "b", "ab", "▁a", "ba"])

    def total(s, k):
        if not s:
            return 1.0
        return langid.ESCAPE * total(s[1:], k) + sum(prob[low.index(p), k] * total(s[len(p) :], k) for p in low if s.startswith(p))

    for word in ("a", "ab", "abab", "bz"):
        assert np.allclose(np.exp(model.word_scores([word])[0]), [total("▁" + word, k) for k in (0, 1)])


def test_tokens_round_trip(spark, odd, empty, docs, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    name = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(name)
    special = spark.createDataFrame([(10**6, "hello <|endoftext|> world", "en", "s", 1), (10**6 + 1, "<|endoftext|>", "en", "s", 1)], SCHEMA)
    both = odd.where("doc_id is not null").unionByName(special).unionByName(docs.where("doc_id > 20").select(odd.columns))
    token_output.write(both, str(tmp_path / "f"), name)
    start = 0
    got = sorted(token_output.read(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    want = sorted(both.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    for r, d in zip(got, want):
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], list(np.frombuffer(r["ids"], "<u4"))) == (start, len(ids), ids)
        start += len(ids)
    token_output.write(empty, str(tmp_path / "e"), name)
    assert token_output.read(spark, str(tmp_path / "e")).count() == 0


def test_rows_without_an_id_are_dealt_out(spark, tmp_path):
    import public_tokenizers

    name = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(None, f"text {i} of many") for i in range(10_000)] + [(7, "x"), (None, None), (-3, "y")], "doc_id long, text string")
    parts = token_output.tokenized(docs, name).where("start is not null").groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(parts) == 4 and max(r["n"] for r in parts) < 5_000
    token_output.write(docs, str(tmp_path / "f"), name)
    got = sorted(token_output.read(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 10_001 + [-3, 7]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]


def test_encoder_on_odd_spaces():
    import public_tokenizers

    enc, rng = token_output.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read()), random.Random(3)
    abc = [" ", "\n", "a", "B", "foo", "'s", "\t", "é", "1", " x", "  ", "　", "\x1c", ".", "<|endoftext|>"]
    many = ["".join(rng.choice(abc) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in enc(many)] == [x.tolist() for x in enc.whole(many)]


@pytest.mark.parametrize("n", [1, 2, 3, 40, 3000])
def test_huffman(n):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.3, n) % 10**9 + 1
    size = token_output.code_lengths(counts)
    assert size.max() <= token_output.LIMIT and (2.0**-size).sum() <= 1 + 1e-9
    ids = rng.choice(n, 5000, p=counts / counts.sum())
    payload, marks = token_output.pack(ids, token_output.canonical(size), size)
    assert (token_output.unpack(payload, marks, len(ids), *token_output.table(size)) == ids).all()


def shingle_sets(rows):
    out = {}
    for i, t in rows.items():
        w = words(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_jaccard(spark, docs, texts):
    sets = shingle_sets(texts)
    degree, root = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            degree[a] += 1
            degree[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for r in jaccard_join.classes(docs).collect():
        assert (r["class_id"], r["n_links"]) == (find(r["doc_id"]), degree[r["doc_id"]])
    assert {r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()} == {find(i) for i in sets}


def test_jaccard_odd_rows_and_chunks(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", 4)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    base = [f"w{i}" for i in range(200)]
    near = [(100 + i, " ".join(base[:i] + [f"new{i}"] + base[i:]), "en", "a", 1) for i in range(20)]
    got = jaccard_join.classes(spark.createDataFrame(near, SCHEMA)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(100, 19)}
    rows = jaccard_join.classes(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(r["n_links"] for r in rows if r["doc_id"] == 5) == [1, 1]
    assert sum(r["n_links"] for r in rows) == 2
    assert jaccard_join.one_of_each(odd).count() == len(ODD) - 1
    assert jaccard_join.classes(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1), (1, 2)], "a long, b long")
    assert {tuple(r) for r in graph.components(edges, "a", "b").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}


def test_packing(spark, odd, empty):
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 9)
        sizes, counts, k = np.array(sorted(rng.sample(range(40), n))), np.array([rng.randint(1, 9) for _ in range(n)]), rng.randint(1, 5)
        waste = lambda b: sum(c * (min(x for x in b if x >= s) - s) for s, c in zip(sizes.tolist(), counts.tolist()))  # noqa: B023, E731
        best = min(waste((*c, int(sizes[-1]))) for c in itertools.combinations(sizes[:-1].tolist(), min(k, n) - 1))
        assert waste(packing.boundaries(sizes, counts, k)) == best
    got = packing.pack(odd, keep=["doc_id", "n_chars"], length=F.length("text"), budget=100).collect()
    assert len(got) == len(ODD)
    assert len({(r["bucket"], r["batch"], r["place"]) for r in got}) == len(got)
    for r in got:
        assert r["padding"] == r["bucket"] - r["length"] >= 0 and (r["place"] + 1) * r["bucket"] <= max(100, r["bucket"])
    assert packing.pack(empty, keep=["doc_id"], length=F.length("text")).count() == 0


def test_winnowing(spark, odd, empty, texts):
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in queries.op7_winnowing(spark, DATA).collect()}
    prints = {}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, r = texts[a], got[a]
        n = len(t)
        edited = t[: n - n // 2] + texts[b][: n // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["near_next"] == winnowing.likeness(*(np.unique(winnowing.winnow(x)[0]) for x in (t, texts[b])))
    assert winnowing.compare_with_next(odd).count() == len(ODD)
    assert winnowing.compare_with_next(odd.where("doc_id is null")).count() == 1
    assert winnowing.compare_with_next(empty).count() == 0
    assert winnowing.fingerprints(odd, keep=["doc_id"]).count() == len(ODD)


def test_shared_passages_share_a_fingerprint():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = "".join(rng.choice("abcdefgh") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    for _ in range(30):
        a, b = (set(winnowing.winnow(text(200) + shared + text(200))[0].tolist()) for _ in range(2))
        assert a & b


def test_short_shared_passages():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = "".join(rng.choice("abcdefgh") for _ in range(31))
    for n in (0, 40, 200):
        for _ in range(30):
            a, b = (set(winnowing.winnow(text(n) + shared + text(n))[0].tolist()) for _ in range(2))
            assert a & b


def test_licenses(spark, odd, empty, texts):
    phrases = (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"]))
    for r in queries.op8_license_scan(spark, DATA).collect():
        w = words(texts[r["doc_id"]])
        at = [(k, label) for label, p in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        want = (len(w), len(at), min([k for k, _ in at], default=None), max([k for k, _ in at], default=None), ",".join(sorted({x for _, x in at})))
        assert tuple(r)[1:6] == want and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.scan(odd, keep=["doc_id"]).where("size(blocks) > 0").count() == 0
    assert license_scan.scan(empty, keep=["doc_id"]).count() == 0
    rng, pool = random.Random(2), sorted({w for t in license_scan.TEMPLATES.values() for w in license_scan._words(t)})
    rows = [(i, "\n".join(" ".join(rng.choice(pool) if rng.random() < 0.3 else w for w in rng.choice(list(license_scan.TEMPLATES.values())).split()) for _ in range(5)), "en", "s", 1) for i in range(40)]
    got = {r["doc_id"]: {(b["line"], b["label"]) for b in r["blocks"]} for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()}
    for i, t, *_ in rows:
        want = {(n, label) for n, line in enumerate(t.split("\n")) for label, body in license_scan.TEMPLATES.items() if len(set(license_scan._words(body)) & set(words(line))) >= 0.8 * len(license_scan._words(body)) - 1e-9}
        assert got[i] == want


def test_wrapped_licenses(spark):
    def wrapped(body, width):
        ws = body.split()
        return "alpha beta\n" + "\n".join(" ".join(ws[i : i + width]) for i in range(0, len(ws), width)) + "\ngamma delta"

    labels = sorted(license_scan.TEMPLATES)
    rows = [(100 * i + width, wrapped(license_scan.TEMPLATES[label], width), "en", "s", 1) for i, label in enumerate(labels) for width in (2, 5, 13)]
    # the words of a notice, but far from each other
    rows.append((9999, ("\n" + "filler " * 40).join(license_scan.TEMPLATES["mit-grant"].split()), "en", "s", 1))
    got = {r["doc_id"]: r["notices"] for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()}
    assert got[9999] == []
    for i, label in enumerate(labels):
        for width in (2, 5, 13):
            assert [(b["containment"], b["at"]) for b in got[100 * i + width] if b["label"] == label] == [(1.0, 2)], label


def test_notice_lines_of_the_data(spark):
    lines = {
        "All rights reserved.": {"rights-reserved"},
        "Released under the MIT license.": {"mit-notice"},
        "Licensed under the Apache License, Version 2.0.": {"apache-notice"},
        "This work is licensed under the GNU General Public License, version 3.": {"gpl-notice", "agpl-notice", "lgpl-notice"},
        "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc", "cc-by-sa"},
    }
    rows = [(i, line, "en", "s", 1) for i, line in enumerate(lines)]
    got = {r["doc_id"]: {b["label"] for b in r["blocks"]} for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()}
    assert got == dict(enumerate(lines.values()))


def test_quality(spark, odd, empty):
    rows = [(i, ("ABC!! DEF## " if i % 3 == 0 else "plain words in a line ") * (5 + i % 7), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    model = quality_rules.fit(docs, labels, may_learn=queries.id_remainder("doc_id", 5) != 0)
    got = quality_rules.score(docs, model, keep=["doc_id"]).where(queries.id_remainder("doc_id", 5) == 0).collect()
    assert len(got) > 30 and all((r["score"] >= 0.3) == (r["doc_id"] % 3 != 0) for r in got)
    assert all(0 <= r["score"] <= 1 for r in quality_rules.score(odd, model, keep=["doc_id"]).collect())
    assert quality_rules.fit(docs, labels.limit(0)).rules == [] and quality_rules.score(empty, model, keep=["doc_id"]).count() == 0


def luhn(d):
    return sum(x if k % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(t):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, odd, empty):
    rng = random.Random(6)
    bits = ["a.b@c.de", "@", ".", "x_y@z.org", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111111111111111", "5", " ", "-", "+1 (310) 555-4510", "+", "é", "😀", "12", "(", "a@b", "_", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "en", "s", 1) for i in range(1500)]
    rows.append((5000, "IBAN GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32; token = \"" + "a1" * 20 + "\" then " + "b2" * 20, "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd)
    found = pii.find(docs, keep=["doc_id", "text"]).select("doc_id", "text", pii.listed(pii.BASE).alias("base"), pii.listed(list(pii.KINDS)).alias("spans"))
    for r in found.collect():
        assert r["base"] == ",".join(base_spans(r["text"] or "")), r["text"][:80]
        if r["doc_id"] == 5000:
            assert "iban:5:32" in r["spans"] and r["spans"].count("iban:") == 1 and r["spans"].count("secret:") == 1
    assert pii.find(empty, keep=["doc_id"]).count() == 0
    cut = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame([(1, "mail a.b@c.de now", "", "", 1), (2, None, "", "", 1)], SCHEMA)).collect()}
    assert cut == {1: "mail [email] now", 2: None}


def test_context_on_either_side(spark):
    key = "a1" * 20
    texts = [f"{key} is the token", f"token: {key}", f"{key} {'x' * 40} token", f"{'token'.ljust(45)}{key}", f"{key}\n(password)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: len(r["secret_spans"]) for r in pii.find(docs, keep=["doc_id"]).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}


def test_ibans_before_capitals_and_long_secrets(spark):
    texts = ["IBAN ES91 2100 0418 4502 0005 1332 BIC X", "IBAN BE68 5390 0754 7034 EUR", "IBAN BE68539007547034 BIC", "IBAN AT61 1904 3002 3457 3201 BIC", "IBAN GB82 WEST 1234 5698 7654 32 EUR", "IBAN BE69 5390 0754 7034 EUR", "token = " + "a1" * 64, "token = " + "a1" * 100]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: [s["match"] for s in [*r["iban_spans"], *r["secret_spans"]]] for r in pii.find(docs, keep=["doc_id"]).collect()}
    assert got == {0: [texts[0][5:34]], 1: [texts[1][5:24]], 2: [texts[2][5:21]], 3: [texts[3][5:29]], 4: [texts[4][5:32]], 5: [], 6: [texts[6][8:]], 7: [texts[7][8:]]}


def test_line_dedup(spark, odd, empty):
    rows = [(i, f"Unique start {'abcdefghij'[i]} of text\nPage {i} of 10\nRead more about our many great offers now\n\nown line {'zyxwvutsrq'[i]}", "en", "s", 1) for i in range(6)]
    rows.append((10, "The quick brown fox jumps over dogs today\nThe quick brown cat sleeps under trees now", "en", "s", 1))
    rows += [(20 + i, f"Error in module disk while reading block from {x}", "en", "s", 1) for i, x in enumerate(["alpha", "beta", "gamma", "delta"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == rows[0][1] and got[10] == rows[6][1]
    for i in range(1, 6):
        assert got[i] == f"Unique start {'abcdefghij'[i]} of text\n\nown line {'zyxwvutsrq'[i]}"
    assert got[20] == rows[7][1] and got[21] == got[22] == got[23] == ""
    assert line_dedup.dedup(spark.createDataFrame(rows, SCHEMA), drop_emptied=True).count() == len(rows) - 3
    same = {(r["doc_id"], r["text"]) for r in line_dedup.dedup(odd).collect()}
    assert same == {(d, t) for d, t, *_ in ODD}
    assert line_dedup.dedup(empty).count() == 0


def test_line_of_two_documents_is_dropped(spark):
    line = "A passage that stands in two documents and in no other one"
    rows = [(1, f"first own line\n{line}", "en", "s", 1), (2, f"{line}\nsecond own line", "en", "s", 1)]
    # a template of two documents is none: these lines differ
    rows += [(3 + i, f"Error in module disk while reading block from {x}", "en", "s", 1) for i, x in enumerate(["alpha", "beta"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "second own line", 3: rows[2][1], 4: rows[3][1]}


@pytest.mark.parametrize("n", [20, 200, 1600])
def test_template_recurs_at_every_size(spark, n):
    rng, fields = random.Random(n), [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "xy"]
    rows = [(i, f"Error in module m{rng.choice(fields)} while reading block from the old d{rng.choice(fields)}", "en", "s", 1) for i in range(n)]
    # other lines of the leaf, as many again, that are no template
    rows += [(n + i, "Error in module " + " ".join(f"w{rng.choice(fields)}{rng.choice(fields)}" for _ in range(8)), "en", "s", 1) for i in range(n)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "" for i in range(1, n))
    assert all(got[n + i] == rows[n + i][1] for i in range(n))


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "hello there my friend of old", 5, 6, 7, "x")], "doc_id long, text string, row_hash int, body int, dedup_row int, node string")
    items = spark.createDataFrame([(1, "nothing like it")], "item_id long, text string")
    for out in (line_dedup.dedup(docs), jaccard_join.one_of_each(docs), decontaminate.strip(docs, items)):
        assert out.columns == docs.columns and out.collect() == docs.collect()


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe

    docs = pipe.table(spark, DATA, "documents")
    before = docs.count()
    for name, stage in pipe.STAGES[:-1]:
        docs = pipe.written(stage(spark, docs, DATA), "test")
        assert tuple(docs.columns) == pipe.COLUMNS
    assert 0.8 * before < docs.count() <= before
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.scan(docs, items, keys=["doc_id"]).where("n_hit > 0").count() == 0
    assert jaccard_join.classes(docs).where("doc_id != class_id").count() <= 2
    assert pipe.run(spark, DATA).count() == docs.count()


def test_encoder_forgets_and_pieces_cover(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(token_output.Encoder, "ROOM", 40)
    encoder, rng = token_output.Encoder(open(public_tokenizers.path("byte_bpe_50k.json")).read()), random.Random(8)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcé.\n") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 30))) for _ in range(5)]
        for got, want in zip(encoder(texts), encoder.whole(texts), strict=True):
            assert got.tolist() == want.tolist()
    assert len(encoder.units) == len(encoder.sizes) == len(encoder.starts) == len(encoder.used)

    monkeypatch.setattr(token_output, "PIECE", 10)
    for sizes in ([], [0], [3, 4, 5, 0, 40, 1, 1], [0, 0, 0], [10, 10, 10], [100]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array(["x" * n for n in sizes], pa.string())], names=["doc_id", "text"])
        cut = list(token_output.pieces(batch))
        assert [i for p in cut for i in p.column(0).to_pylist()] == list(range(len(sizes)))
        assert all(sum(map(len, p.column(1).to_pylist()[1:])) <= 10 for p in cut)
