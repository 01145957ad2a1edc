"""DuckDB SQL of the text queries that SQL can express on whole tables.

The SQL takes the plainest way to each result: every line is compared with every
template, every position with every phrase.  It relies on doc_id being unique.
"""

from .license_scan import PHRASES, TEMPLATES, THRESHOLD, plan
from .line_dedup import COMMON, EXACT_DOCS, LEADING, MIN_DOCS, SIMILARITY, anchors, least_size
from .pii import AROUND, CONTEXT

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, w[i : i + k - 1] AS g FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, i, w[i : i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
h AS (SELECT doc_id, k, i, item FROM g JOIN win USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i : i + 4]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM pairs JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE CAST(c AS DOUBLE) / (x.n + y.n - c) >= 0.8),
r AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(m.least, doc_id)) AS class_id, coalesce(k.n, 0) AS n_links FROM d LEFT JOIN m ON m.a = doc_id LEFT JOIN k ON k.a = doc_id"""

def _values(rows: list[tuple[str, list[str], int]]) -> str:
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    return ", ".join(f"({quoted(label)}, [{', '.join(map(quoted, ws))}], {least})" for label, ws, least in rows)


OP1 = rf"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
k AS (SELECT doc_id, pos, raw, list_transform(list_filter(string_split_regex(raw, '[ \t\r\x0B\f]+'), lambda x: x != ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
t AS MATERIALIZED (SELECT doc_id, pos, w, array_to_string(w, ' ') AS line FROM k WHERE len(list_filter(w, lambda x: x != '<*>')) > 0),
per AS MATERIALIZED (SELECT line, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM t WHERE len(w) > {LEADING} GROUP BY 1),
kinds(kind, fixed, least) AS (VALUES {', '.join(f"({k}, {[i + 1 for i in at]}, {least_size(k, LEADING)})" for k, at in enumerate(anchors(LEADING)))}),
every AS MATERIALIZED (SELECT line, w, docs, kind, fixed, {{'kind': kind, 'n': len(w), 'head': list_transform(fixed, lambda i: w[i])}} AS leaf FROM per, kinds WHERE len(w) >= least),
c AS MATERIALIZED (SELECT * FROM every WHERE leaf IN (SELECT leaf FROM every GROUP BY 1 HAVING count(*) > 1 AND sum(docs) >= {MIN_DOCS})),
p AS MATERIALIZED (SELECT * FROM (SELECT leaf, line, docs, fixed, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM c) WHERE token != '<*>' AND NOT list_contains(fixed, i)),
f AS (SELECT leaf, i, token, sum(docs) AS held FROM p GROUP BY 1, 2, 3 HAVING sum(docs) >= {MIN_DOCS}),
m AS (SELECT leaf, line, count(*) AS n, len(list_filter(leaf.head, lambda x: x != '<*>')) AS lead, list(held ORDER BY held DESC) FILTER (held IS NOT NULL) AS ranked, list({{'i': i, 't': token, 'h': held}} ORDER BY i) FILTER (held IS NOT NULL) AS known FROM p LEFT JOIN f USING (leaf, i, token) GROUP BY 1, 2),
q AS (SELECT *, ranked[greatest(1, CAST(ceil(CAST({SIMILARITY} AS DOUBLE) * (lead + n) - 1e-9) AS BIGINT) - lead)] AS measure FROM m),
g AS MATERIALIZED (SELECT line, leaf, list_transform(stay, lambda x: {{'i': x.i, 't': x.t}}) AS fixed FROM (SELECT *, list_filter(known, lambda x: x.h >= CAST({COMMON} AS DOUBLE) * measure) AS stay FROM q WHERE measure IS NOT NULL) WHERE len(stay) < n),
o AS (SELECT leaf, fixed, count(DISTINCT doc_id) AS docs FROM t JOIN g USING (line) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
best AS (SELECT line, arg_max({{'leaf': leaf, 'fixed': fixed}}, {{'docs': docs, 'kind': -leaf.kind}}) AS template FROM g JOIN o USING (leaf, fixed) GROUP BY 1),
placed AS MATERIALIZED (SELECT doc_id, pos, CASE WHEN best.line IS NULL THEN {{'line': t.line, 'leaf': NULL, 'fixed': NULL}} ELSE {{'line': NULL, 'leaf': best.template.leaf, 'fixed': best.template.fixed}} END AS template FROM t LEFT JOIN best USING (line)),
r AS (SELECT template, min({{'d': doc_id, 'pos': pos}}) AS first FROM placed GROUP BY 1 HAVING count(DISTINCT doc_id) >= {EXACT_DOCS}),
gone AS (SELECT doc_id, pos, true AS gone FROM placed JOIN r ON placed.template IS NOT DISTINCT FROM r.template WHERE {{'d': doc_id, 'pos': pos}} != first),
kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (gone IS NULL) AS body, count(*) AS n_lines, count(gone) AS n_dropped FROM l LEFT JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(body, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM documents LEFT JOIN kept USING (doc_id)"""

OP8 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w, text FROM documents),
p(label, parts, k) AS (VALUES {_values([(label, p.split(), len(p.split())) for label, p in sorted(PHRASES.items())])}),
places AS (SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE w[i : i + k - 1] = parts),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM places GROUP BY 1),
t(label, ws, least) AS (VALUES {_values(plan(TEMPLATES, {}, THRESHOLD)[0])}),
lines AS (SELECT doc_id, {WORDS} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM d)),
hit AS MATERIALIZED (SELECT doc_id, label, CAST(common AS DOUBLE) / n AS score FROM (SELECT doc_id, label, least, len(ws) AS n, len(list_intersect(ws, s)) AS common FROM lines, t) WHERE common >= least),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hit) GROUP BY 1),
best AS (SELECT doc_id, max(score) AS score FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(base.names, '') AS base_labels, coalesce(every.names, '') AS labels,
CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(best.score, CAST(0 AS DOUBLE)) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""

# kind -> place in the order, pattern, and what confirms a match m with digits g.  An IBAN's pattern takes the character before it and one after it that must not be there.
_IBAN = r"(?:^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)[A-Za-z0-9]?"
_FLAT = "replace(body, ' ', '')"
_PII = {
    "email": (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0"),
    "card": (2, r"[0-9](?:[\x20-]?[0-9])+", "length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(g)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(g[length(g) - k] AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(g[length(g) - k] AS INTEGER) + 1] END)) % 10 = 0"),
    "phone": (3, r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) BETWEEN 9 AND 15"),
    "iban": (4, _IBAN, f"body = ltrim_m AND length({_FLAT}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({_FLAT}[5:] || {_FLAT}[:4], ''), lambda x: CASE WHEN x <= '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)), lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1"),
    "secret": (5, r"[A-Za-z0-9_-]+", f"length(m) >= 32 AND regexp_matches(m, '^[A-Za-z0-9]') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND (regexp_matches(t[greatest(1, a + 1 - {AROUND}) : a], '{CONTEXT['secret']}') OR regexp_matches(t[a + 1 + length(m) : a + length(m) + {AROUND}], '{CONTEXT['secret']}'))"),
}


def _found(kind: str) -> str:
    place, pattern, test = _PII[kind]
    body = f"regexp_extract(m, '{pattern}', 1)" if kind == "iban" else "m"
    # an IBAN match may begin with the character before it; that one is no part of the span
    return rf"""SELECT doc_id, {place} AS place, '{kind}' AS kind, a + length(m) - length(ltrim_m) AS a, a + length(m) - length(ltrim_m) + length(body) AS z FROM (
SELECT *, {body} AS body, {r"regexp_replace(m, '^[^A-Za-z0-9]', '')" if kind == "iban" else "m"} AS ltrim_m, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM (
SELECT doc_id, t, m, sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM (
SELECT *, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
SELECT doc_id, t, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, unnest(ms) AS m FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d)))) WHERE m IS NOT NULL) WHERE {test}"""


OP10 = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({' UNION ALL '.join(map(_found, _PII))}),
o AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in list(_PII)[:4])},
string_agg(kind || ':' || a || ':' || z, ',' ORDER BY place, a) FILTER (place < 4) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY place, a) AS spans FROM s GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in list(_PII)[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""

PIECES = r"string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"

# phrases are lists of words; every cut of every candidate is scored
OP11 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({PIECES}) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS MATERIALIZED (SELECT lang, m, w[i : i + m - 1] AS g, count(*) AS a FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) x(m)) GROUP BY 1, 2, 3 HAVING m = 1 OR count(*) >= 100),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, g, a, k, g[1:k] AS x, g[k + 1:] AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (SELECT c.lang, c.m, c.g, c.a, c.k, x.a AS l, y.a AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
 FROM c JOIN f x ON x.lang = c.lang AND x.g = c.x JOIN f y ON y.lang = c.lang AND y.g = c.y JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, g[i : i + z - 1] AS g, max(a) AS most FROM (SELECT lang, g, a, z, unnest(range(1, m - z + 2)) AS i FROM f, range(2, 5) y(z) WHERE m > z) GROUP BY 1, 2),
kept AS (SELECT lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM best b LEFT JOIN inner_ USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000"""

SQL: dict[str, str] = {"op1_line_dedup": OP1, "op2_decontaminate": OP2, "op5_ngram_jaccard": OP5, "op8_license_scan": OP8, "op10_pii": OP10, "op11_phrases": OP11}
