"""Personal data (native: DataFrame functions only).

Regular expressions propose spans, validators confirm them (Luhn for cards, the
mod-97 rule for IBANs, value ranges for IP parts, digit counts for cards and
phones), and context words near a span, up to ``AROUND`` characters before or after it, adjust its score.

The patterns below give the matches of the plain ones in ``KINDS`` but start
only where a match can start and never step back, so that long runs take
linear time and no deep recursion: a match of digits and separators cannot
start inside such a run, and an e-mail's local part not inside its own run,
unless another match has just ended there.

Scores: 0.5 for a pattern, +0.4 if a validator confirmed it, +0.3 with a
context word on either side, at most 1.  Kinds without a validator of their own (secret) are
reported from ``LEAST`` on, that is, with a context word.

Defined results: a null text is empty and has no spans.  Positions are code
points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns whose matches the patterns in KINDS give.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
LOCAL = "[A-Za-z0-9._%+-]"
# Length of an IBAN -> countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """A known country's IBAN by its length; otherwise, and for other countries, the longest run of groups."""
    known = []
    for size, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(size - 4, 4)
        known.append(f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    longest = "[A-Z][A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+"
    return rf"(?=[A-Z](?<![A-Za-z0-9][A-Z]))(?:{'|'.join([*known, longest])})(?![A-Za-z0-9])"


KINDS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": _iban(),
    "secret": r"[A-Za-z0-9](?<![A-Za-z0-9_-][A-Za-z0-9])[A-Za-z0-9_-]{31,}+",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a kind to be looked for; a cheap test.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": None, "phone": r"\+[0-9]", "iban": None, "secret": None}
CONTEXT = {
    "email": r"(?i)e-?mail|mailto|contact",
    "ip": r"(?i)\bip\b|address|host|server",
    "card": r"(?i)card|visa|credit|payment",
    "phone": r"(?i)phone|tel|mobile|call|fax",
    "iban": r"(?i)iban|account|bank|konto",
    "secret": r"(?i)token|secret|passw|key\b|credential",
}
AROUND, LEAST = 40, 0.8


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, the rest on division by 97."""
    flat = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step)


def confirmed(kind: str, match: Column) -> Column:
    """The kind's validator: null where it has none."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(match) == 1)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


SPANS = "array<struct<kind:string,start:int,end:int,score:double,match:string>>"


def _spans(text: Column, kind: str) -> Column:
    pattern = KINDS[kind]
    found = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + x["gap"]
        return F.struct(
            (here + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(x["m"].isNotNull() & confirmed(kind, x["m"]), F.concat(acc["out"], F.array(F.struct(here.alias("start"), x["m"].alias("m"))))).otherwise(acc["out"]).alias("out"),
        )

    placed = F.aggregate(found, start, step, lambda acc: acc["out"])
    before = lambda s: F.substr(text, F.greatest(F.lit(1), s["start"] + 1 - AROUND), F.least(s["start"], F.lit(AROUND)))
    after = lambda s: F.substr(text, s["start"] + F.length(s["m"]) + 1, F.lit(AROUND))
    near = lambda s: before(s).rlike(CONTEXT[kind]) | after(s).rlike(CONTEXT[kind])
    sure = 0.5 if kind in ("secret", "email") else 0.9
    scored = F.transform(
        placed,
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            (s["start"] + F.length(s["m"])).alias("end"),
            F.least(F.lit(1.0), F.lit(sure) + F.when(near(s), 0.3).otherwise(0.0)).alias("score"),
            s["m"].alias("match"),
        ),
    )
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST)
    return F.when(text.rlike(HINT[kind] or pattern), scored).otherwise(F.array()).cast(SPANS)


def find(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with an array of spans (kind, start, end, score, match) for each kind, named ``<kind>_spans``."""
    if clash := {k.lower() for k in keep} & {f"{k}_spans" for k in KINDS}:
        raise ValueError(f"kept columns clash with result columns: {sorted(clash)}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(*keep, *[_spans(body, k).alias(f"{k}_spans") for k in KINDS])


def listed(kinds: tuple[str, ...] | list[str]) -> Column:
    """``kind:start:end`` of all spans by kind, then start, comma-joined."""
    return F.array_join(F.transform(F.concat(*[F.col(f"{k}_spans") for k in kinds]), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; spans that overlap an earlier one are cut with it."""
    taken = {c.lower() for c in docs.columns}
    names = {k: f"{k}_spans" for k in KINDS}
    if clash := taken & set(names.values()):
        raise ValueError(f"columns clash with span columns: {sorted(clash)}")
    found = find(docs, keep=docs.columns, text=text)
    every = F.array_sort(F.transform(F.concat(*[F.col(c) for c in names.values()]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(body, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1)))
    return found.select(*[F.when(F.size(every) > 0, cut).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
