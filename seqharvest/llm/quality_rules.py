"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are DataFrame expressions.  On a bounded sample of
labelled rows, boosted trees of small depth are grown; the path to every node
is a rule, a conjunction of comparisons of statistics.  Weights of the rules
are fitted by logistic regression with an L1 penalty, which leaves few of them,
and the model is compiled into one Column expression: scoring is a plain
projection, without Python on the executors.

The sample is bounded by ``SAMPLE`` rows; its rows are those of the smallest
hashes of the document id, so it doesn't depend on how data are laid out.

Defined results: a null text is empty and is scored like any other; with no
labelled rows every score is 0.5; with labels of one kind every score is near
that label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 8_000
FEATURES = ("chars", "upper", "symbols", "stops", "digits", "bangs", "pipes", "word_length", "distinct_words", "distinct_lines", "line_length", "short_words", "words")


def statistics(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with the statistics of each text."""
    if clash := {k.lower() for k in keep} & {*FEATURES, "body", "all_words", "all_lines"}:
        raise ValueError(f"kept columns clash with statistics: {sorted(clash)}")
    source = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    source = source.withColumn("all_words", F.split("body", r"[ \t\r\n\x0B\f]+")).withColumn("all_lines", F.split("body", "\n"))
    n = F.greatest(F.lit(1), F.length("body"))
    words, lines = F.size("all_words"), F.size("all_lines")
    share = lambda other: F.length(F.regexp_replace("body", f"[^{other}]++", "")) / n
    return source.select(
        *keep,
        F.log1p(F.length("body")).alias("chars"),
        share("A-Z").alias("upper"),
        share(r"#$%&*@^~<>{}=_\\").alias("symbols"),
        share(".,;:?").alias("stops"),
        share("0-9").alias("digits"),
        share("!").alias("bangs"),
        share("|").alias("pipes"),
        (n / words).alias("word_length"),
        (F.size(F.array_distinct("all_words")) / words).alias("distinct_words"),
        (F.size(F.array_distinct("all_lines")) / lines).alias("distinct_lines"),
        (n / lines).alias("line_length"),
        (F.size(F.filter("all_words", lambda w: F.length(w) <= 3)) / words).alias("short_words"),
        F.log1p(words).alias("words"),
    )


@dataclass
class Model:
    """rules: conditions (feature, is_over, bound) and weight."""

    intercept: float
    rules: list[tuple[list[tuple[str, bool, float]], float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            test = F.lit(True)
            for name, over, bound in conditions:
                test = test & ((F.col(name) > bound) if over else (F.col(name) <= bound))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, bins: np.ndarray, depth: int, least: int) -> list[tuple]:
    """One tree on binned features: (path, rows, value) of every node but the root."""
    nodes, todo = [], [((), np.arange(len(grad)))]
    width = int(bins.max()) + 1
    while todo:
        path, rows = todo.pop()
        if path:
            nodes.append((path, rows, -grad[rows].sum() / (hess[rows].sum() + 1)))
        if len(path) == depth or len(rows) < 2 * least:
            continue
        best = (1e-6, None, None)
        g, h = grad[rows], hess[rows]
        all_g, all_h = g.sum(), h.sum()
        for f in range(x.shape[1]):
            b = x[rows, f]
            lg, lh, ln = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g, h, np.ones(len(rows))))
            gain = lg**2 / (lh + 1) + (all_g - lg) ** 2 / (all_h - lh + 1) - all_g**2 / (all_h + 1)
            gain[(ln < least) | (len(rows) - ln < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is not None:
            f, k = best[1:]
            under = x[rows, f] <= k
            todo += [((*path, (f, False, k)), rows[under]), ((*path, (f, True, k)), rows[~under])]
    return nodes


def rules_of(x: np.ndarray, y: np.ndarray, *, trees: int, depth: int, bins: int, rate: float, seed: int = 7) -> tuple[list[tuple], list[np.ndarray]]:
    """Distinct paths of boosted trees, and the bounds of each feature's bins."""
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], 1)
    rng, score, paths = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        some = np.flatnonzero(rng.random(len(y)) < 0.6)
        if not len(some):
            continue
        for path, rows, value in _grow(coded[some], (p - y)[some], (p * (1 - p))[some], coded, depth, max(5, len(y) // 200)):
            paths.setdefault(tuple(sorted(path)))
            if len(path) == depth:
                hit = np.ones(len(y), bool)
                for f, over, k in path:
                    hit &= (coded[:, f] > k) == over
                score[hit] += rate * value
    return [p for p in paths if all(k < len(bounds[f]) for f, _, k in p)], bounds


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of least logistic loss + penalty * |weights|, by accelerated proximal steps."""
    n, m = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    speed = 4 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - speed * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - speed * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    may_learn: Column | None = None,
    sample: int = SAMPLE,
    trees: int = 30,
    depth: int = 3,
    bins: int = 32,
    rate: float = 0.3,
    penalty: float = 1e-3,
) -> Model:
    """Fit on about ``sample`` labelled rows at most.  may_learn is a condition on the column doc_id."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(F.lit(True) if may_learn is None else may_learn)
    total = known.count()
    if not total:
        return Model(0.0)
    room = 1_000_000
    take = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(room)) < min(room, max(1, room * sample // total))
    stats = statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").where(take), keep=["doc_id"])
    rows = stats.join(known.where(take), "doc_id").select(*FEATURES, "y").collect()
    if not rows:
        return Model(0.0)
    data = np.array([tuple(r) for r in rows], np.float64)
    data = data[np.lexsort(data.T)]  # the fit doesn't depend on the order of the rows
    x, y = data[:, :-1], data[:, -1]
    paths, bounds = rules_of(x, y, trees=trees, depth=depth, bins=bins, rate=rate)
    hits = np.ones((len(y), len(paths)))
    for j, path in enumerate(paths):
        for f, over, k in path:
            hits[:, j] *= (x[:, f] > bounds[f][k]) == over
    start, weights = lasso(hits, y, penalty)
    kept = np.flatnonzero(weights)
    return Model(start, [([(FEATURES[f], bool(over), float(bounds[f][k])) for f, over, k in paths[j]], float(weights[j])) for j in kept])


def score(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The ``keep`` columns with the probability of label 1."""
    return statistics(docs, keep=keep, text=text).select(*keep, model.column().alias(out))
