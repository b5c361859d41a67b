"""Quality classifier: a sparse rule ensemble (after Friedman and Popescu, 2008) over statistics of whole texts.

``statistics`` measures each text in one pass. ``fit`` grows shallow boosted trees on a bounded sample of labelled rows
(``SAMPLE_ROWS``), takes every path from a root as a conjunctive rule, weighs the rules by logistic regression with an
L1 penalty, and keeps those with a weight. ``score`` compiles them into one Spark column, so scoring is a projection.

Defined results: a null or empty text has all statistics 0 and is scored like any other; with no labelled rows, or
with one class only, the score is the smoothed share of good rows (0.5 without rows); rows that repeat a doc_id are
scored one by one, and count once where they are labelled, with the least of their statistics; labels whose quality is
null are left out; an empty table gives no rows. All columns of the input stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table

SAMPLE_ROWS = 20_000
STATS = ["log_bytes", "words", "word_length", "upper", "digits", "symbols", "pipes", "marks", "stops", "distinct_words", "top_word", "distinct_lines", "symbol_words", "line_words", "long_words"]
_KINDS = np.zeros((7, 256), "u1")
for _row, _chars in enumerate([range(65, 91), range(48, 58), b"#$%&*@^~<>{}[]\\=_", b"|", b"!?", b".,;:", b" \t\n\r"]):
    _KINDS[_row, list(_chars)] = 1


def _measured(text: bytes) -> list[float]:
    if not text:
        return [0.0] * len(STATS)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    upper, digits, symbols, pipes, marks, stops, blanks = (_KINDS @ counts).tolist()
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    k, solid = max(1, len(words)), max(1, n - blanks)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    odd = sum(c for w, c in seen.items() if w[-1:] in b"#$%&*!|" and w[-1:])
    long_words = sum(c for w, c in seen.items() if len(w) > 14)
    return [float(np.log1p(n)), float(np.log1p(len(words))), solid / k, upper / solid, digits / solid, symbols / solid, pipes / k, marks / k, stops / k, len(seen) / k, max(seen.values(), default=0) / k, len(set(lines)) / max(1, len(lines)), odd / k, k / max(1, len(lines)), long_words / k]


def _with_stats(it):
    for batch in it:
        stats = [[round(x, 6) for x in _measured((t.as_py() or "").encode())] for t in batch.column(0)]
        yield pa.record_batch([batch.column(1), pa.array(stats, pa.list_(pa.float64()))], names=["rest", "stats"])


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, name: str = "_stats") -> DataFrame:
    """The columns ``keep`` of each row (all by default) and ``name``: the values of ``STATS``."""
    rest = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), rest.alias("rest"))
    out = rows.mapInArrow(_with_stats, rows.select("rest").schema.add("stats", T.ArrayType(T.DoubleType())))
    return out.select("rest.*", F.col("stats").alias(name))


@dataclass
class Rules:
    """An intercept and weighted rules; a rule is a list of (statistic, threshold, is_above)."""

    intercept: float = 0.0
    rules: list[tuple[float, list[tuple[int, float, bool]]]] = field(default_factory=list)

    def column(self, stats: str = "_stats") -> Column:
        """The score, 0 to 1, as one Spark column."""
        terms = [F.lit(self.intercept)]
        for weight, rule in self.rules:
            at = F.col(f"`{stats}`")
            parts = [at[i] > t if above else at[i] <= t for i, t, above in rule]
            terms.append(F.when(reduce(Column.__and__, parts), F.lit(weight)).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-reduce(Column.__add__, terms)))


def _covers(x: np.ndarray, rule: list[tuple[int, float, bool]]) -> np.ndarray:
    return np.logical_and.reduce([x[:, i] > t if above else x[:, i] <= t for i, t, above in rule])


def _paths(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """Grows one tree on gradients; yields (rule, rows, step) for every node below the root, leaf or not."""
    todo = [([], np.arange(len(x)))]
    while todo:
        rule, rows = todo.pop()
        best = (1e-6, None)
        g, h = grad[rows], hess[rows]
        base = g.sum() ** 2 / (h.sum() + 1)
        for i in range(x.shape[1]) if len(rule) < depth else ():
            if not len(edges[i]):
                continue
            b = bins[rows, i]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(edges[i]) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], (i, j))
        if rule:
            yield rule, rows, -g.sum() / (h.sum() + 1), best[1] is None
        if best[1]:
            i, j = best[1]
            below = bins[rows, i] <= j
            todo += [([*rule, (i, float(edges[i][j]), False)], rows[below]), ([*rule, (i, float(edges[i][j]), True)], rows[~below])]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 1e-3, steps: int = 400) -> Rules:
    """Boosted trees to rules, rules to lasso logistic weights by accelerated proximal steps."""
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Rules(prior)
    edges = [np.unique(np.round(np.quantile(x[:, i], np.linspace(0.01, 0.99, 64)), 6)) for i in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1)
    z, found = np.full(len(y), prior), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        for rule, rows, step, leaf in _paths(x, bins, edges, p - y, p * (1 - p), depth, max(5, len(y) // 500)):
            found[tuple(sorted(rule))] = list(rule)
            if leaf:
                z[rows] += 0.3 * step
    rules = list(found.values())
    if not rules:
        return Rules(prior)
    m = np.stack([_covers(x, r) for r in rules], axis=1).astype("f8")
    mean, sd = m.mean(0), m.std(0) + 1e-9
    m = (m - mean) / sd
    rate = 4 / np.linalg.norm(m.T @ m / len(y), 2)
    w, b, v, t = np.zeros(m.shape[1]), prior, np.zeros(m.shape[1]), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(m @ v + b))) - y
        new = v - rate * (m.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        b -= 2 * r.mean()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / nt * (new - w), new, nt
    w = w / sd
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(float(b - (w * mean)[kept].sum()), [(float(w[i]), rules[i]) for i in kept])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Rules from at most ``sample_rows`` labelled rows that aren't held out, chosen by a hash of their id.

    The sample's ids are few by that bound and broadcast; the texts they name are measured where they lie.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = statistics(rows, keep=["doc_id", "_quality"]).groupBy("doc_id").agg(F.min("_stats").alias("_stats"), F.max("_quality").alias("_quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["_stats"] for r in rows], "f8").reshape(-1, len(STATS))
    return fit_rules(x, np.array([float(r["_quality"] == 1) for r in rows]))


def score(docs: DataFrame, model: Rules, keep: list[str] | None = None, name: str = "_score") -> DataFrame:
    """The columns ``keep`` of each row (all by default) and its score as ``name``."""
    stats = free_name(docs, "_stats")
    out = statistics(docs, keep=keep, name=stats)
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != stats], model.column(stats).alias(name))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a prediction for every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts."""
    name = free_name(docs, "_score")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), name=name)
    return out.filter(F.col(f"`{name}`") >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
