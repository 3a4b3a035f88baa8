"""Quality classifier: tree paths as conjunctive rules over statistics, lasso logistic weights, compiled to columns.

Statistics of each text are measured in the workers. Shallow trees are boosted on a bounded sample of labelled rows (the
``SAMPLE`` rows with the least hash of their id, of the training part); every path from a root to a node is a rule. A
logistic regression with an L1 penalty, fitted by accelerated proximal steps, keeps few of them. The kept rules become one
column expression, so that scoring all rows needs nothing but the statistics.

Training rows are those whose crc32 of the id as text is not 2 modulo 4; the rest is held out. Labels, language, source and
id are no statistics. Null and empty texts have statistics of zero and are scored like any other; repeated rows repeat
their score; rows with a null id count as training rows by number but have no label. Without any labelled row of both
classes the score is the share of label 1, or a half without labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.rows import pieces
from rasterloom.runtime import checkpoint

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000
TREES, DEPTH, CUTS, LEAST_LEAF = 40, 3, 32, 10
PENALTY, STEPS = 3e-4, 800
HELD_OUT = 2

STATISTICS = (
    "log_words", "mean_word", "longest_word", "distinct_words", "local_distinct", "top_word", "repeats", "upper", "digits", "symbols", "marks", "pipes",
    "commas", "stops", "log_lines", "distinct_lines", "words_a_line", "other_bytes",
)
#: Words of the blocks whose different words are counted: unlike in the whole text, their share does not fall with the length.
BLOCK = 50
_SYMBOLS, _MARKS, _DIGITS, _UPPER = b"#*$%&<>", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHER = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    lengths = list(map(len, words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), sum(lengths) / n, float(max(lengths)), len(counts) / n, sum(len(set(words[i : i + BLOCK])) for i in range(0, n, BLOCK)) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n,
        share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_MARKS), share(b"|"), share(b","), share(b"."), float(np.log1p(len(lines))), len(set(lines)) / len(lines), n / len(lines), share(_OTHER),
    ]


def measured(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id`` and all statistics of each row."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = np.array([statistics(t or "") for t in b.column(1).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["id", *STATISTICS])

    return docs.select(docs[id], docs[text]).mapInArrow(run, f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Condition:
    statistic: int
    above: bool
    cut: float


Rule = tuple[Condition, ...]


@dataclass
class Ensemble:
    """Intercept, and rules with their weights."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score, as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for c in rule:
                holds = holds & ((F.col(STATISTICS[c.statistic]) > c.cut) if c.above else (F.col(STATISTICS[c.statistic]) <= c.cut))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * _holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= (x[:, c.statistic] > c.cut) == c.above
    return out


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, path: Rule, out: set[Rule], fitted: np.ndarray) -> None:
    """Grow a regression tree on the residuals; every node's path is a rule, every leaf's mean goes to ``fitted``."""
    fitted[rows] = residual[rows].mean() if len(rows) else 0.0
    if len(path) == DEPTH or len(rows) < 2 * LEAST_LEAF:
        return
    best, total, n = (1e-9, -1, -1), residual[rows].sum(), len(rows)
    for s in range(x.shape[1]):
        if not len(cuts[s]):
            continue
        size = np.bincount(bins[rows, s], minlength=len(cuts[s]) + 1).cumsum()[:-1]
        low = np.bincount(bins[rows, s], residual[rows], len(cuts[s]) + 1).cumsum()[:-1]
        good = (size >= LEAST_LEAF) & (n - size >= LEAST_LEAF)
        gain = np.where(good, low**2 / np.maximum(size, 1) + (total - low) ** 2 / np.maximum(n - size, 1) - total**2 / n, 0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), s, at)
    _, s, at = best
    if s < 0:
        return
    above = bins[rows, s] > at
    for side in (False, True):
        step = (*path, Condition(s, side, float(cuts[s][at])))
        out.add(step)
        _tree(x, bins, cuts, residual, rows[above == side], step, out, fitted)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    """Rules from boosted trees, weights by L1-penalised logistic regression."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Ensemble(float(np.log(share / (1 - share))), [])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T)]
    # a value equal to a cut is on its lower side, as in the rules
    bins = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)])
    rng, margin, rules = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), set()
    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), max(2 * LEAST_LEAF, len(y) // 2), replace=len(y) < 4 * LEAST_LEAF))
        residual, fitted = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        before = set(rules)
        _tree(x, bins, cuts, residual, np.unique(rows), (), rules, fitted)
        for rule in rules - before:
            if len(rule) == DEPTH:
                held = _holds(rule, x)
                margin[held] += 2 * residual[held].mean() if held.any() else 0
    ordered = sorted(rules, key=lambda r: [(c.statistic, c.above, c.cut) for c in r])
    z = np.column_stack([_holds(r, x) for r in ordered]).astype(np.float64)
    z, first = np.unique(z, axis=1, return_index=True)  # rules that hold for the same rows count once
    keep = (z.mean(axis=0) > 0) & (z.mean(axis=0) < 1)
    z, ordered = z[:, keep], [ordered[i] for i in first[keep]]
    mean = z.mean(axis=0)
    z = z - mean
    lipschitz = np.linalg.norm(z, 2) ** 2 / (4 * len(y)) + 0.25
    w, v, b, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(z @ v + b))) - y
        step = v - z.T @ error / len(y) / lipschitz
        new = np.sign(step) * np.maximum(np.abs(step) - PENALTY / lipschitz, 0)
        b -= float(error.mean() / lipschitz)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    kept = np.flatnonzero(w)
    return Ensemble(b - float(mean @ w), [(ordered[i], float(w[i])) for i in kept])


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> Ensemble:
    """Fit on at most ``SAMPLE`` labelled rows of the training part."""
    own = labels.select(labels[id].alias("_id"), labels[label].cast("double").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    sample = own.orderBy(F.xxhash64("_id"), "_id", "_label").limit(SAMPLE)
    # rows that share an id count once, with the least statistics, so that there are no more rows than labels
    least = F.min(F.struct(*STATISTICS)).alias("s")
    t = stats.join(F.broadcast(sample), stats.id == F.col("_id")).groupBy("_id", "_label").agg(least).select("_id", "_label", "s.*").toPandas()
    t = t.sort_values(["_id", "_label"])
    return fit(t[list(STATISTICS)].to_numpy(np.float64).reshape(-1, len(STATISTICS)), t["_label"].to_numpy(np.float64))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``id, held_out, score, predicted`` of each row."""
    stats = checkpoint(measured(docs, text, id))
    score = train(stats, labels, id, label).column()
    return stats.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
