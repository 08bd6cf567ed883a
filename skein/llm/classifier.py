"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; in turn, again and again, every feature gets a small step from a shallow tree fitted to
what the others leave unexplained, and its tree's values are added into the feature's lookup table. Pairs of
features whose joint bins explain most of the rest get tables of their own in the same way. A score is a sum of
table entries, taken for whole batches at once.

The model is fitted on at most ``SAMPLE`` labelled documents of the training split, those of smallest hash of doc_id: a bounded,
reproducible sample. Scoring reads every text once.

Defined cases: a null text is empty and scored as such; without labels, or with one class, every score is that
class's share (0.5 for none); repeated labels of a document count once, the largest; repeated documents are scored alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, text_of
from .quality_rules import LEADING, SYMBOLS, UPPER, WHITE, repeats

SAMPLE = 20_000
FEATURES = ["log_words", "mean_word", "symbol_ratio", "upper_ratio", "bang_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "digit_ratio", "bar_ratio", "words_per_line", "end_marks", "top_word", "long_words", "bracket_ratio"]


def features(text: bytes) -> tuple[float, ...]:
    ws = text.split()
    n = len(ws)
    black = text.translate(None, WHITE)
    size = max(1, len(black))
    lines = [x for x in text.split(b"\n") if x.split()]
    counts: dict[bytes, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    m, n_lines = max(1, n), max(1, len(lines))
    without = lambda chars: len(black) - len(black.translate(None, chars))
    return (
        float(np.log1p(n)), without(LEADING) / m, without(SYMBOLS) / m, without(UPPER) / size, black.count(b"!") / m, (len(lines) - len(set(lines))) / n_lines,
        repeats(ws) / m, len(counts) / m, without(b"0123456789") / size, black.count(b"|") / m, n / n_lines, without(b".?") / m, max(counts.values(), default=0) / m,
        sum(c for w, c in counts.items() if len(w) > 18) / m, without(b"{}[]()=<>/\\") / m,
    )


@dataclass
class Additive:
    """Bin edges and tables. tables[f][bin of f]; pair_tables[(f, g)][coarse bin of f, coarse bin of g]."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, f], "right")]
        if self.pair_tables:
            coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
            for (f, g), t in self.pair_tables.items():
                out += t[coarse[f], coarse[g]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -40, 40)))


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def tree_steps(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of the tree that cuts the bins into at most ``leaves`` ranges, best cut first."""
    cuts, ranges = [], [(0, len(grad))]
    g, h = np.r_[0, np.cumsum(grad)], np.r_[0, np.cumsum(hess)]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        at = np.arange(a + 1, b)
        left, right, all_ = (g[at] - g[a]) ** 2 / (h[at] - h[a] + ridge), (g[b] - g[at]) ** 2 / (h[b] - h[at] + ridge), (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
        gain = left + right - all_
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    for _ in range(leaves - 1):
        gain, at, r = max((*best(*r), r) for r in ranges)
        if at < 0 or gain <= 1e-9:
            break
        ranges.remove(r)
        ranges += [(r[0], at), (at, r[1])]
        cuts.append(at)
    out = np.zeros(len(grad))
    for a, b in ranges:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, pairs: int = 8, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 3.0) -> Additive:
    if not len(y) or y.min() == y.max():
        share = float(y[0]) if len(y) else 0.5
        return Additive(base=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    share = y.mean()
    model = Additive(base=float(np.log(share / (1 - share))), edges=[bin_edges(c, bins) for c in x.T], pair_edges=[bin_edges(c, pair_bins) for c in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(at):
            g, h = slopes()
            n = len(model.tables[f])
            step = rate * tree_steps(np.bincount(b, g, n), np.bincount(b, h, n), 4, ridge)
            model.tables[f] += step
            margin += step[b]
    g, h = slopes()
    gains = []
    for f, k in combinations(range(x.shape[1]), 2):
        n = len(model.pair_edges[k]) + 1
        cell = coarse[f] * n + coarse[k]
        gains.append((float((np.bincount(cell, g) ** 2 / (np.bincount(cell, h) + ridge)).sum()), f, k))
    chosen = [(f, k) for gain, f, k in sorted(gains, reverse=True)[:pairs] if gain > 1e-6]
    for f, k in chosen:
        model.pair_tables[f, k] = np.zeros((len(model.pair_edges[f]) + 1, len(model.pair_edges[k]) + 1))
    for _ in range(pair_rounds):
        for (f, k), t in model.pair_tables.items():
            g, h = slopes()
            cell = coarse[f] * t.shape[1] + coarse[k]
            gs, hs = np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape)
            # a tree of depth two: the first cut along f, then one along k on either side
            first = tree_steps(gs.sum(1), hs.sum(1), 2, ridge)
            step = np.zeros(t.shape)
            for side in np.unique(first):
                rows = first == side
                step[rows] = tree_steps(gs[rows].sum(0), hs[rows].sum(0), 2, ridge)
            t += rate * step
            margin += rate * step.ravel()[cell]
    return model


def by_crc(doc_id, parts: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training, sample: int = SAMPLE) -> DataFrame:
    """Texts and y of at most ``sample`` labelled training documents, those of smallest hash. The sample of ids is small enough to broadcast."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    y = y.where(training(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    return text_of(docs).join(F.broadcast(y), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    rows = labelled_sample(docs, labels, "quality", lambda i: by_crc(i, 3) != 1, sample)

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([list(features(t)) for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("y")], ["doc_id", "x", "y"])

    got = sorted(by_batch(rows, measure, "doc_id long, x array<double>, y int").collect())  # at most ``sample`` rows of a few numbers
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = model.scores(np.array([features(t) for t in b.column("text").to_pylist()]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return by_batch(text_of(docs, (by_crc(F.col("doc_id"), 3) == 1).alias("held_out")), run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))
