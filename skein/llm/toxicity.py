"""Toxicity by lexicon: Levenshtein automata intersected with a lexicon trie, and the contexts of what they find.

The lexicon is learned: words, and stems that words begin with, whose odds are significantly higher in toxic training
documents. It is kept as a trie. Reading a word letter by letter moves a set of (trie node, edits so far) pairs, which is the
product of the trie with the Levenshtein automaton of every entry at once; the sets met are numbered and their moves kept,
so that most words are dropped after a few table look-ups. Entries of five letters or more, words and stems, may be
one edit off, unless such near finds are as common in clean training documents as in toxic ones.
A find, near or exact, counts as much as its entry's odds say, shared between abuse and quotation by the words around it: quotation marks
and words of report speak for quotation, words of address and exclamation for abuse. A logistic model weighs abuse by
exact finds, abuse by misspelled ones, quotation, density and variety. Labelled texts hardly ever misspell or quote, so each toxic
training text with finds is also shown with every find misspelled (still toxic) and with every find reported in quotation marks (not
toxic), at ``SHOWN`` of a text's weight each; misspelled abuse never counts against toxicity.

Fitted on at most ``SAMPLE`` labelled documents of the training split, those of smallest hash of doc_id.

Defined cases: a null text is empty; without labels or with one class the score is that class's share (0.5 for none);
repeated labels of a document count once, the largest; words of over 64 letters are no finds; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifier import SAMPLE, by_crc, labelled_sample
from .common import by_batch, cut, text_of

EDGE = b".,;:!?\"'()[]{}<>*_-~`|/\\+=#@$%^&"
#: Words of report and of address around a find, in the languages of the corpus.
REPORT = frozenset(w.encode() for w in "said says wrote writes quoted quote called according word term sagte schrieb zitat wort dijo escribió cita palabra dit écrit citation mot".split())
ADDRESS = frozenset(w.encode() for w in "you your you're u du dich dein ihr euch tú tu te usted vosotros vous toi ton votre".split())
QUOTES = ('"'.encode(), "“".encode(), "”".encode(), "«".encode(), "»".encode(), "„".encode())
WINDOW = 4
MIN_STEM = 4
#: Shorter entries have too many neighbours.
NEAR_FROM = 5


def bare(word: bytes) -> bytes:
    return word.lower().strip(EDGE)


#: What a word can be to the lexicon, best first.
WHOLE, STEM, NEAR_WHOLE, NEAR_STEM = 1, 2, 3, 4
Find = tuple[int, int]  # what, and the entry's number; (0, -1): nothing


class Automaton:
    """Finds entries of a lexicon in words: whole or as a stem, and one edit off where the entry's flag in ``near`` allows it."""

    def __init__(self, whole: list[str], stems: list[str], near: list[bool] | None = None):
        entries = [*whole, *stems]
        self.near = [len(e) >= NEAR_FROM for e in entries] if near is None else near
        self.children: list[dict[str, int]] = [{}]
        self.whole, self.stem = [-1], [-1]
        for number, e in enumerate(entries):
            at = 0
            for ch in e:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.stem.append(-1)
                at = self.children[at][ch]
            (self.whole if number < len(whole) else self.stem)[at] = number
        # a state: (trie node, edits), and below zero the stems that have been read with an edit
        self.states: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[Find] = []
        self.start = self.state({(0, 0)})

    def state(self, pairs: set[tuple[int, int]]) -> int:
        full = set(pairs)
        for node, e in pairs:
            if e == 0:  # a letter of the entry is missing
                full |= {(c, 1) for c in self.children[node].values()}
        for node, e in list(full):
            if node >= 0 and e and self.stem[node] >= 0 and self.near[self.stem[node]]:
                full.add((-1 - self.stem[node], 1))
        key = frozenset(p for p in full if p[1] == 0 or (p[0], 0) not in full)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            finds = [(WHOLE, self.whole[n]) for n, e in key if n >= 0 and e == 0 and self.whole[n] >= 0]
            finds += [(NEAR_WHOLE, self.whole[n]) for n, e in key if n >= 0 and e and self.whole[n] >= 0 and self.near[self.whole[n]]]
            finds += [(NEAR_STEM, -1 - n) for n, _ in key if n < 0]
            self.ends.append(min(finds, default=(0, -1)))
        return self.number[key]

    def move(self, state: int, ch: str) -> int:
        """The next state; -1: none; below: a stem has been read, number -2 - it."""
        out = set()
        for node, e in self.states[state]:
            if node < 0:
                out.add((node, e))
                continue
            nxt = self.children[node].get(ch)
            if nxt is not None:
                if e == 0 and self.stem[nxt] >= 0:
                    self.moves[state][ch] = to = -2 - self.stem[nxt]
                    return to
                out.add((nxt, e))
            if e == 0:
                out.add((node, 1))
                out |= {(c, 1) for c in self.children[node].values()}
        to = self.state(out) if out else -1
        if len(self.moves[state]) < 400:
            self.moves[state][ch] = to
        return to

    def find(self, word: str) -> Find:
        at = self.start
        for ch in word:
            to = self.moves[at].get(ch)
            at = self.move(at, ch) if to is None else to
            if at < 0:
                return (STEM, -2 - at) if at < -1 else (0, -1)
        return self.ends[at]


@dataclass
class Lexicon:
    """Entries: whole words, then stems; how much each counts, and whether it may be one edit off."""

    whole: list[str]
    stems: list[str]
    strength: list[float]
    near: list[bool]


class Finder(dict):
    """Raw word to what the automaton finds in it; forgotten when there are too many."""

    def __init__(self, lexicon: Lexicon, most: int = 800_000):
        self.automaton, self.most = Automaton(lexicon.whole, lexicon.stems, lexicon.near), most
        self.strength = lexicon.strength

    def __missing__(self, word: bytes) -> Find:
        if len(self) >= self.most:
            self.clear()
        s = bare(word).decode("utf-8", "replace")
        self[word] = k = self.automaton.find(s) if len(s) <= 64 else (0, -1)
        return k


_FINDERS: dict[tuple, Finder] = {}


def finder(lexicon: Lexicon) -> Finder:
    key = (tuple(lexicon.whole), tuple(lexicon.stems), tuple(lexicon.strength), tuple(lexicon.near))
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(lexicon)
    return _FINDERS[key]


COLUMNS = ["abuse", "misspelled", "quoted", "density", "distinct"]
#: Weights where labels say nothing, and their least values.
PRIOR = np.array([1.0, 0.7, 0.0, 0.0, 0.0])
LEAST = np.array([0.1, 0.05, -np.inf, -np.inf, -np.inf])
#: How much a made text counts beside a labelled one.
SHOWN = 0.25


def context(ws: list[bytes], i: int) -> tuple[float, float]:
    """How far the words around a find speak of quotation, and of abuse."""
    around = ws[max(0, i - WINDOW) : i + WINDOW + 1]
    quoted = aimed = 0.0
    for j, w in enumerate(around):
        near = 1.0 / (1 + abs(j - min(i, WINDOW)))
        b = bare(w)
        quoted += near * (b in REPORT) + near * any(q in w for q in QUOTES)
        aimed += near * (b in ADDRESS) + near * (b"!" in w)
    return quoted, aimed


def misspelled_text(ws: list[bytes], at: list[int]) -> list[bytes]:
    """The words with each find an edit off: a letter from its second to its fourth, chosen by the word, is left out."""
    out = list(ws)
    for i in at:
        s = ws[i].decode("utf-8", "replace")
        first = next((k for k, ch in enumerate(s) if ch.encode() not in EDGE), 0)
        k = first + 1 + zlib.crc32(bare(ws[i])) % 3
        out[i] = (s[:k] + s[k + 1 :]).encode()
    return out


def reported_text(ws: list[bytes], at: list[int]) -> list[bytes]:
    """The words with each find as someone's words: in quotation marks, between words of report, without address or exclamation around it."""
    near, finds = {j for i in at for j in range(i - WINDOW, i + WINDOW + 1)}, set(at)
    out: list[bytes] = []
    for j, w in enumerate(ws):
        if j in finds:
            out += [b"said", b'"' + bare(w) + b'"', b"wrote"]
        elif j not in near or bare(w) not in ADDRESS:
            out.append(w.replace(b"!", b"") or b"." if j in near else w)
    return out


def measures(text: bytes, found: Finder) -> tuple[float, ...]:
    return measured(text.split(), found)


def measured(ws: list[bytes], found: Finder) -> tuple[float, ...]:
    at = [(i, k) for i, k in enumerate(map(found.__getitem__, ws)) if k[0]]
    if not at:
        return (0.0,) * len(COLUMNS)
    abuse = misspelled = told = meant = 0.0
    entries: dict[int, float] = {}
    for i, (what, entry) in at:
        quoted, aimed = context(ws, i)
        weight, share = found.strength[entry], 1 / (1 + math.exp(quoted - aimed - 1))
        told += weight * (1 - share)
        meant += share
        entries[entry] = max(share, entries.get(entry, 0.0))
        if what in (NEAR_WHOLE, NEAR_STEM):
            misspelled += weight * share
        else:
            abuse += weight * share
    return (math.log1p(abuse), math.log1p(misspelled), math.log1p(told), min(1.0, 100 * meant / len(ws)), math.log1p(sum(entries.values())))


def terms_of(text: bytes) -> set[str]:
    """Distinct words of four letters or more, and their stems (written with a *)."""
    out = set()
    for w in {bare(x) for x in text.split()}:
        s = w.decode("utf-8", "replace")
        if 4 <= len(s) <= 40:
            out.add(s)
            out.update(s[:k] + "*" for k in range(MIN_STEM, min(len(s), 9)))
    return out


def document_counts(rows: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """term, n: the number of texts with each term, or with each of the wanted ones; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                ts = terms_of(t)
                c.update(ts if wanted is None else ts & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def odds(n: np.ndarray, of: int, m: np.ndarray, rest: int, z: float = 2.58) -> np.ndarray:
    """The lower end of the confidence interval of the logarithm of the odds ratio: n of ``of`` against m of ``rest``."""
    ratio = np.log((n + 0.5) / (of - n + 0.5)) - np.log((m + 0.5) / (rest - m + 0.5))
    return ratio - z * np.sqrt(1 / (n + 0.5) + 1 / (of - n + 0.5) + 1 / (m + 0.5) + 1 / (rest - m + 0.5))


def learn_lexicon(rows: DataFrame, least_share: float = 0.012, lift: float = 0.8) -> Lexicon:
    """Terms in at least ``least_share`` of the toxic texts whose log odds ratio is ``lift`` at least with 99 per cent confidence."""
    n1, n0 = rows.where("y = 1").count(), rows.where("y = 0").count()
    if not n1 or not n0:
        return Lexicon([], [], [], [])
    least = max(4, least_share * n1)
    toxic = {r.term: r.n for r in document_counts(rows.where("y = 1")).where(F.col("n") >= least).collect()}  # at most a text's terms / least_share
    other = {r.term: r.n for r in document_counts(rows.where("y = 0"), frozenset(toxic)).collect()}
    names = list(toxic)
    low = dict(zip(names, odds(np.array([toxic[t] for t in names], float), n1, np.array([other.get(t, 0) for t in names], float), n0).tolist(), strict=True))
    good = {t for t, x in low.items() if x >= lift}
    # a stem stands for words only if it is found in more texts than any word under it, else the word alone is meant
    stems = set()
    for t in sorted((t for t in good if t.endswith("*")), key=len):
        s = t[:-1]
        if any(s.startswith(x) for x in stems):
            continue
        under = max((n for w, n in toxic.items() if not w.endswith("*") and w.startswith(s)), default=0)
        if toxic[t] >= 1.5 * max(under, 1):
            stems.add(s)
    whole = {t for t in good if not t.endswith("*") and not any(t.startswith(s) for s in stems)}
    entries = [*sorted(whole), *(f"{x}*" for x in sorted(stems))]
    strength = [min(4.0, low[t]) for t in entries]
    near = [len(t.rstrip("*")) >= NEAR_FROM for t in entries]
    return without_false_friends(rows, Lexicon(sorted(whole), sorted(stems), strength, near), n1, n0)


def without_false_friends(rows: DataFrame, lexicon: Lexicon, n1: int, n0: int) -> Lexicon:
    """No entry may be an edit off whose near finds are no commoner in toxic than in clean texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, c = finder(lexicon), Counter()
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                c.update({(k[1], y) for k in map(f.__getitem__, set(t.split())) if k[0] in (NEAR_WHOLE, NEAR_STEM)})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in c], pa.int32()), pa.array([y for _, y in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["entry", "y", "n"])

    seen = {(r.entry, r.y): r.n for r in rows.select("text", "y").mapInArrow(run, "entry int, y int, n long").groupBy("entry", "y").agg(F.sum("n").alias("n")).collect()}  # two rows an entry at most
    near = [x and not (seen.get((i, 0), 0) and seen.get((i, 1), 0) / n1 <= 2 * seen[i, 0] / n0) for i, x in enumerate(lexicon.near)]
    return Lexicon(lexicon.whole, lexicon.stems, lexicon.strength, near)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.base + x @ self.weights, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """A logistic model of rows that count so much, whose weights have normal priors and least values: Newton steps, one weight at a time."""
    if not len(y) or y.min() == y.max():
        share = float(y[0]) if len(y) else 0.5
        return np.zeros(x.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    w, base = PRIOR.copy(), 0.0
    margin = x @ w + base
    for _ in range(rounds):
        moved = 0.0
        for j in range(-1, len(w)):
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            column = np.ones(len(y)) if j < 0 else x[:, j]
            pull, stiff = (0.0, 1e-6) if j < 0 else (ridge * (w[j] - PRIOR[j]), ridge)
            step = float(np.clip(((y - p) * counts @ column - pull) / ((p * (1 - p)) * counts @ column**2 + stiff), -1, 1))
            if j >= 0:
                step = max(w[j] + step, LEAST[j]) - w[j]
                w[j] += step
            else:
                base += step
            margin += step * column
            moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return w, base


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = cut(labelled_sample(docs, labels, "toxic", lambda i: by_crc(i, 5) != 0, sample))
    lexicon = learn_lexicon(rows)

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        f = finder(lexicon)
        out = []
        for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True):
            ws = t.split()
            out.append((i, list(measured(ws, f)), y, 1.0))
            at = [k for k, w in enumerate(ws) if f[w][0]] if y else []
            if at:
                made = ((list(measured(misspelled_text(ws, at), f)), 1), (list(measured(reported_text(ws, at), f)), 0))
                out += [(i, x, label, SHOWN) for x, label in made if any(x)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.float64()), strict=True)], ["doc_id", "x", "y", "counts"])

    got = sorted(by_batch(rows, measure, "doc_id long, x array<double>, y int, counts double").collect())  # at most three times ``sample`` rows of a few numbers
    return Model(lexicon, *logistic(np.array([r.x for r in got]).reshape(len(got), len(COLUMNS)), np.array([r.y for r in got], float), np.array([r.counts for r in got], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        f = finder(model.lexicon)
        p = model.scores(np.array([measures(t, f) for t in b.column("text").to_pylist()]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return by_batch(text_of(docs, (by_crc(F.col("doc_id"), 5) == 0).alias("held_out")), run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))
