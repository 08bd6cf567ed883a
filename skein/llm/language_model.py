"""Language-model scoring with a weighted backoff automaton.

States are the empty history and every word and pair of words that the training documents hold. A state's arcs are the tokens
seen after it; an arc's weight is the n-gram's smoothed probability, (count + mu x shorter history's probability) /
(total + mu), and its failure arc, of weight mu / (total + mu), leads to the shorter history; at the empty history the base
share ends the descent. So the weights of each state sum to one over the known tokens and the unknown one. mu, one for words
and one for pairs, is estimated from the counts of counts: the average failure weight is the share that absolute
discounting, with discount n1 / (n1 + 2 n2), takes from the seen n-grams. A text is read once from left to right: the state
is carried, an arc or the failure arcs down to one are followed, and their logarithms are added up. All texts of
a group are read side by side, a token of each at a time.

Nothing of the model is held whole. Documents are dealt into groups of ``group_chars`` by hash. A group asks for its
distinct words, pairs and triples (sorted keys, packed as differences and split by key range); a range adds up the training counts and
answers each group with the counts alone, in the order in which it asked. Each distinct n-gram so crosses the network once a
group, in some four bytes, and its count comes back in one. A group sends at most a row a range, and never more rows than keys;
larger groups, where executors have the memory (some thirty times a group's size), make fewer and larger rows. Texts are dealt once,
for asking and for reading: one exchange serves both.

Defined cases: a null text is empty, its only token is the end; without training documents N and V are 0 and
every token has the unknown token's share; a null doc_id counts as the text "" for the split; repeated rows count
as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, text_of, word_hashes

END = np.uint64(0x5BF03635D1E7D2C3)
REPLY = "r int, g int, counts binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: A key: its range, 44 bits of a hash, the order of the n-gram (1 to 3), and one bit that is free. A range has few keys (a group's), so these do not meet by chance.
HASH_BITS = 44
INNER = np.uint64((1 << (HASH_BITS + 3)) - 1)
ORDER = np.uint64(6)


def tokens(text: bytes) -> np.ndarray:
    return np.append(word_hashes(text.lower()), END)


def keyed(hashes: np.ndarray, order: int, ranges: int) -> np.ndarray:
    """Keys in the order of their ranges. Ranges: at most 2**17."""
    r = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return r << np.uint64(HASH_BITS + 3) | (hashes & np.uint64((1 << HASH_BITS) - 1)) << np.uint64(3) | np.uint64(2 * order)


def ngrams(texts: list[bytes], ranges: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of all texts in a row: the places where they begin (and the end), and the keys of the word, the pair and the triple
    that end at each place; where a text has none, the key is 0."""
    each = [tokens(t) for t in texts]
    at = np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)
    x = np.concatenate(each) if each else np.zeros(0, np.uint64)
    del each
    hashes, out = x, [keyed(x, 1, ranges)]
    for k in (1, 2):
        longer = np.zeros(len(x), np.uint64)
        if len(x) > k:
            with np.errstate(over="ignore"):
                longer[k:] = mix(hashes[k - 1 : -1] * np.uint64(0x9E3779B97F4A7C15) + x[k:] + np.uint64(k))
        hashes = longer
        keys = keyed(hashes, k + 1, ranges)
        for back in range(k):  # a text's first place has no pair, its first two no triple
            first = at[:-1] + back
            keys[first[first < at[1:]]] = 0
        out.append(keys)
    return at, out


def distinct(keys: list[np.ndarray], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each stands at a place that is not held out."""
    marked = np.concatenate([k[k != 0] | held[k != 0].astype(np.uint64) for k in keys])
    marked.sort()
    bare = marked & ~np.uint64(1)
    first = np.flatnonzero(np.r_[True, bare[1:] != bare[:-1]]) if len(bare) else np.zeros(0, np.int64)
    trained = np.r_[0, np.cumsum((marked & np.uint64(1)) == 0)]
    return bare[first], np.diff(np.r_[trained[first], trained[-1]]) if len(first) else np.zeros(0, np.int64)


def squeezed(counts: np.ndarray) -> bytes:
    """A byte a count; those from 255 follow in full."""
    big = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[big].astype("<i8").tobytes()


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def ranges_of(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted keys."""
    r = keys >> np.uint64(HASH_BITS + 3)
    edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]) if len(r) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(r[a]), a, b


def narrowed(keys: np.ndarray) -> bytes:
    """Sorted keys of a range as differences: the low halves, then the upper 16 bits, which are zero where keys are many and so compress away."""
    inner = (keys & INNER) >> np.uint64(1)
    step = np.diff(inner, prepend=np.uint64(0))
    return (step & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (step >> np.uint64(32)).astype("<u2").tobytes()


def widened(raw: bytes) -> np.ndarray:
    """The keys without their range."""
    n = len(raw) // 6
    step = np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)
    return np.cumsum(step) << np.uint64(1)


def train_rows(docs: DataFrame) -> DataFrame:
    """Texts with held_out: crc32 of doc_id as text, modulo 5, is 1."""
    return text_of(docs, (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held_out"))


def buckets(counts: np.ndarray) -> np.ndarray:
    """Counts up to 1024 as they are; larger ones in steps of under one per cent."""
    return np.where(counts <= 1024, counts, 1024 + np.ceil(np.log(np.maximum(counts, 1024) / 1024) * 128)).astype(np.int64)


def answers(asked: DataFrame) -> DataFrame:
    """(r, g, counts): the training counts of each group's keys of a range; and with g = -1 the range's counts of counts."""
    end = keyed(np.array([END]), 1, 1)[0]

    def run(t: pa.Table) -> pa.Table:
        ks = [widened(x) for x in t.column("keys").to_pylist()]
        sizes = [len(k) for k in ks]
        counts = np.concatenate([unsqueezed(x, n) for x, n in zip(t.column("counts").to_pylist(), sizes, strict=True)])
        keys = np.concatenate(ks)
        del ks
        order = np.argsort(keys, kind="stable")  # runs that are in order each
        keys = keys[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        sums = np.add.reduceat(counts[order], np.flatnonzero(first))
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(first) - 1
        ends = np.cumsum(sizes)
        out = [squeezed(sums[of[e - n : e]]) for n, e in zip(sizes, ends.tolist(), strict=True)]
        keys = keys[first]
        kinds, last = keys & ORDER, keys == end  # the end of a text is no history; its count is a row by itself
        mine = (sums > 0) & ~last
        table = [(int(o) // 2, *row) for o in np.unique(kinds[mine]) for row in zip(*grouped(sums[mine & (kinds == o)]), strict=True)]
        table += [(0, 0, 1, int(x)) for x in sums[last]]
        r = t.column("r")[0].as_py()
        out.append(np.array(table, "<i8").tobytes())
        return pa.table({"r": pa.array([r] * len(out), pa.int32()), "g": pa.concat_arrays([*t.column("g").chunks, pa.array([-1], pa.int32())]), "counts": pa.array(out, pa.binary())})

    return asked.groupBy("r").applyInArrow(run, REPLY)


def grouped(counts: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Bucket, how many counts, and their sum."""
    b, at, n = np.unique(buckets(counts), return_inverse=True, return_counts=True)
    return b.tolist(), n.tolist(), np.bincount(at, counts, len(b)).astype(np.int64).tolist()


def parameters(reply: DataFrame) -> DataFrame:
    """One row: counts, four packed numbers: N, V, mu of words and of pairs. Some two thousand rows an order are met in its task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("counts").to_pylist()), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], ["order", "bucket", "n", "total"])

    def solve(t: pa.Table) -> pa.Table:
        of: dict[int, dict[int, tuple[int, int]]] = {0: {}, 1: {}, 2: {}, 3: {}}
        for r in t.to_pylist():
            of[r["order"]][r["bucket"]] = (r["n"], r["total"])
        ends = sum(x[1] for x in of[0].values())
        total = ends + sum(x[1] for x in of[1].values())
        kinds = (ends > 0) + sum(x[0] for x in of[1].values())
        return pa.table({"counts": [np.array([total, kinds, prior(of[1], of[2]), prior(of[2], of[3])], "<f8").tobytes()]})

    sums = reply.where("g = -1").select("counts").mapInArrow(rows, "order long, bucket long, n long, total long").groupBy("order", "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.groupBy().applyInArrow(solve, "counts binary")


def prior(histories: dict[int, tuple[int, int]], ngrams_: dict[int, tuple[int, int]]) -> float:
    """mu: the weight of the shorter history, in counts, at which failure arcs get what discounting takes from the seen n-grams."""
    n1, n2 = (ngrams_.get(k, (0, 0))[0] for k in (1, 2))
    n, total = (np.array([x[i] for x in histories.values()], float) for i in (0, 1))
    if not len(n) or not n1:
        return 1.0
    share = n1 / (n1 + 2 * n2) * sum(x[0] for x in ngrams_.values()) / total.sum()
    low, high = 1e-4, 1e7
    for _ in range(100):
        mu = (low * high) ** 0.5
        if (total * mu / (total / n + mu)).sum() < share * total.sum():
            low = mu
        else:
            high = mu
    return mu


class Automaton:
    """The part of the automaton that a group's texts can reach: weights (log10) by the place of the token read."""

    def __init__(self, at: np.ndarray, counts: list[np.ndarray], base: np.ndarray, mu: tuple[float, float]):
        self.at, self.known, self.base = at, counts[0] > 0, np.log10(base)
        self.arcs, self.fails, p = [self.base], [np.zeros(len(base))], base
        for k in (1, 2):
            total = np.zeros(len(base))
            total[1:] = counts[k - 1][:-1]  # of the state that is left: the count of its own word or pair
            p = (counts[k] + mu[k - 1] * p) / (total + mu[k - 1])
            with np.errstate(divide="ignore"):
                self.arcs.append(np.where(counts[k] > 0, np.log10(p), -np.inf))  # no arc: only failure leads on
            self.fails.append(np.log10(mu[k - 1] / (total + mu[k - 1])))

    def read(self, most: int = 4096) -> np.ndarray:
        """The log10 probability of each text. Lanes are texts, or parts of them: a part begins two tokens early, which do not count, and so carries the state of the whole."""
        starts, texts, warm = [], [], []
        for i, (a, b) in enumerate(zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)):
            for p in range(a, b, most):
                starts.append((max(a, p - 2), min(b, p + most)))
                warm.append(p)
                texts.append(i)
        if not starts:
            return np.zeros(len(self.at) - 1)
        place, end = np.array(starts).T
        order = np.argsort(place - end, kind="stable")  # the longest first: lanes that have ended are at the back
        place, length, warm = place[order], (end - place)[order], np.array(warm)[order]
        state, score = np.zeros(len(order), np.int8), np.zeros(len(order))  # state: the words of its history
        alive = len(order)
        for step in range(int(length[0])):
            while length[alive - 1] <= step:
                alive -= 1
            p, s = place[:alive] + step, state[:alive]
            weight = np.zeros(alive)
            for k in (2, 1):
                fails = (s == k) & np.isneginf(self.arcs[k][p])
                weight[fails] += self.fails[k][p[fails]]
                s[fails] = k - 1
            weight += np.choose(s, [a[p] for a in self.arcs])
            score[:alive] += np.where(p >= warm[:alive], weight, 0.0)
            s[:] = np.where(s > 0, 2, self.known[p])  # where the arc leads
        return np.bincount(np.array(texts)[order], score, len(self.at) - 1)


def score_documents(docs: DataFrame, group_chars: int = 12_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    texts = train_rows(docs)
    chars = texts.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    groups = max(1, -(-chars // group_chars))
    ranges = min(groups, 1 << 17)
    dealt = texts.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).groupBy("g")

    def keys_of(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        at, keys = ngrams(t.column("text").to_pylist(), ranges)
        return at, keys, np.repeat(t.column("held_out").to_numpy().astype(bool), np.diff(at))

    def ask(t: pa.Table) -> pa.Table:
        _, keys, held = keys_of(t)
        u, c = distinct(keys, held)
        rows = [(r, narrowed(u[a:b]), squeezed(c[a:b])) for r, a, b in ranges_of(u)]
        r, k, n = zip(*rows, strict=True)
        return pa.table({"r": pa.array(r, pa.int32()), "g": pa.array([t.column("g")[0].as_py()] * len(r), pa.int32()), "keys": pa.array(k, pa.binary()), "counts": pa.array(n, pa.binary())})

    reply = answers(dealt.applyInArrow(ask, "r int, g int, keys binary, counts binary"))
    # each group also gets the few numbers that hold for all, as the answer of a range -1
    everywhere = docs.sparkSession.range(groups).select(F.lit(-1).alias("r"), F.col("id").cast("int").alias("g"))
    reply = reply.where("g >= 0").union(everywhere.crossJoin(F.broadcast(parameters(reply))))

    def read(t: pa.Table, sums: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c.split()[0]: pa.array([], x) for c, x in zip(OUT.split(", "), (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2), strict=True)})
        rows = dict(zip(sums.column("r").to_pylist(), sums.column("counts").to_pylist(), strict=True))
        total, kinds, *mu = np.frombuffer(rows[-1], "<f8").tolist()
        at, keys, held = keys_of(t)
        u, _ = distinct(keys, held)
        known = np.concatenate([unsqueezed(rows[r], b - a) for r, a, b in ranges_of(u)])
        counts = [np.where(k != 0, known[np.minimum(np.searchsorted(u, k), len(u) - 1)], 0) for k in keys]
        del keys, u, known
        model = Automaton(at, counts, (counts[0] + 0.5) / (total + 0.5 * (kinds + 1)), mu)
        n, first = np.diff(at), at[:-1]
        out = {"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": n, "n_known": np.add.reduceat(model.known, first, dtype=np.int64), "train_tokens": np.full(len(n), int(total)), "base_score": np.add.reduceat(model.base, first), "score": model.read()}
        return pa.table(out)

    return dealt.cogroup(reply.groupBy("g")).applyInArrow(read, OUT)


def perplexities(scored: DataFrame) -> Counter:
    """Of the held-out and the training documents: the perplexity of a token."""
    rows = scored.groupBy("held_out").agg(F.pow(10.0, -F.sum("score") / F.sum("n_tokens")).alias("p")).collect()
    return Counter({r["held_out"]: r["p"] for r in rows})
