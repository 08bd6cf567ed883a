"""Fuzzy line dedup: blocks of rare words, edit similarity, one occurrence a group.

A line is normalised (ASCII lower case, ASCII punctuation and white space aside). Equal normalised lines are one node with its
first occurrence (smallest doc_id, null last; then the text's hash, then the line). Nodes of ``min_words`` words or more are
linked if their word sequences' edit similarity is at least ``similarity``. Of each connected group the first occurrence stays.

No link is lost before the edit check, which blocks of a SimHash cannot offer here: lines that differ in one word of ten
differ in some ten of 64 bits. The pigeonholes are words instead. One edit takes at most one word from what two lines
share, so the rarest of the words that an alignment keeps is among the e + 1 rarest of either line, e being the edits allowed. Each
line is sent to the blocks of those words. (How rare words are is taken from a sample of documents: it decides the speed only.)
In a block, pairs are passed over whose lengths, or the word's places, are too far apart, and pairs whose parity sketches (a
SimHash in which each word flips one bit) differ in more bits than the edits could flip.

A block reports a forest of its candidates, never its pairs. The forests' components hold every true group whole, so
each is verified by itself, with its words sent once; components beyond ``most`` nodes are verified block by block.
Pairs that are already connected are passed over, and the links found are again a forest, whose components are the groups.

Lines travel packed: a task adds up some 2 million keys, drops its own repeats, and writes one row a range of keys.

Defined cases: lines without words always stay; null texts have no lines and stay as they are; a repeated row is treated like
its twin, and rows of one doc_id with different texts are different documents; a null doc_id comes after all others; an empty
table gives no rows; other columns are kept, and columns named n_lines or n_removed are replaced by ``without_repeated_lines``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, component_labels, cut, groups_of, mix, powers, signed, slot, slots_of, text_hash, text_of
from .simhash import runs_of

PUNCTUATION = bytes(x for x in range(33, 127) if not chr(x).isalnum())
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
SLOTS = 1 << 20
HALF = np.uint64(32)
#: Layouts of packed rows. Numbers that are small as a rule are cut into a low and a high half, which compress apart.
OCCURRENCE = ("<u8", "u1", "<i8", "<i8", "<i4")  # h, whether doc_id is null, doc_id, the text's hash, line
PLACE = ("<u4", "<u2", "<u2", "<u2", "<u2")  # key, node (low, high), place of the word (low, high)
NODE = ("<u8", "<u4")  # h, number of words
PACKED = "kind int, r int, rows binary, nodes binary, sketches binary"
FOUND = "h long, other long, doc_id long, th long, line int, first boolean"
LEVELS = 4


def line_words(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a normalised text, and the number of its line."""
    a = np.frombuffer(plain, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    black = np.zeros(len(a) + 2, np.int8)
    black[1:-1] = ~WHITE[a]
    step = np.diff(black)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = powers(len(a))
    with np.errstate(over="ignore"):
        run = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=run[1:])
        hashes = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(np.flatnonzero(a == 10), starts)


def most_edits(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """The edits that a line and a shorter one may be apart."""
    return np.floor((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def hashed_lines(hashes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line with words: a hash of its words in order, and its number of words."""
    if not len(hashes):
        return hashes, line
    at = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    n = np.diff(np.r_[at, len(line)])
    up, down = powers(len(hashes))
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(hashes * up[: len(hashes)], at) * down[at] + n.astype(np.uint64)), n


def pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts, many small ones at a time, large ones cut between lines. Of each piece: whether its doc_id is null, doc_id, the text's
    hash, its first line, and the number that this line has over all pieces; then the hashes of all words and their lines, counted over all pieces."""
    about, parts, size = [], [], 0

    def full() -> tuple[np.ndarray, ...]:
        nul, doc, th, first, lines = (np.array(x, np.int64) for x in zip(*about, strict=True))
        return nul, doc, th, first, np.cumsum(lines) - lines, *line_words(b"\n".join(parts))

    for b in batches:
        hashes = b.column("th").to_pylist() if "th" in b.schema.names else [0] * b.num_rows
        for doc, th, text in zip(b.column("doc_id").to_pylist(), hashes, b.column("text").to_pylist(), strict=True):
            plain, first = text.translate(LOWER, PUNCTUATION), 0
            while plain:
                end = len(plain) if len(plain) <= most else plain.find(b"\n", most)
                end = len(plain) if end < 0 else end
                lines = plain.count(b"\n", 0, end) + 1
                about.append((doc is None, doc or 0, th, first, lines))
                parts.append(plain[:end])
                size += end + 1
                if size >= most:
                    yield full()
                    about, parts, size = [], [], 0
                first += lines
                plain = plain[end + 1 :]
    if parts:
        yield full()


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a line's sketch: more for longer lines, which may be more edits apart."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 48)), 0, LEVELS - 1).astype(np.int64)


def sketched(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The parity sketches of lines in a row: each word flips one bit."""
    k = sketch_words(n)
    of = np.repeat(np.arange(len(n)), n)
    out = np.zeros(int(k.sum()), np.uint64)
    at = (np.cumsum(k) - k)[of] + ((hashes >> np.uint64(6)) & (k[of] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (hashes & np.uint64(63)))
    return out


def folded(flat: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Sketches at each level (1, 2, 4 ... words a line): a sketch of half the size is the two halves added bit by bit."""
    k = sketch_words(n)
    at = np.cumsum(k) - k
    levels = [np.zeros((len(n), 1 << i), np.uint64) for i in range(LEVELS)]
    for i in range(LEVELS):
        mine = np.flatnonzero(k == 1 << i)
        part = flat[at[mine][:, None] + np.arange(1 << i)]
        for j in range(i, -1, -1):
            levels[j][mine] = part
            if j:
                part = part[:, : 1 << (j - 1)] ^ part[:, 1 << (j - 1) :]
    return levels


def apart(levels: list[np.ndarray], k: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs' sketches differ in more than ``most`` bits, at the finest level that both have."""
    out = np.zeros(len(x), bool)
    for i, level in enumerate(levels):
        todo = np.flatnonzero(~out & (np.minimum(k[x], k[y]) >= 1 << i))
        if not len(todo):
            break
        out[todo] = np.bitwise_count(level[x[todo]] ^ level[y[todo]]).sum(1, dtype=np.int64) > most[todo]
    return out


def prefixes(keys: np.ndarray, n: np.ndarray, ranks: np.ndarray, similarity: float, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of lines in a row, given the keys of their words: the places (over all) of the words of each prefix, and their lines."""
    of = np.repeat(np.arange(len(n)), n)
    rank = ranks[keys & np.uint32(SLOTS - 1)]
    order = np.lexsort((keys, rank, of)) if len(n) >> 24 else np.argsort(of.astype(np.uint64) << np.uint64(40) | rank.astype(np.uint64) << HALF | keys.astype(np.uint64))
    many = np.where(n >= min_words, most_edits(n, similarity), -1)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) <= many[of]
    return order[inside], of[inside]


def packed(*columns: np.ndarray, layout: tuple[str, ...]) -> bytes:
    return b"".join(np.ascontiguousarray(c, d).tobytes() for c, d in zip(columns, layout, strict=True))


def unpacked(raw: list[bytes], layout: tuple[str, ...]) -> list[np.ndarray]:
    width, out = sum(np.dtype(d).itemsize for d in layout), [[] for _ in layout]
    for x in raw:
        m, at = len(x) // width, 0
        for o, d in zip(out, layout, strict=True):
            o.append(np.frombuffer(x, d, m, at))
            at += m * np.dtype(d).itemsize
    return [np.concatenate(o) if o else np.zeros(0, d) for o, d in zip(out, layout, strict=True)]


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x & 0xFFFF, x >> 16


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 16


def word_ranks(docs: DataFrame, part: int = 16) -> np.ndarray:
    """How common the words of each hash slot are in a sample of documents, on a logarithmic scale: the order of the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(SLOTS, np.int64)
        for *_, w, _ in pieces(batches):
            c += np.bincount((w >> HALF & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at])], ["at", "c"])

    sample = text_of(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(part)) == 0)).mapInArrow(run, "at int, c long")
    got = sample.groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    ranks = np.zeros(SLOTS, np.uint8)
    ranks[got.column("at").to_numpy()] = np.minimum(255, 8 * np.log2(1.0 + got.column("c").to_numpy()))
    return ranks


def dealt_lines(texts: DataFrame, ranks: np.ndarray, ranges: int, similarity: float, min_words: int, most: int = 2_000_000) -> DataFrame:
    """Packed rows by kind and range. Kind 0: the first occurrences in a task of its lines, by the line's hash; 1: the places of
    the prefixes' words, by key, with the lines they are in; 2: occurrences that an earlier one of the same task stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for *piece, w, line in pieces(batches):
            if len(w):
                h, n = hashed_lines(w, line)
                number = line[np.cumsum(n) - 1]
                at = np.searchsorted(piece[4], number, "right") - 1
                nul, doc, th, first, start = (x[at] for x in piece)
                places, of = prefixes((w >> HALF).astype(np.uint32), n, ranks, similarity, min_words)
                held.append(((h, nul, doc, th, first + number - start), n, sketched(w, n), (w[places] >> HALF).astype(np.uint32), (places - (np.cumsum(n) - n)[of]).astype(np.uint32), of.astype(np.uint32)))
                size += len(of) + len(n)
            if size >= most:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        rows = [np.concatenate(x) for x in zip(*[x[0] for x in held], strict=True)]
        h, n = rows[0], np.concatenate([x[1] for x in held])
        order = np.lexsort((*rows[:0:-1], h))
        new, same = firsts_of([x[order] for x in rows])
        mine = np.zeros(len(h), bool)
        mine[order[new]] = True  # the first occurrence here of each line
        out = [(0, r, packed(*[x[order[new]][a:b] for x in rows], layout=OCCURRENCE), b"", b"") for r, a, b in ranges_of(h[order[new]], ranges)]
        rest = order[~same]
        if len(rest):
            out.append((2, int(h[rest[0]] % np.uint64(ranges)), packed(*[x[rest] for x in rows], layout=OCCURRENCE), b"", b""))
        sizes = [len(x[1]) for x in held]
        shift = np.cumsum([0, *sizes[:-1]])
        key, place, of = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]), np.concatenate([x[5] + np.uint32(d) for x, d in zip(held, shift.tolist(), strict=True)])
        flat, k = np.concatenate([x[2] for x in held]), sketch_words(n)
        begin = np.cumsum(k) - k
        keep = np.flatnonzero(mine[of])
        keep = keep[np.argsort(key[keep], kind="stable")]
        key, place, of = key[keep], place[keep], of[keep]
        for r, a, b in ranges_of(key.astype(np.uint64) << HALF, ranges):
            nodes, local = np.unique(of[a:b], return_inverse=True)
            words = np.repeat(begin[nodes] - (np.cumsum(k[nodes]) - k[nodes]), k[nodes]) + np.arange(int(k[nodes].sum()))
            out.append((1, r, packed(key[a:b], *halves(local), *halves(place[a:b]), layout=PLACE), packed(h[nodes], n[nodes], layout=NODE), flat[words].astype("<u8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["kind", "r", "rows", "nodes", "sketches"])

    return texts.mapInArrow(run, PACKED)


def ranges_of(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted keys, by their upper 32 bits."""
    r = ((keys >> HALF) * np.uint64(ranges)) >> HALF
    edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]) if len(r) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(r[a]), a, b


def firsts_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted occurrences: where a hash begins, and which rows are the same place as the first of their hash (twins of a repeated row)."""
    if not len(rows[0]):
        return np.zeros(0, bool), np.zeros(0, bool)
    new = np.r_[True, rows[0][1:] != rows[0][:-1]]
    at = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return new, np.logical_and.reduce([x == x[at] for x in rows])


def occurrences(raw: list[bytes], first: bool) -> pa.Table:
    """The lines of a range; with ``first``, which of each hash's occurrences is the first."""
    h, nul, doc, th, line = unpacked(raw, OCCURRENCE)
    order = np.lexsort((line, th, doc, nul, h))
    h, nul, doc, th, line = (x[order] for x in (h, nul, doc, th, line))
    new = firsts_of([h, nul, doc, th, line])[1] & first
    return pa.table({"h": signed(h), "other": pa.nulls(len(h), pa.int64()), "doc_id": pa.array(doc, mask=nul.astype(bool)), "th": th, "line": line, "first": new})


class Trees:
    """Union-find over 0..n-1; ``root`` holds each node's root after ``settle``."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def link(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that join two trees."""
        out = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            p, q = self.find(a), self.find(b)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                out.append((a, b))
        return out

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up


def candidates(rows: list[bytes], nodes: list[bytes], sketches: list[bytes], similarity: float) -> pa.Table:
    """Edges (h, other) that join the candidates met in the blocks of a range: a star a tree."""
    h, n = unpacked(nodes, NODE)
    shift = np.cumsum([0, *[len(x) // 12 for x in nodes[:-1]]])
    key, low, high, place_low, place_high = unpacked(rows, PLACE)
    node = whole(low, high) + np.repeat(shift, [len(x) // 12 for x in rows])
    levels = folded(np.frombuffer(b"".join(sketches), "<u8"), n)
    h, kept, same = np.unique(h, return_index=True, return_inverse=True)  # nodes in order of h: the least of a tree is its root
    n, levels, node = n[kept].astype(np.int64), [x[kept] for x in levels], same[node]
    k, edits_ = sketch_words(n), most_edits(n, similarity)
    place = whole(place_low, place_high)
    order = np.argsort(key.astype(np.uint64) << HALF | n[node].astype(np.uint64))
    key, node, place = key[order], node[order], place[order]
    size, most = n[node], edits_[node]
    number = np.cumsum(np.r_[0, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    starts, block = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), number << 40
    reach = np.searchsorted(block + size - most, block + size, "right") - 1 - np.arange(len(key))  # rows of a block are in order of size
    trees, x, step = Trees(len(n)), np.flatnonzero(reach > 0), 0
    while len(x):  # each row and the one ``step`` places on
        step += 1
        x = x[reach[x] >= step]
        y = x + step
        off = place[x] - place[y]
        ok = (np.abs(off) + np.abs(size[x] - size[y] - off) <= most[y]) & (trees.root[node[x]] != trees.root[node[y]])
        p, q = node[x[ok]], node[y[ok]]
        shared = n[q] - edits_[q]
        ok = ~apart(levels, k, p, q, n[p] + n[q] - 2 * shared)
        if trees.link(p[ok], q[ok]):
            trees.settle()
        if not step & (step - 1) and len(x):  # a block that is one tree by now is done
            of = trees.root[node]
            whole_ = np.minimum.reduceat(of, starts) == np.maximum.reduceat(of, starts)
            x = x[~whole_[number[x]]]
    own = np.arange(len(n))
    leaf = own[trees.root != own]
    m = len(leaf)
    return pa.table({"h": signed(h[leaf]), "other": signed(h[trees.root[leaf]]), "doc_id": pa.nulls(m, pa.int64()), "th": pa.nulls(m, pa.int64()), "line": pa.nulls(m, pa.int32()), "first": pa.nulls(m, pa.bool_())})


def edits(a: list[int], b: list[int]) -> int:
    """Levenshtein distance of two sequences, a column of the table at a time as the bits of one number."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = (down | ~(across | up)) & full, up & across
        distance += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
    return distance


def similar(a: list[int], b: list[int], least: float) -> bool:
    """Whether 1 - (word edits) / (words of the longer) is at least ``least``."""
    n, m = len(a), len(b)
    most = int((1 - least) * max(n, m) + 1e-9)
    if abs(n - m) > most:
        return False
    p = 0
    while p < min(n, m) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(n, m) - p and a[n - 1 - q] == b[m - 1 - q]:
        q += 1
    return edits(a[p : n - q], b[p : m - q]) <= most


def links(words: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the lines whose edit similarity is at least ``similarity``."""
    n = np.array([len(x) for x in words], np.int64)
    order = np.argsort(n, kind="stable")
    n, ws, lists, bags = n[order], [words[i] for i in order.tolist()], {}, {}
    most = most_edits(n, similarity)
    out = []
    wide = 16  # words of a sketch: it need not travel, so it may be fine
    if len(n) > 8:
        w = np.concatenate(ws).astype(np.uint64)
        sketch = np.zeros((len(n), wide), np.uint64)
        np.bitwise_xor.at(sketch, (np.repeat(np.arange(len(n)), n), (w >> np.uint64(6) & np.uint64(wide - 1)).astype(np.int64)), np.uint64(1) << (w & np.uint64(63)))

    def at(i: int) -> list[int]:
        if i not in lists:
            lists[i] = ws[i].tolist()
        return lists[i]

    def bag(i: int) -> Counter:
        if i not in bags:
            bags[i] = Counter(at(i))
        return bags[i]

    label = np.arange(len(n))
    for x in range(1, len(n)):
        a = int(np.searchsorted(n[:x], n[x] - most[x]))
        y = np.arange(a, x)
        if len(n) > 8:
            off = np.bitwise_count(sketch[a:x] ^ sketch[x]).sum(1, dtype=np.int64)
            near = np.flatnonzero(off <= n[a:x] + n[x] - 2 * (n[x] - most[x]))
            y = a + near[np.argsort(off[near], kind="stable")]
        while len(y):
            j, y = int(y[0]), y[1:]
            # words that both have: an alignment keeps no more of them
            if int(n[x]) - sum((bag(x) & bag(j)).values()) <= most[x] and similar(at(x), at(j), similarity):
                out.append((int(order[x]), int(order[j])))
                label[: x + 1][label[: x + 1] == label[x]] = label[j]
                y = y[label[y] != label[x]]  # what is connected already needs no look
    return out


def words_of(texts: DataFrame, nodes: DataFrame, slots: int = 1 << 22) -> DataFrame:
    """h and its words (32 bits each), for nodes (h): taken where the texts lie, then shuffled without them."""
    at = nodes.select(F.col("h").bitwiseAND(slots - 1).cast("int").alias("at")).distinct().toArrow().column("at").to_numpy()  # at most ``slots`` rows, whatever the input
    wanted = np.packbits(np.isin(np.arange(slots), at))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, seen = np.unpackbits(wanted).astype(bool), np.zeros(0, np.uint64)
        for *_, w, line in pieces(batches):
            h, n = hashed_lines(w, line)
            end = np.cumsum(n)
            mine = np.flatnonzero(some[(h & np.uint64(slots - 1)).astype(np.int64)])
            mine = mine[np.unique(h[mine], return_index=True)[1]]
            mine = mine[~np.isin(h[mine], seen)]
            seen = np.r_[seen[-200_000:], h[mine]]  # a line that many documents have is sent once, as far as is remembered
            key = (w >> HALF).astype("<u4")
            raw = [key[e - m : e].tobytes() for e, m in zip(end[mine].tolist(), n[mine].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[mine])), pa.array(raw, pa.binary())], ["h", "words"])

    return texts.mapInArrow(fetch, "h long, words binary").join(nodes, "h")


def verified(texts: DataFrame, edges: DataFrame, ranks: np.ndarray, similarity: float, most: int) -> DataFrame:
    """Edges (a, b): a spanning forest of the similar nodes of each component of the candidates."""
    roots = cut(component_labels(edges, "h", "other"))
    sizes = roots.groupBy("root").count().where(F.col("count") > most).select(F.col("root").alias("big"))
    nodes = roots.join(sizes, roots["root"] == sizes["big"], "left").select(F.col("node").alias("h"), "root", F.col("big").isNotNull().alias("big"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, words = b.column("root").to_numpy(), b.column("words")
            big = np.flatnonzero(b.column("big").to_numpy(zero_copy_only=False))
            at, blocks = np.flatnonzero(~b.column("big").to_numpy(zero_copy_only=False)), []
            blocks.append(block[at])
            for i in big.tolist():  # a large component is verified word by word
                w = np.frombuffer(words[i].as_py(), "<u4")
                mine = np.unique(w[prefixes(w, np.array([len(w)]), ranks, similarity, 0)[0]])
                at = np.r_[at, np.full(len(mine), i)]
                blocks.append(signed(mix(mine.astype(np.uint64) ^ block[i : i + 1].view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), b.column("h").take(pa.array(at)), words.take(pa.array(at))], ["block", "h", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "block"):
            block, h, raw = t.column("block").to_numpy(), t.column("h").to_numpy(), t.column("words").to_pylist()
            for i, j in runs_of(block):
                once = np.unique(h[i:j], return_index=True)[1] + i
                for x, y in links([np.frombuffer(raw[k], "<u4") for k in once.tolist()], similarity):
                    yield pa.RecordBatch.from_arrays([pa.array([h[once[x]]]), pa.array([h[once[y]]])], ["a", "b"])

    rows = words_of(texts, nodes).mapInArrow(spread, "block long, h long, words binary")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: together(run(it)), "a long, b long")


def together(batches: Iterator[pa.RecordBatch], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Fewer and larger batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if len(held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def repeated_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = 5, range_bytes: int = 16_000_000, most: int = 20_000) -> DataFrame:
    """(doc_id, th, line): the occurrences that an earlier one of their group stands for; th: xxhash64 of the text."""
    texts = text_of(docs, text_hash().alias("th"))
    ranks = word_ranks(docs)
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(16, -(-size // range_bytes))  # a line is sent to nearly as many ranges as it has keys, few inputs included

    def meet(t: pa.Table) -> pa.Table:
        kind, rows = t.column("kind")[0].as_py(), t.column("rows").to_pylist()
        return candidates(rows, t.column("nodes").to_pylist(), t.column("sketches").to_pylist(), similarity) if kind == 1 else occurrences(rows, kind == 0)

    found = cut(dealt_lines(texts, ranks, ranges, similarity, min_words).groupBy("kind", "r").applyInArrow(meet, FOUND))
    lines = found.where("line is not null").select("h", "doc_id", "th", "line", "first")
    edges = cut(verified(texts, found.where("other is not null").select("h", "other"), ranks, similarity, most))
    roots = component_labels(edges)
    where = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "th", "line")
    tied = cut(lines.where("first").join(roots.withColumnRenamed("node", "h"), "h").select("root", where.alias("at")))
    keep = tied.groupBy("root").agg(F.min("at").alias("keep"))
    lost = tied.join(keep, "root").where("at <> keep").select("at.doc_id", "at.th", "at.line")
    return lines.where("not first").select("doc_id", "th", "line").union(lost)


def rewritten(docs: DataFrame, similarity: float = 0.8, min_words: int = 5) -> DataFrame:
    """The documents with their columns, the text without its repeated lines, and a column __lines (n_lines, n_removed)."""
    gone = repeated_lines(docs, similarity, min_words).groupBy("doc_id", "th").agg(F.collect_set("line").alias("__gone"))
    gone = cut(gone.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "__gone"))
    slots = F.broadcast(slots_of(gone, "__th").withColumnRenamed("slot", "__slot"))
    marked = docs.withColumn("__own", text_hash())
    here = slot("__own") == F.col("__slot")
    # only the texts that may lose a line are shuffled, and always: no small table takes another way than a large one
    touched = marked.join(slots, here, "left_semi").join(gone.hint("merge"), (F.col("__own") == F.col("__th")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left").drop("__doc", "__th")
    others = marked.join(slots, here, "left_anti").withColumn("__gone", F.lit(None).cast("array<int>"))
    # a text is split once, whatever the number of its lines
    kept = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept[0])
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))  # texts that stay are not split
    about = F.struct(F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long").alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"))
    return touched.unionByName(others).select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], about.alias("__lines"))


def without_repeated_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = 5) -> DataFrame:
    """The documents with their columns, and n_lines and n_removed; the text without its repeated lines."""
    out = rewritten(docs, similarity, min_words)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], "__lines.n_lines", "__lines.n_removed")
