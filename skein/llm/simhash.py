"""SimHash near-duplicate documents, and the pigeonhole join that finds close fingerprints.

64 bits are split into blocks; two fingerprints that differ in at most k bits agree on all but k blocks, so
with m blocks they agree on some choice of m - k. Each choice is a key; fingerprints meet on keys and are
verified by Hamming distance. Equal fingerprints are one node before the join. Inside a key, a group is
compared in numpy tiles and reports a spanning forest, never its pairs, so a group of g close fingerprints
gives g - 1 edges; large groups are first divided again by choices among their remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, component_labels, cut, groups_of, mix, signed, text_hash, text_of

ONE = np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[k : k + 8192], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the runs of ``width`` words, joined by a space; of the whole sequence if it is shorter."""
    ws = text.lower().split()  # bytes.lower: A-Z alone
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    n = len(ws)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1)
    starts = [0, *ends[: n - width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, n - width + 1)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, th (a hash of the text) and the fingerprint as a long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([majority(shingle_hashes(t, width)) for t in b.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(signed(fp))], ["doc_id", "th", "fp"])

    return cut(by_batch(text_of(docs, text_hash().alias("th")), run, "doc_id long, th long, fp long"))


def block_masks(k: int, blocks: int, within: list[int] | None = None) -> list[np.uint64]:
    """A mask for each choice of blocks - k of the blocks that the bits are dealt into."""
    bits = list(range(64)) if within is None else within
    parts = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [np.uint64(sum(1 << b for p in choice for b in p)) for choice in combinations(parts, blocks - k)]


def keyed(nodes: DataFrame, masks: list[np.uint64]) -> DataFrame:
    """A row (key, fp) for each fingerprint and mask."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column("fp").to_numpy().view(np.uint64)
        keys = [mix((fp & m) ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) for i, m in enumerate(masks)]
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(signed(np.tile(fp, len(masks))))], ["key", "fp"])

    return nodes.mapInArrow(lambda it: (run(b) for b in it if b.num_rows), "key long, fp long")


def forest(fps: np.ndarray, k: int, tile: int = 1024) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the graph in which fingerprints within k bits are linked."""
    n = len(fps)
    if n == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= k else []
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    edges = []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((x, y))

    def compare(at: np.ndarray) -> None:
        for i in range(0, len(at), tile):
            for j in range(i, len(at), tile):
                x, y = at[i : i + tile], at[j : j + tile]
                a, b = np.nonzero(np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= k)
                a, b = x[a], y[b]
                new = a < b if i == j else np.ones(len(a), bool)
                a, b = a[new], b[new]
                roots = np.array([find(int(v)) for v in np.r_[x, y]]) if len(a) > 4 * tile else None
                if roots is not None:  # many links: only those between trees matter
                    look = dict(zip(np.r_[x, y].tolist(), roots.tolist(), strict=True))
                    far = np.fromiter((look[v] for v in a.tolist()), np.int64, len(a)) != np.fromiter((look[v] for v in b.tolist()), np.int64, len(b))
                    a, b = a[far], b[far]
                link(a, b)

    if n <= 4 * tile:
        compare(np.arange(n))
        return edges
    free = [b for b in range(64) if len(np.unique((fps >> np.uint64(b)) & ONE)) > 1]
    if len(free) <= k:
        return [(0, i) for i in range(1, n)]
    for m in block_masks(k, k + 2 if len(free) >= 2 * (k + 2) else k + 1, free):
        part = fps & m
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                compare(order[a:b])
    return edges


def runs_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """Places of the runs of two or more equal keys."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    long = np.diff(edge) > 1
    return list(zip(edge[:-1][long].tolist(), edge[1:][long].tolist(), strict=True))


def close_edges(nodes: DataFrame, k: int, blocks: int) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints of ``nodes`` (column fp) that are within k bits."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "key"):
            keys, fps = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            a, b = [], []
            for i, j in runs_of(keys):
                for x, y in forest(fps[i:j], k):
                    a.append(i + x)
                    b.append(i + y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(signed(fps[a])), pa.array(signed(fps[b]))], ["a", "b"])

    rows = keyed(nodes, block_masks(k, blocks)).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(verify, "a long, b long")


def blocks_for(nodes: int, k: int) -> int:
    """More blocks for more fingerprints: keys then have more bits and fewer fingerprints each, for more keys."""
    return k + 2 + (nodes > 1 << 27) + (nodes > 1 << 33)


def labelled(marked: DataFrame, k: int = 4, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(fp, first) and (fp, tree): the distinct fingerprints with their smallest doc_id, and the component of each."""
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    blocks = blocks or blocks_for(nodes.count(), k)
    roots = component_labels(close_edges(nodes.select("fp"), k, blocks))
    return nodes, nodes.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("tree"))


def near_duplicates(docs: DataFrame, width: int = 4, k: int = 4, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Defined cases: texts that are null or without words have fingerprint zero and are linked like any
    other; equal texts, and repeated rows, have equal fingerprints and so one component; a null doc_id is larger than any other, so a
    component's id is null only if it has no other; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    marked = fingerprints(docs, width)
    nodes, of = labelled(marked, k, blocks)
    # the smallest doc_id of each component
    tied = nodes.join(of, "fp")
    small = tied.groupBy("tree").agg(F.min("first").alias("component_id"))
    of = tied.select("fp", "tree").join(small, "tree").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that a document of smaller doc_id stands for; of the rows of that doc_id one stays, the one of smallest text hash.

    A null doc_id is larger than any other: such documents stay only where their group has no other, and then one of them.
    """
    marked = fingerprints(docs)
    nodes, of = labelled(marked)
    first = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "th")
    stays = marked.join(of, "fp").groupBy("tree").agg(F.min(first).alias("keep")).select(F.col("keep.doc_id").alias("__doc"), F.col("keep.th").alias("__th"))
    own = docs.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (text_hash() == F.col("__th")), "left_semi")
    return own.dropDuplicates(["doc_id", "text"]).select(docs.columns)
