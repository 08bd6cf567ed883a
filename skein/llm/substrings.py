"""Substring dedup by level-wise doubling.

A window of ``width`` words can only repeat if the half-length windows in it do. Level one therefore looks at
half-length windows, and of those only at each full window's minimiser (the one of smallest hash among those
it contains), which is the same wherever the window stands: about a quarter of the positions. Only windows whose
minimiser is found in two documents are extended to the full length and compared. ``longer_repeats`` goes on
doubling from there until no candidates survive; what is removed does not depend on it, since a longer repeat
is covered by the full-length windows in it.

Shuffles carry hashes, a row for a document's minimiser, never windows' texts; texts are shuffled once, by
document, and that exchange serves both levels. Groups are read as sorted streams, so that a passage found in
a third of all documents needs no more memory than one found twice.

Defined cases: null texts have no words, and their empty text's digest; a null doc_id is neither smaller nor larger than
another, so such a document keeps its words and takes none; a repeated row is not a document of
smaller doc_id, so repeated rows keep their words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, cut, rolling, signed, text_of, word_hashes


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` words, the smallest hash of the windows of half its length in it."""
    half = (width + 1) // 2
    small = rolling(hashes, half)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = small[:n].copy()
    for j in range(1, width - half + 1):
        np.minimum(out, small[j : j + n], out=out)
    return out


def shared(rows: DataFrame) -> DataFrame:
    """The rows (m, doc_id) whose m more than one row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None  # the last row, if nothing before it has its key
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            m, d = b.column("m").to_numpy(), b.column("doc_id").to_numpy()
            before = np.r_[last is not None and m[0] == last, m[1:] == m[:-1]]
            after = np.r_[m[1:] == m[:-1], False]
            keep = before | after
            if pending is not None and before[0]:
                m_out, d_out = np.r_[pending[0], m[keep]], np.r_[pending[1], d[keep]]
            else:
                m_out, d_out = m[keep], d[keep]
            pending = None if keep[-1] else (m[-1], d[-1])
            last = m[-1]
            if len(m_out):
                yield pa.RecordBatch.from_arrays([pa.array(m_out, pa.int64()), pa.array(d_out, pa.int64())], ["m", "doc_id"])

    return rows.repartition("m").sortWithinPartitions("m", "doc_id").mapInArrow(run, "m long, doc_id long")


def blobs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Distinct keys (sorted input) and the bytes of the values of each."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    raw = np.ascontiguousarray(values, "<u8").tobytes()
    return keys[edge[:-1]], [raw[8 * a : 8 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def unpacked(lists: list) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, "<u8") for x in lists]) if lists else np.zeros(0, np.uint64)


def later_copies(rows: DataFrame) -> DataFrame:
    """From (m, doc_id, windows): the windows of each document that a document of smaller doc_id has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen_h, seen_d = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            m, w = b.column("m").to_numpy(), b.column("windows").to_pylist()
            sizes = np.fromiter((len(x) // 8 for x in w), np.int64, len(w))
            h = np.frombuffer(b"".join(w), "<u8")
            d, of = np.repeat(b.column("doc_id").to_numpy(), sizes), np.repeat(m, sizes)
            if last is None or m[0] != last:
                seen_h, seen_d = seen_h[:0], seen_d[:0]
            all_h, all_d = np.r_[seen_h, h], np.r_[seen_d, d]
            order = np.lexsort((all_d, all_h))
            first = np.r_[True, all_h[order][1:] != all_h[order][:-1]]
            least = all_d[order][first][np.cumsum(first) - 1]
            later = np.zeros(len(all_h), bool)
            later[order] = all_d[order] > least
            later = later[len(seen_h) :]
            if later.any():
                keep = np.flatnonzero(later)
                keep = keep[np.argsort(d[keep], kind="stable")]
                docs, out = blobs(d[keep], h[keep])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "windows"])
            ends = of == m[-1] if m[-1] != last else np.ones(len(h), bool)
            more_h, more_d = np.r_[seen_h if m[-1] == last and m[0] == last else seen_h[:0], h[ends & (of == m[-1])]], np.r_[seen_d if m[-1] == last and m[0] == last else seen_d[:0], d[ends & (of == m[-1])]]
            order = np.lexsort((more_d, more_h))
            first = np.r_[True, more_h[order][1:] != more_h[order][:-1]] if len(order) else np.zeros(0, bool)
            seen_h, seen_d, last = more_h[order][first], more_d[order][first], m[-1]

    return rows.repartition("m").sortWithinPartitions("m", "doc_id").mapInArrow(run, "doc_id long, windows binary")


def removed_windows(texts: DataFrame, width: int) -> DataFrame:
    """doc_id and the hashes (8 bytes each) of its windows that a document of smaller doc_id has too."""

    def level_one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(minimisers(word_hashes(t), width)) for t in b.column("text").to_pylist()]
        docs = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), [len(x) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), pa.array(docs, pa.int64())], ["m", "doc_id"])

    def level_two(b: pa.RecordBatch) -> pa.RecordBatch:
        ms, ds, ws = [], [], []
        for doc_id, text, wanted in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("ms").to_pylist(), strict=True):
            if wanted is None:
                continue
            h = word_hashes(text)
            m = minimisers(h, width)
            at = np.flatnonzero(np.isin(m, np.array(wanted, np.int64).view(np.uint64)))
            at = at[np.argsort(m[at], kind="stable")]
            keys, out = blobs(m[at], rolling(h, width)[at])
            ms.append(keys)
            ds += [doc_id] * len(keys)
            ws += out
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(ms)) if ms else [], pa.int64()), pa.array(ds, pa.int64()), pa.array(ws, pa.binary())], ["m", "doc_id", "windows"])

    candidates = shared(by_batch(texts.where("doc_id is not null"), level_one, "m long, doc_id long")).groupBy("doc_id").agg(F.collect_set("m").alias("ms"))
    full = by_batch(texts.join(candidates.withColumnRenamed("doc_id", "c"), F.col("doc_id") == F.col("c"), "left").select("doc_id", "text", "ms"), level_two, "m long, doc_id long, windows binary")
    return later_copies(full)


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space) of every document."""
    texts = text_of(docs)
    gone = removed_windows(texts, width).groupBy("doc_id").agg(F.collect_list("windows").alias("gone"))

    def strip(b: pa.RecordBatch) -> pa.RecordBatch:
        ns, rs, kept = [], [], []
        for text, lists in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
            ws = text.split()
            ns.append(len(ws))
            if lists is None:
                rs.append(0)
                kept.append(b" ".join(ws))
                continue
            at = np.flatnonzero(np.isin(rolling(word_hashes(text), width), unpacked(lists)))
            change = np.zeros(len(ws) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + width, -1)
            stays = np.cumsum(change[:-1]) == 0
            rs.append(int(len(ws) - stays.sum()))
            kept.append(b" ".join([w for w, s in zip(ws, stays.tolist(), strict=True) if s]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns, pa.int64()), pa.array(rs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    both = texts.join(gone.withColumnRenamed("doc_id", "c"), F.col("doc_id") == F.col("c"), "left").select("doc_id", "text", "gone")
    return by_batch(both, strip, "doc_id long, n_words long, n_removed long, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def longer_repeats(docs: DataFrame, width: int = 13, rounds: int = 20) -> DataFrame:
    """doc_id, start, words: windows that two documents share, at the greatest of the lengths width, 2 width, 4 width ... at which they do.

    A window of twice the length is only looked at where both its halves repeat, and a level's windows are
    counted from their hashes; the doubling ends when no candidates survive.
    """
    texts = text_of(docs)
    length, found, alive = width, None, None
    for _ in range(rounds):

        def windows(b: pa.RecordBatch, n: int = length, held: bool = alive is not None) -> pa.RecordBatch:
            hs, ds, ps = [], [], []
            places = b.column("places").to_pylist() if held else [None] * b.num_rows
            for doc_id, text, at in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), places, strict=True):
                h = rolling(word_hashes(text), n)
                pos = np.arange(len(h))
                if held:
                    ok = np.zeros(len(h) + n, bool)
                    ok[np.array(at, np.int64)] = True
                    pos = pos[ok[pos] & ok[pos + n // 2]]
                hs.append(h[pos])
                ps.append(pos)
                ds.append(np.full(len(pos), doc_id))
            return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hs))), pa.array(np.concatenate(ds), pa.int64()), pa.array(np.concatenate(ps), pa.int64())], ["h", "doc_id", "start"])

        source = texts if alive is None else texts.join(alive.groupBy("doc_id").agg(F.collect_set("start").alias("places")), "doc_id")
        rows = by_batch(source, windows, "h long, doc_id long, start long")
        twice = rows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
        here = cut(rows.join(twice, "h", "left_semi").select("doc_id", "start", F.lit(length).cast("long").alias("words")))
        if here.isEmpty():
            break
        found = here if found is None else found.union(here)
        alive, length = here, 2 * length
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, words long")
    return found.groupBy("doc_id", "start").agg(F.max("words").alias("words"))


#: SQL for the query: every window as its words.
OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT row, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(ws) - 12)) AS i FROM t)),
 least_ AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s),
 gone AS (SELECT DISTINCT row, i + k AS p FROM (SELECT row, i, unnest(generate_series(0, 12)) AS k FROM win JOIN least_ USING (s) WHERE first_doc < doc_id)),
 word AS (SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM t),
 kept AS (SELECT row, string_agg(w, ' ' ORDER BY word.p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (row, p) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (row)
"""
