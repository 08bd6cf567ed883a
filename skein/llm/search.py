"""Ranked lexical search as a blocked sparse matrix product: items x terms times terms x documents.

Items come in blocks of a bounded number of (item, term) entries, the only thing that is sent to every task. A task turns
its texts into rows of the document matrix once (term numbers and counts of the block's vocabulary, kept in the shared
folder); N, L and df are sums over those rows. Then each task takes its documents block by block, turns them into int64
impacts by term, and merges for every item the rows of its terms into one accumulator (Gustavson's row merging), of which
the k best stay. What leaves a task is k rows an item at most; they are reduced by item and share of tasks, then by item.
The texts are never shuffled, and no pair of an item and a document is ever a row but those.

Defined cases: null and empty texts have no terms; items without a term give no rows; documents that share a doc_id (or
have none, last in ties) are each ranked; items that agree in id and text count once, others that share an id are each
ranked; an empty table gives no rows; columns other than doc_id, item_id and text are ignored; texts of any length go part
by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_bytes, text_of

#: Fixed value: ASCII letters (lower-cased) and digits and all bytes of other code points belong to terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
NULL_LAST = np.iinfo(np.int64).max
RESULT = "item int, item_id long, doc_id long, score long, part int"


def terms(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, some ``most`` bytes at a time."""
    plain, at = text.translate(TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + most)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """key, item_id, term, times: the entries of the item matrix, a row each. key tells items apart."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, i, text in zip(*(b.column(c).to_pylist() for c in ("key", "item_id", "text")), strict=True):
                times: dict[bytes, int] = {}
                for part in terms(text):
                    for t in part:
                        times[t] = times.get(t, 0) + 1
                n = len(times)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([i] * n, pa.int64()), pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64())], ["key", "item_id", "term", "times"])

    # two hashes: items are told apart by 128 bits
    return rows.select(F.concat_ws("-", F.xxhash64("item_id", "text"), F.md5("text")).alias("key"), "item_id", "text").mapInArrow(run, "key string, item_id long, term binary, times long")


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tfs (numbers and counts of the vocabulary's terms) of every document with a term."""
    width = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for k in range(0, b.num_rows, 256):
                n, found = [], []
                for d, t in enumerate(texts.slice(k, 256)):
                    length = 0
                    for part in terms(t.as_py()):
                        length += len(part)
                        v = np.fromiter(map(vocabulary.get, part, repeat(-1)), np.int64, len(part))
                        found.append(np.unique(v[v >= 0], return_counts=True) + (d,))
                    n.append(length)
                # parts of one text may repeat a term
                key = np.concatenate([v + d * width for v, _, d in found] or [np.zeros(0, np.int64)])
                times = np.concatenate([c for _, c, _ in found] or [np.zeros(0, np.int64)])
                key, back = np.unique(key, return_inverse=True)
                tf = np.zeros(len(key), np.int64)
                np.add.at(tf, back, times)
                ends = np.searchsorted(key, np.arange(len(n) + 1) * width).astype(np.int32)
                out = pa.RecordBatch.from_arrays(
                    [ids.slice(k, 256), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array((key % width).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf))],
                    ["doc_id", "n", "terms", "tfs"],
                )
                yield out.filter(pa.array(np.array(n) > 0))

    return text_of(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def best(score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by ascending doc."""
    if len(score) > k:
        near = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, doc = score[near], doc[near]
    order = np.lexsort((doc, -score))[:k]
    return score[order], doc[order]


def product(rows: DataFrame, matrix: list[tuple[int | None, np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int, block: int = 4096) -> DataFrame:
    """The k best documents of each item in each task. matrix: id, term numbers and times of each item; weight: by term number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(matrix)
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                ids = part.column("doc_id").fill_null(NULL_LAST).to_numpy(zero_copy_only=False)
                m = 25 + (75 * part.column("n").to_numpy() * n_docs) // n_terms
                each = np.diff(part.column("terms").offsets.to_numpy())
                term, tf, doc = part.column("terms").flatten().to_numpy(), part.column("tfs").flatten().to_numpy(), np.repeat(np.arange(len(ids)), each)
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                order = np.argsort(term, kind="stable")
                doc, impact = doc[order], impact[order]
                row = np.searchsorted(term[order], np.arange(len(weight) + 1))
                for i, (_, own, times) in enumerate(matrix):
                    total = np.zeros(len(ids), np.int64)
                    for t, q in zip(own, times, strict=True):
                        lo, hi = row[t], row[t + 1]
                        if lo < hi:
                            total[doc[lo:hi]] += q * impact[lo:hi]
                    least = top[i][0][-1] if len(top[i][0]) == k else 1
                    near = np.flatnonzero(total >= least)
                    if len(near):
                        top[i] = best(np.concatenate([top[i][0], total[near]]), np.concatenate([top[i][1], ids[near]]), k)
        for i, (score, doc) in enumerate(top):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(score), pa.int32()), pa.array([matrix[i][0]] * len(score), pa.int64()), pa.array(doc, mask=doc == NULL_LAST), pa.array(score), pa.array([0] * len(score), pa.int32())], ["item", "item_id", "doc_id", "score", "part"]
                )

    found = rows.mapInArrow(run, RESULT).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(1024)))
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, entries: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item. entries: of the item matrix in one block (some 100 bytes each)."""
    spark = docs.sparkSession
    wanted = cut(item_terms(items))
    blocks = -(-wanted.count() // entries)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        vocabulary: dict[bytes, int] = {}
        of: dict[str, tuple[int | None, list[int], list[int]]] = {}
        for r in wanted.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect():
            _, own, times = of.setdefault(r.key, (r.item_id, [], []))
            own.append(vocabulary.setdefault(bytes(r.term), len(vocabulary)))
            times.append(r.times)
        rows = cut(postings(docs, vocabulary))
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weight = np.zeros(len(vocabulary), np.int64)
        for t, df in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
            weight[t] = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))
        matrix = [(i, np.array(own), np.array(times)) for i, own, times in of.values()]
        out = out.union(product(rows, matrix, weight, n_docs, n_terms, k))
    return out


LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
TERMS_SQL = rf"regexp_extract_all(translate(text, {LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {TERMS_SQL} AS ts FROM documents WHERE text IS NOT NULL),
 l AS (SELECT row, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
 s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM l),
 i AS (SELECT row_number() OVER () AS item, item_id, {TERMS_SQL} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
 q AS (SELECT item, item_id, term, count(*)::BIGINT AS times FROM (SELECT item, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
 t AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
 m AS (SELECT row, doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM l, s),
 r AS (SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
