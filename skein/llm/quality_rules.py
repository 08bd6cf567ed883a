"""Quality rules with thresholds that adapt to each language and source.

Signals of each text are taken in one pass. Their distribution in each (lang, source) is kept as a mergeable
quantile sketch: counts of logarithmic bins, each within 2 % of its values, so that sketches of parts add up
to the sketch of the whole, whatever the order. Upper fences come from the sketch's upper quantiles and join back
on (lang, source). A document is kept if the fixed base rules and all fences let it pass.

Defined cases: a null text has no words and fails the base rules; null lang or source are groups of their own;
repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, by_batch, cut, text_hash, text_of

GAMMA = 1.04
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"
#: The least width of a fence above its quantile: a signal that is nearly constant has no spread of its own.
SLACK = 0.01
SIGNALS = ["symbol_ratio", "shout_ratio", "dup_line_ratio", "repeat_ratio", "bang_ratio"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeats(ws: list[bytes]) -> int:
    """Words in windows of three words that are found twice or more."""
    n = len(ws)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, n)
    if len(number) == n:
        return 0
    base = len(number)
    keys = ids[:-2] * base + ids[1:-1]
    if base > 2_000_000:  # three numbers would not fit 63 bits
        keys = np.unique(keys, return_inverse=True)[1]
    keys = keys * base + ids[2:]
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    at = order[np.r_[same, False] | np.r_[False, same]]
    for d in range(3):
        hit[at + d] = True
    return int(hit.sum())


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), lang, source, the five counts and the ratios that get fences."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column("text").to_pylist():
            ws = t.split()
            black = t.translate(None, WHITE)
            chars = len(black) - len(black.translate(None, LEADING))
            symbols = len(black) - len(black.translate(None, SYMBOLS))
            lines = [x for x in t.split(b"\n") if x.split()]
            dups = len(lines) - len(set(lines))
            bangs = black.count(b"!")
            upper = len(black) - len(black.translate(None, UPPER))
            rows.append((len(ws), chars, symbols, dups, repeats(ws), bangs, upper, len(lines)))
        x = np.array(rows, np.int64)
        n, chars = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1)
        ratios = [x[:, 2] / n, x[:, 6] / chars, x[:, 3] / np.maximum(x[:, 7], 1), x[:, 4] / n, x[:, 5] / n]
        cols = [b.column(c) for c in ("doc_id", "th", "lang", "source")]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(x[:, i]) for i in range(5)), *map(pa.array, ratios)], ["doc_id", "th", "lang", "source", *COUNTS, *SIGNALS])

    schema = "doc_id long, th long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in SIGNALS)
    return by_batch(text_of(docs, text_hash().alias("th"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")), run, schema)


#: The bytes that begin a code point, and upper-case ASCII letters.
LEADING = bytes(x for x in range(256) if x & 0xC0 != 0x80)
UPPER = bytes(range(65, 91))


def sketches(marked: DataFrame) -> DataFrame:
    """lang, source, signal, bin, n: the mergeable sketch. bin: null for zero, else the logarithmic bin."""
    long = marked.select("lang", "source", F.explode(F.create_map(*[x for s in SIGNALS for x in (F.lit(s), F.col(s))])).alias("signal", "value"))
    bin_ = F.when(F.col("value") > 0, F.ceil(F.log(F.col("value")) / F.lit(float(np.log(GAMMA)))))
    return long.select("lang", "source", "signal", bin_.cast("int").alias("bin")).groupBy("lang", "source", "signal", "bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, spread: float = 3.0) -> DataFrame:
    """lang, source and one fence a signal: the 0.95 quantile + spread x interquartile range, SLACK at least."""
    whole = Window.partitionBy("lang", "source", "signal")
    run = whole.orderBy(F.col("bin").asc_nulls_first())
    at = sketch.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole))
    value = F.coalesce(F.lit(2.0) * F.pow(F.lit(GAMMA), F.col("bin")) / F.lit(GAMMA + 1.0), F.lit(0.0))
    q = at.groupBy("lang", "source", "signal").agg(*[F.min(F.when(F.col("upto") >= p * F.col("all"), value)).alias(f"q{int(100 * p)}") for p in (0.25, 0.75, 0.95)])
    q = q.withColumn("fence", F.col("q95") + F.greatest(spread * (F.col("q75") - F.col("q25")), F.lit(SLACK)))
    return q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("signal") == s, F.col("fence"))).alias(f"{s}_fence") for s in SIGNALS])


def judge(docs: DataFrame, *more: str, spread: float = 3.0) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, each signal with its fence, and the named columns of ``signals``."""
    marked = cut(signals(docs))
    limits = cut(fences(sketches(marked), spread).withColumnsRenamed({"lang": "l", "source": "s"}))
    both = marked.join(beside(limits), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = base == F.lit(False)
    for s in SIGNALS:
        within &= F.col(s) <= F.col(f"{s}_fence")
    return both.select("doc_id", *COUNTS, base.alias("base_failed"), within.alias("kept"), "lang", "source", *[c for s in SIGNALS for c in (s, f"{s}_fence")], *more)


#: SQL for the query: the same bins, quantiles and fences.
OP2_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 l AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
 win AS (SELECT row, i, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(ws) - 2)) AS i FROM t)),
 rep AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, i + unnest([0, 1, 2]) AS p FROM win JOIN (SELECT row, s FROM win GROUP BY row, s HAVING count(*) > 1) USING (row, s)) GROUP BY row),
 c AS (SELECT row, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '!')) AS bangs, len(regexp_extract_all(text, '[A-Z]')) AS upper_, len(ls) AS n_lines FROM t JOIN l USING (row) LEFT JOIN rep USING (row)),
 r AS (SELECT row, lang, source, unnest([n_symbols / greatest(n_words, 1), upper_ / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), bangs / greatest(n_words, 1)]) AS v, unnest([1, 2, 3, 4, 5]) AS signal FROM c),
 b AS (SELECT *, CASE WHEN v > 0 THEN ceil(ln(v) / ln(1.04::DOUBLE)) END AS bin FROM r),
 h AS (SELECT lang, source, signal, bin, count(*) AS n FROM b GROUP BY ALL),
 u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, signal ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY lang, source, signal) AS whole, coalesce(2 * pow(1.04::DOUBLE, bin) / 2.04, 0) AS q FROM h),
 q AS (SELECT lang, source, signal, min(q) FILTER (upto >= 0.25 * whole) AS q25, min(q) FILTER (upto >= 0.75 * whole) AS q75, min(q) FILTER (upto >= 0.95 * whole) AS q95 FROM u GROUP BY ALL),
 f AS (SELECT row, bool_and(v <= q95 + greatest(3 * (q75 - q25), 0.01)) AS within FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source AND r.signal = q.signal GROUP BY row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND within AS kept FROM c JOIN f USING (row)
"""


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns. Repeated rows share their verdict; of a doc_id with different texts, and of
    documents without one, each text has its own."""
    good = judge(docs, "th").where("kept").select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).distinct()
    return docs.join(good, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (text_hash() == F.col("__th")), "left_semi")
