"""Mixing sources to target weights, by hash-threshold histograms. DataFrame functions only.

Every document has a 60-bit hash. Per source, tokens are summed by hash bucket, the bucket in which the
budget runs out is found by a running sum over buckets, and only that bucket's documents are summed again
by a finer bucket, until the threshold is exact. Taking a document is then a comparison of its hash with
its source's threshold: nothing is sorted, and the shuffles carry histograms, not documents.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows with the
same doc_id share a hash, so they stand on the same side of a threshold; an empty table gives no rows;
columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, beside, cut

BITS, LEVELS = 15, 4


def hash60(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash of every document."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(hash60(F.col("doc_id")), F.lit(0)).alias("h"))


def targets(sized: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source, source_size and target of each source.

    Sources in order of code points, null last, weigh 1, 2, 3 and so on again, and share all tokens by
    weight; a target above ``max_repeats`` times its source stops there and the others share the rest.
    That fixed point is a water level: sources by rising cap/weight, the first whose cap is not below
    (tokens left) / (weight left) sets it. One row a source: small windows.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(max_repeats))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(whole)["level"])
    return per.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, max_repeats: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (size times the copies taken) of every document."""
    sized = cut(sizes(docs))
    plan = targets(sized, max_repeats)
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    # what is left once every document is taken `copies` times; low: the hashes below it are taken once more
    plan = plan.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("low", F.lit(0).cast("long"))
    plan = cut(plan)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        here = sized.join(beside(plan.select(F.col("source").alias("s"), "low")), F.col("source").eqNullSafe(F.col("s")))
        if level:  # only the boundary bucket
            here = here.where(F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS))
        hist = here.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
        hist = hist.join(plan.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        edge = hist.where("upto > left").groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("edge"))
        edge = edge.select(F.col("source").alias("s"), F.shiftleft("edge.bucket", shift).alias("to"), F.col("edge.before").alias("used"))
        plan = plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        # no edge: this level's documents all fit (at the first level; later the boundary bucket always has one)
        past = F.lit(1 << (BITS * LEVELS)).cast("long")
        plan = plan.select("source", "source_size", "target", "copies", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), F.coalesce("to", past).alias("low"))
        plan = cut(plan)
    # the one document beyond the threshold that fills what is left best, where it brings the sum nearer
    beyond = sized.join(beside(plan.select(F.col("source").alias("s"), "low", "left")), F.col("source").eqNullSafe(F.col("s"))).where("h >= low")
    last = beyond.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "h", "size")).alias("last"), F.first("left").alias("gap")).where("last.off < gap")
    plan = plan.join(last.select(F.col("source").alias("s"), F.col("last.h").alias("extra")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = cut(plan.withColumnRenamed("source", "s"))
    out = sized.join(beside(plan), F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("copies") + F.when((F.col("h") < F.col("low")) | (F.coalesce(F.col("h") == F.col("extra"), F.lit(False))), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.least(copies, F.lit(max_repeats))).cast("long").alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
p0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM p0),
p2 AS (SELECT *, cap / w AS ratio,
         (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level
       FROM p1 WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT level FROM p2 WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
p3 AS (SELECT source, source_size, least(cap, lv.level * w) AS target FROM p2, lv),
p4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM p3),
p5 AS (SELECT *, target - copies * source_size AS budget FROM p4),
j AS (SELECT d.*, source_size, target, copies, budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN p5 ON d.source IS NOT DISTINCT FROM p5.source),
e AS (SELECT source, min(h) AS low FROM j WHERE upto > budget GROUP BY source),
t AS (SELECT j.*, h < coalesce(low, 1152921504606846976) AS below FROM j LEFT JOIN e ON j.source IS NOT DISTINCT FROM e.source),
g AS (SELECT source, any_value(budget) - coalesce(sum(size) FILTER (below), 0) AS gap FROM t GROUP BY source),
x AS (SELECT t.source, arg_min(h, {'o': abs(size - gap), 'h': h, 's': size}) AS extra, min(abs(size - gap)) AS off, any_value(gap) AS gap
      FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source WHERE NOT below GROUP BY t.source)
SELECT doc_id, size, source_size, target, (size * least(3, copies + (CASE WHEN below OR (x.off < x.gap AND h = x.extra) THEN 1 ELSE 0 END)))::BIGINT AS taken, t.source
FROM t LEFT JOIN x ON t.source IS NOT DISTINCT FROM x.source
"""


def mixed_documents(docs: DataFrame, max_repeats: int = 3) -> DataFrame:
    """The documents with their columns, each as often as the mix takes it.

    Documents of size 0 weigh nothing and stay once. A doc_id with different rows takes each row as often as its own size says.
    """
    took = mix_sources(docs, max_repeats).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int").alias("__times")).distinct()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    both = docs.withColumn("__own", size).join(took, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__size")))
    return both.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)
