"""From conversations to a small graph: capitalised phrases as items, promoted where two sources have them, linked, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.windows import capped_links


def extracted_items(turns: DataFrame) -> DataFrame:
    """source, label, slug, turn: the deterministic stand-in for a remote extractor; longer capitalised words of a turn."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]{5,})(?![A-Za-z0-9_])"), 1)
    return turns.select(F.concat(F.lit("conv-"), "conv_id").alias("source"), "turn", F.explode(F.array_distinct(words)).alias("label")).withColumn("slug", slug(F.col("label")))


def conversation_graph(spark: SparkSession, sf_dir: str, sources: int = 2, cap: int = 3) -> DataFrame:
    """source, node, evidence, confidence: the capped evidence edges of nodes found in at least ``sources`` conversations."""
    items = extracted_items(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    links = items.groupBy("source", "slug").agg(F.count("*").alias("evidence"))
    nodes = links.groupBy("slug").agg(F.count("*").alias("sources"), F.sum("evidence").alias("total")).where(F.col("sources") >= sources)
    ranked = nodes.withColumn("confidence", F.least(F.lit(0.99), F.lit(0.55) + F.col("sources") * 0.02))
    edges = capped_links(links.join(ranked.select("slug", "confidence"), "slug"), ["source"], [F.desc("confidence"), F.desc("evidence"), F.col("slug")], cap)
    return edges.select("source", F.concat(F.lit("topic_"), "slug").alias("node"), "evidence", F.round("confidence", 2).alias("confidence"), "rank")
