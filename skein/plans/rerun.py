"""A run that begins with what the last one has written: notes of nodes are seeds, the inbox holds what people have decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import PREFIX
from ..sources import notes as N

EVIDENCE = "array<struct<source:string,quote:string,confidence:double>>"


def quotes(column: str):
    return F.transform(column, lambda e: F.struct(e["source_id"].alias("source"), e["quote"].alias("quote"), e["confidence"].alias("confidence"))).cast(EVIDENCE)


def previous(notes: DataFrame, prefix: str = PREFIX) -> tuple[DataFrame, DataFrame]:
    """(seeds, reviews) for ``build_graph`` from a table of notes (path, content). Embeddings are not written in notes, so seeds have none."""
    none, many = F.lit(None).cast("string"), F.array().cast("array<string>")
    s = N.node_seeds(notes, prefix)
    seeds = s.select(F.concat(F.lit("note:"), "path").alias("seed"), "type", "label", "aliases", "summary", "confidence", quotes("evidence").alias("evidence"), F.col("source_ids").alias("sources"), "stability", "inference_level", "applies_to", "agent_instruction", "last_seen", F.lit(None).cast("array<double>").alias("v"))
    r = N.review_seeds(notes, prefix)
    n = F.size("source_ids").cast("long")
    reviews = r.select("id", "type", "label", "aliases", many.alias("variants"), "summary", "confidence", quotes("evidence").alias("evidence"), F.col("source_ids").alias("sources"), n.alias("n_sources"), F.lit(1).cast("long").alias("variant_count"), F.size("evidence").cast("long").alias("grouped_evidence"), none.alias("stability"), none.alias("inference_level"), many.alias("applies_to"), none.alias("agent_instruction"), none.alias("last_seen"), "status", F.coalesce("priority", F.lit("medium")).alias("priority"), F.coalesce("category", F.lit("other")).alias("category"))
    return seeds, reviews
