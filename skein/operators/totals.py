"""Totals of an import and of a graph, transcripts, and the rows that lie between sources and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .state import usage_cost
from .windows import top_per_group

# Fixed values of the cost model: tokens around each prompt and each synthesis, and ratios of output to input.
BASE_TOKENS, SELF_MODEL_TOKENS, SYNTHESIS_TOKENS = 1800, 1000, 1800
SYNTHESIS_IN, SYNTHESIS_OUT, STRUCTURED_OUT, EMBEDDED = 0.12, 0.08, 0.35, 0.35
# Types that name things.
NOUNS = ["topic", "entity", "artifact"]


def shown_turn(role: Column, text: Column, author: Column | None = None, at: Column | None = None) -> Column:
    """A turn as transcripts show it: role, author and time above the text."""
    name = F.lit("") if author is None else F.coalesce(F.concat(F.lit("/"), F.nullif(author, F.lit(""))), F.lit(""))
    time = F.lit("") if at is None else F.coalesce(F.concat(F.lit(" "), F.nullif(at, F.lit(""))), F.lit(""))
    return F.concat(F.lit("### "), role, name, time, F.lit("\n"), text)


def transcripts(turns: DataFrame) -> DataFrame:
    """source_id, transcript: turns in order with a blank line between them. turns: source_id, turn_ord, shown."""
    g = turns.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("turn_ord", "shown"))).alias("t"))
    return g.select("source_id", F.array_join(F.transform("t", lambda x: x["shown"]), "\n\n").alias("transcript"))


def prompt(title: Column, source: Column, created: Column, updated: Column, transcript: Column, most: int) -> Column:
    """What an extractor is given: a header, and the transcript cut at ``most`` characters."""
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Source ID: "), source), F.concat(F.lit("Created: "), F.nullif(created, F.lit(""))), F.concat(F.lit("Updated: "), F.nullif(updated, F.lit(""))))
    return F.concat(head, F.lit("\n\nTranscript:\n"), T.truncated(transcript, most))


def import_preview(turns: DataFrame, price_in: float = 2.5, price_out: float = 15.0, price_embedding: float = 0.13, passes: int = 2) -> DataFrame:
    """One row: conversations, turns, chars of all transcripts with blank lines between them, tokens, cost_usd. turns: source_id, shown."""
    c = turns.groupBy("source_id").agg(F.count("*").alias("n"), (F.sum(F.length("shown")) + 2 * (F.count("*") - 1)).alias("chars"))
    t = c.agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), (F.sum("chars") + 2 * (F.count("*") - 1)).alias("chars")).withColumn("tokens", F.ceil(F.col("chars") / 4).cast("long"))
    k = F.col("tokens").cast("double")
    around = BASE_TOKENS + (SELF_MODEL_TOKENS if passes == 2 else 0)
    i = k * passes + F.col("conversations") * around + SYNTHESIS_TOKENS + F.ceil(k * SYNTHESIS_IN)
    o, e = F.ceil(k * STRUCTURED_OUT * passes) + F.ceil(k * SYNTHESIS_OUT), F.ceil(k * EMBEDDED)
    return t.withColumn("cost_usd", F.floor(((i * price_in + o * price_out + e * price_embedding) / 1_000_000) * 10000 + 0.5) / 10000)


def usage_totals(events: DataFrame, fallback: float = 2.5) -> DataFrame:
    """By phase and in all (phase null): calls, hits, misses, tokens_in, tokens_out, tokens_embedded, tokens, usd.

    events: phase, model, cached, tokens_in, tokens_out, tokens_embedded, total, usd. A missing or zero total is the sum of the three; a missing
    cost follows from the model's prices.
    """
    n = {c: F.coalesce(c, F.lit(0)) for c in ("tokens_in", "tokens_out", "tokens_embedded")}
    total = F.coalesce(F.nullif("total", F.lit(0)), n["tokens_in"] + n["tokens_out"] + n["tokens_embedded"])
    embedded = F.coalesce(F.nullif("tokens_embedded", F.lit(0)), F.nullif("total", F.lit(0)), F.lit(0))
    usd = F.coalesce("usd", usage_cost(F.col("phase"), F.col("model"), F.col("tokens_in"), F.col("tokens_out"), embedded, fallback))
    e = events.select("phase", F.col("cached").alias("cached"), *[x.alias(c) for c, x in n.items()], total.alias("tokens"), usd.alias("usd"))
    return e.rollup("phase").agg(F.count_if(~F.col("cached")).alias("calls"), F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"), *[F.sum(c).alias(c) for c in (*n, "tokens", "usd")])


def cache_totals(probes: DataFrame, by: str) -> DataFrame:
    """Hits and misses of each cache. probes: the cache's name, value (null: a miss)."""
    return probes.groupBy(by).agg(F.count_if(F.col("value").isNotNull()).alias("hits"), F.count_if(F.col("value").isNull()).alias("misses"))


def graph_totals(nodes: DataFrame, linked: DataFrame, self_model: list[str], seeds: DataFrame | None = None) -> DataFrame:
    """One row: visible, isolated, self_model, inferred, nouns, seeded, unmatched_seeds, ratio of nouns to traits (the nouns where there are none).

    nodes: node, type, inference_level; linked: node, those with any link; seeds: node, those of earlier runs.
    """
    t = nodes.join(linked.select(F.col("node").alias("l")).distinct(), F.col("node") == F.col("l"), "left")
    seen = F.lit(False)
    if seeds is not None:
        t = t.join(seeds.select(F.col("node").alias("s")).distinct(), F.col("node") == F.col("s"), "left")
        seen = F.col("s").isNotNull()
    out = t.agg(F.count("*").alias("visible"), F.count_if(F.col("l").isNull()).alias("isolated"), F.count_if(F.col("type").isin(self_model)).alias("self_model"), F.count_if(F.col("inference_level") == "supported_inference").alias("inferred"), F.count_if(F.col("type").isin(NOUNS)).alias("nouns"), F.count_if(seen).alias("seeded"))
    n = F.lit(0) if seeds is None else F.col("n_seeds")
    if seeds is not None:
        out = out.join(seeds.select("node").distinct().agg(F.count("*").alias("n_seeds")))  # one row each
    out = out.withColumn("unmatched_seeds", F.greatest(F.lit(0), n - F.col("seeded")).cast("long"))
    ratio = F.when(F.col("self_model") == 0, F.col("nouns").cast("double")).otherwise(T.round_half_up(F.col("nouns") / F.greatest("self_model", F.lit(1))))
    return out.withColumn("ratio", ratio).drop("n_seeds")


def evidence_edges(links: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """id, source, node, confidence, evidence: an edge a link, with the node's first quotes from that source. links: source, node; nodes: node, confidence, evidence (source, quote, confidence)."""
    j = links.select("source", "node").distinct().join(nodes.select("node", "confidence", "evidence"), "node")
    own = F.slice(F.filter("evidence", lambda e: e["source"] == F.col("source")), 1, most)
    return j.select(F.concat(F.lit("source_"), T.hash_id(F.col("source")), F.lit("->"), F.col("node")).alias("id"), "source", "node", "confidence", own.alias("evidence"))


def source_only(items: DataFrame, names: DataFrame, most: int = 8) -> DataFrame:
    """The surest items of a source and type that no linked node is called. items: source, type, label, confidence, ord; names: source, type, slug."""
    own = items.withColumn("slug", T.slug(F.regexp_replace("label", r"(?i)\s+\(chunk\s+\d+\)$", ""))).join(names.select("source", "type", "slug").distinct(), ["source", "type", "slug"], "left_anti")
    return top_per_group(own, ["source", "type"], [F.desc("confidence"), F.col("ord")], most).drop("slug")
