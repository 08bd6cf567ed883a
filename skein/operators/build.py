"""Steps of the graph build: from extracted items to nodes, review items, links and their order. Every group is ranked before it is collected, so rows stay bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import beside, cut, dealt
from .windows import top_per_group

# Types that describe a person and their review threshold; source classes that are not filed by themselves.
SELF_MODEL = T.SELF_MODEL
REVIEW_LEAST = 0.65
LOOK_UPS = ["transactional_lookup", "shopping_product_lookup", "academic_problem"]
STATUSES, PRIORITIES = ["pending", "rejected", "approved"], ["high", "medium", "low"]
# Weights of types in the synthesis payload.
TYPE_WEIGHTS = {"agent_instruction": 50, "pattern": 40, "principle": 40, "preference": 40, "decision": 30, "project": 20, "task": 20}


def ranked(df: DataFrame, keys: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)


def in_order(rows: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """keys and an array of ``value`` in the order of ``rank``."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))), lambda x: x["v"]).alias(alias))


def first_conversations(conversations: DataFrame, most: int) -> DataFrame:
    """The first ``most`` by input_ord; all for 0."""
    return conversations.where(F.col("input_ord") < most) if most > 0 else conversations


def eligible(items: DataFrame, least: float = 0.78) -> DataFrame:
    """Items with evidence and enough confidence for the type they are filed under. items: type, label, confidence, n_evidence."""
    filed = T.graph_type(F.col("type"), F.col("label"))
    return items.where((F.col("n_evidence") > 0) & (F.col("confidence") >= F.when(filed.isin(SELF_MODEL), REVIEW_LEAST).otherwise(least)))


def sanitised(items: DataFrame) -> DataFrame:
    """Items as an extractor may return them, made sound: texts trimmed, confidence in [0, 1] (0 if it is no number), unknown stability and
    inference null, applies_to at most six; items without label, summary or quote go."""
    sure = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))))
    out = items.withColumns({c: T.trim_all(F.coalesce(c, F.lit(""))) for c in ("label", "summary", "quote")}).withColumn("confidence", sure)
    out = out.withColumn("stability", F.when(F.col("stability").isin(T.STABILITY), F.col("stability"))).withColumn("inference_level", F.when(F.col("inference_level").isin(T.INFERENCE), F.col("inference_level")))
    return out.withColumn("applies_to", F.slice(F.filter(F.transform("applies_to", T.trim_all), lambda x: x != ""), 1, 6)).where("label <> '' AND summary <> '' AND quote <> ''")


def without_keys(items: DataFrame, keys: Column, barred: DataFrame, item_id: str) -> DataFrame:
    """The items none of whose keys is barred. barred: key."""
    hit = items.select(item_id, F.explode(keys).alias("key")).join(barred.select("key"), "key", "left_semi").select(item_id).distinct()
    return items.join(hit, item_id, "left_anti")


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """One extraction a source: summaries that say something joined in order, mean confidence. chunks: source, chunk, summary, confidence.

    The summary of a source is one text, however many chunks its conversation had, so they meet in its row."""
    told = F.array_sort(F.collect_list(F.when(F.col("summary") != "", F.struct("chunk", "summary"))))
    g = chunks.groupBy("source").agg(told.alias("s"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_chunks"))
    return g.select("source", F.array_join(F.transform("s", lambda x: x["summary"]), " ").alias("summary"), "confidence", "n_chunks")


def merged_passes(base: DataFrame, second: DataFrame) -> DataFrame:
    """Both passes over a source: the second's summary is added unless the first holds it, the higher confidence stays. Both: source, summary, confidence."""
    b = second.select("source", F.col("summary").alias("s2"), F.col("confidence").alias("c2"))
    return base.join(b, "source", "left").select("source", T.joined_text(F.col("summary"), F.col("s2"), 1000).alias("summary"), F.greatest("confidence", F.coalesce("c2", F.lit(0.0))).alias("confidence"))


def merged_pass_items(base: DataFrame, second: DataFrame) -> DataFrame:
    """The items of both passes, as ``merged_extracted`` merges them: the first pass's styles become patterns, after those of both; styles of the
    second stay styles, and other types than a person's traits are the first's alone. Both: columns of ``merged_extracted``."""
    style = F.col("type") == "style_pattern"
    one = base.withColumn("pass", F.when(style, 2).otherwise(0)).withColumn("type", F.when(style, "pattern").otherwise(F.col("type")))
    two = second.where(F.col("type").isin(*SELF_MODEL, "style_pattern")).withColumn("pass", F.lit(1))
    return merged_extracted(one.unionByName(two).withColumn("ord", F.struct("pass", "ord")))


def strongest_of(order: list[str], c: str) -> Column:
    """Of a group the value that comes first in ``order``; null if it has none of them."""
    place = F.min(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0)))
    return F.try_element_at(F.array(*map(F.lit, order)), place.cast("int")).alias(c)


def merged_extracted(items: DataFrame) -> DataFrame:
    """Items of a source and type with the same label (any case) as one: the first's label, the best confidence, five distinct quotes, summaries joined up
    to 800 characters, the strongest stability and inference, eight distinct scopes, the first instruction.

    items: source, type, ord, label, summary, confidence, evidence (quote, confidence), stability, inference_level, applies_to, agent_instruction.
    Quotes, summaries and scopes are ranked before they are gathered, so a row holds no more than it keeps.
    """
    keys = ["source", "type", "key"]
    i = items.withColumn("key", F.lower("label"))
    g = i.groupBy(*keys).agg(F.min_by("label", "ord").alias("label"), F.max("confidence").alias("confidence"), strongest_of(T.STABILITY, "stability"), strongest_of(T.INFERENCE, "inference_level"), F.min_by("agent_instruction", F.when(F.col("agent_instruction") != "", F.col("ord"))).alias("agent_instruction"), F.min("ord").alias("first"))

    def gathered(rows: DataFrame, by: list[Column], most: int, value: str, alias: str) -> DataFrame:
        return in_order(ranked(rows, keys, by, most), keys, value, alias)

    e = i.select(*keys, "ord", F.posexplode("evidence").alias("pos", "e")).groupBy(*keys, F.col("e.quote").alias("quote")).agg(F.min(F.struct("ord", "pos", "e")).alias("m")).select(*keys, "m.*")
    e = gathered(e, [F.col("ord"), F.col("pos")], 5, "e", "evidence")
    # every summary counts, one that is repeated too; 800 characters are reached by 800 of them
    t = gathered(i.withColumn("summary", F.coalesce("summary", F.lit(""))), [F.col("ord")], 800, "summary", "s").select(*keys, F.substring(F.array_join("s", " "), 1, 800).alias("summary"))
    a = i.select(*keys, "ord", F.posexplode("applies_to").alias("pos", "x")).groupBy(*keys, F.lower("x").alias("low")).agg(F.min(F.struct("ord", "pos", "x")).alias("m")).select(*keys, "m.*")
    a = gathered(a, [F.col("ord"), F.col("pos")], 8, "x", "applies_to")
    out = g.join(e, keys, "left").join(t, keys).join(a, keys, "left")
    return out.select("source", "type", F.col("first").alias("ord"), "label", "summary", "confidence", F.coalesce("evidence", F.expr("CAST(array() AS array<struct<quote:string,confidence:double>>)")).alias("evidence"), "stability", "inference_level", F.coalesce("applies_to", F.array().cast("array<string>")).alias("applies_to"), "agent_instruction")


def names_and_summaries(rows: DataFrame, heads: DataFrame, most_aliases: int = 12) -> DataFrame:
    """node, aliases and summary of ``accumulated``, for every node with rows."""
    names = rows.select("node", "ord", F.posexplode("names").alias("pos", "name")).withColumn("name", F.trim("name")).groupBy("node", "name").agg(F.min(F.struct("ord", "pos")).alias("o"))
    names = names.join(heads.select("node", T.slug(F.col("label")).alias("slug")), "node").where((F.col("name") != "") & (T.slug(F.col("name")) != F.col("slug")))
    names = in_order(ranked(names, ["node"], [F.col("o")], most_aliases), ["node"], "name", "aliases")
    told = rows.groupBy("node", "summary").agg(F.min("ord").alias("o")).withColumn("o", F.when(F.col("summary") != "", F.col("o")))
    told = in_order(ranked(told, ["node"], [F.col("o").asc_nulls_last(), F.col("summary")], 1000), ["node"], "summary", "s")
    told = told.select("node", F.aggregate(F.filter("s", lambda x: x.isNotNull() & (x != "")), F.lit(""), lambda a, x: T.merged_summary(a, x)).alias("summary"))
    return told.join(names, "node", "left").select("node", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "summary")


def accumulated(rows: DataFrame, heads: DataFrame, most_evidence: int = 30, most_aliases: int = 12, by_node: bool = False) -> DataFrame:
    """Nodes from all that was filed under them, in the order of ``ord`` (below zero: what the node was before).

    rows: node, ord, sources, names, summary, confidence, evidence (source, quote, confidence), stability, inference_level, applies_to,
    agent_instruction, last_seen; heads: node, label. The highest confidence, distinct sources, names with another slug than the label's,
    evidence by confidence (a quote of a source as it came first, no surer than its item), the strongest stability and inference, eight scopes,
    the first instruction, last_seen of the last row that has one, and summaries folded in order up to 900 characters (of the first thousand
    different ones: more cannot meet in a row). by_node: quotes and sources seldom repeat, so they travel once, to their node, repeats included.
    """
    known = names_and_summaries(rows, heads, most_aliases)
    g = rows.groupBy("node").agg(F.max("confidence").alias("confidence"), strongest_of(T.STABILITY, "stability"), strongest_of(T.INFERENCE, "inference_level"), F.max_by("last_seen", F.when(F.col("last_seen").isNotNull(), F.col("ord"))).alias("last_seen"), F.min_by("agent_instruction", F.when(F.col("agent_instruction") != "", F.col("ord"))).alias("agent_instruction"))
    to_node = (lambda x: x.repartition("node")) if by_node else (lambda x: x)
    s = to_node(rows.select("node", F.explode("sources").alias("s"))).groupBy("node").agg(F.count_distinct("s").alias("n_sources"))
    e = F.col("e")
    quotes = rows.select("node", "ord", "confidence", F.posexplode("evidence").alias("pos", "e")).withColumn("e", F.struct(e["source"].alias("source"), e["quote"].alias("quote"), F.least(e["confidence"], F.col("confidence")).alias("confidence")))
    quotes = to_node(quotes).groupBy("node", e["source"].alias("source"), e["quote"].alias("quote")).agg(F.min(F.struct("ord", "pos", e["confidence"].alias("confidence"))).alias("m")).select("node", "m.ord", "m.pos", F.struct("source", "quote", "m.confidence").alias("e"))
    quotes = in_order(ranked(quotes, ["node"], [F.desc("e.confidence"), F.col("ord"), F.col("pos")], most_evidence), ["node"], "e", "evidence")
    scope = rows.select("node", "ord", F.posexplode("applies_to").alias("pos", "x")).where("x <> ''").groupBy("node", "x").agg(F.min(F.struct("ord", "pos")).alias("o"))
    scope = in_order(ranked(scope, ["node"], [F.col("o")], 8), ["node"], "x", "applies_to")
    out = g
    for more in (s, known, quotes, scope):
        out = out.join(more, "node", "left")
    none = F.array().cast("array<string>")
    return out.select("node", "confidence", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("evidence", F.expr("CAST(array() AS array<struct<source:string,quote:string,confidence:double>>)")).alias("evidence"), F.coalesce("summary", F.lit("")).alias("summary"), "stability", "inference_level", F.coalesce("applies_to", none).alias("applies_to"), "agent_instruction", "last_seen")


def review_items(clusters: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """An inbox item a cluster: its best member (confidence, evidence, the quieter label, the earlier) under the family's label, the other labels, the surest
    quotes (each once a source, no surer than its item), counts, priority and category.

    clusters: cluster, ord, type, source, title, label, summary, confidence, evidence (source, quote, confidence), stability, inference_level, applies_to,
    agent_instruction, last_seen; sources: cluster, source, each once, if they are known.
    """
    noise, n = T.label_noise(F.col("label")), F.size("evidence")
    g = cut(clusters.groupBy("cluster").agg(F.count("*").alias("variant_count"), F.max("confidence").alias("__top")))
    # only the surest members are put in order
    surest = clusters.join(beside(g.select("cluster", "__top")), "cluster").where(F.col("confidence").eqNullSafe(F.col("__top")))
    best = ranked(surest, ["cluster"], [n.desc(), noise, F.col("ord")], 1)
    best = best.select("cluster", "type", T.family_label(F.col("type"), F.col("label"), F.col("summary")).alias("best"), "summary", "confidence", "stability", "inference_level", "applies_to", "agent_instruction", "last_seen", F.col("label").alias("own")).withColumn("slug", T.slug(F.col("best")))
    best = cut(best)
    sources = clusters.select("cluster", "source").distinct() if sources is None else sources
    g = g.join(sources.groupBy("cluster").agg(F.count("source").alias("n_sources")), "cluster").select("cluster", "n_sources", "variant_count")
    names = clusters.groupBy("cluster", "label").agg(F.min("ord").alias("o")).join(best.select("cluster", "slug"), "cluster").where(T.slug(F.col("label")) != F.col("slug"))
    # an item shows eight of them; a merge of items reads a hundred
    variants = in_order(ranked(names, ["cluster"], [F.col("o"), F.col("label")], 100), ["cluster"], "label", "variants")
    e = F.col("e")
    quotes = clusters.select("cluster", "ord", "confidence", F.posexplode("evidence").alias("pos", "e")).withColumn("e", F.struct(e["source"].alias("source"), e["quote"].alias("quote"), F.least(e["confidence"], F.col("confidence")).alias("confidence")))
    quotes = quotes.groupBy("cluster", e["source"].alias("source"), e["quote"].alias("quote")).agg(F.min(F.struct("ord", "pos", "e")).alias("m")).select("cluster", "m.*")
    counts = quotes.groupBy("cluster").agg(F.count("*").alias("grouped_evidence"))
    quotes = in_order(ranked(quotes, ["cluster"], [F.desc("e.confidence"), F.col("ord"), F.col("pos")], 12), ["cluster"], "e", "evidence")
    # the category reads the item's own texts and its sources' titles: a title that names a category is enough, so one of each will do
    titles = clusters.select("cluster", "title").distinct().groupBy("cluster").agg(*[F.max(F.coalesce(T.has_word(F.col("title"), w), F.lit(False))).alias(f"t_{k}") for k, (_, w) in enumerate(T.CATEGORY_RULES)])
    out = g.join(best, "cluster").join(titles, "cluster").join(variants, "cluster", "left").join(quotes, "cluster", "left").join(counts, "cluster", "left")
    text = F.concat_ws(" ", "best", "summary", "agent_instruction", F.array_join("applies_to", " "))
    category = None
    for k, (name, words) in enumerate(T.CATEGORY_RULES):
        hit = T.has_word(text, words) | F.col(f"t_{k}")
        category = F.when(hit, name) if category is None else category.when(hit, name)
    none = F.array().cast("array<string>")
    priority = review_priority(F.lit("pending"), F.col("inference_level"), F.col("stability"), F.col("confidence"), F.col("n_sources"))
    return out.select("cluster", F.concat(F.lit("review_"), "type", F.lit("_"), "slug").alias("id"), "type", F.col("best").alias("label"), F.coalesce("variants", none).alias("variants"), F.slice(F.coalesce("variants", none), 1, 8).alias("aliases"), "summary", "confidence", "evidence", "n_sources", "variant_count", F.coalesce("grouped_evidence", F.lit(0)).alias("grouped_evidence"), "stability", "inference_level", "applies_to", "agent_instruction", "last_seen", F.lit("pending").alias("status"), priority.alias("priority"), category.otherwise("other").alias("category"))


def review_priority(status: Column, inference: Column, stability: Column, confidence: Column, sources: Column) -> Column:
    """low for what was rejected; high for two sources, or an explicit and lasting trait at 0.9; low for what passes or is below 0.8; else medium."""
    stated = (inference == "explicit") & stability.isin("stable", "recurring") & (confidence >= 0.9)
    return F.when(status == "rejected", "low").when((sources >= 2) | F.coalesce(stated, F.lit(False)), "high").when(F.coalesce(stability.isin("situational", "temporary"), F.lit(False)) | (confidence < 0.8), "low").otherwise("medium")


def promoted_after_review(status: Column, category: Column, kind: Column, priority: Column, confidence: Column, evidence: Column, sources: Column, stability: Column, inference: Column) -> Column:
    """Whether a compacted review item becomes a node: traits of a person only; what was approved, or else what is sure, lasting and repeated; never look-ups or what was rejected."""
    repeated = F.when(inference == "explicit", sources >= 2).when(inference == "supported_inference", sources >= 3).otherwise(False)
    sure = (priority == "high") & F.coalesce(stability.isin("stable", "recurring"), F.lit(False)) & (confidence >= 0.85) & (evidence >= 4) & repeated & ((kind != "agent_instruction") | (sources >= 2))
    return F.when(~kind.isin(SELF_MODEL) | (status == "rejected"), False).when(status == "approved", True).when(category == "lookup_behavior", False).otherwise(sure)


def appended_links(old: DataFrame, new: DataFrame, cap: int = 2, n_rows: int = 0) -> DataFrame:
    """Links of both, each once, the best ``cap`` a node and type. Both: node, other, other_type, confidence, n_evidence, label. n_rows: of how many links, about."""
    both = dealt(old.unionByName(new), n_rows, "node").dropDuplicates(["node", "other"])
    return top_per_group(both, ["node", "other_type"], [F.desc("confidence"), F.desc("n_evidence"), F.col("label"), F.col("other")], cap)


def without_isolated(nodes: DataFrame, source_links: DataFrame, node_links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with a link, and the links between them. nodes: node; source_links: source, node; node_links: node, other."""
    ends = source_links.select("node").union(node_links.select("node")).union(node_links.select(F.col("other").alias("node"))).distinct()
    kept = nodes.join(ends, "node", "left_semi")
    ids = beside(kept.select("node"))
    return kept, source_links.join(ids, "node", "left_semi"), node_links.join(ids, "node", "left_semi").join(ids.withColumnRenamed("node", "other"), "other", "left_semi")


def late_links(links: DataFrame, waiting: DataFrame, cap: int = 3) -> DataFrame:
    """Links of sources that are not filed by themselves, as long as a source has fewer than ``cap`` in all. links: source, node; waiting: source, node, ord."""
    links = links.join(beside(waiting.select("source").distinct()), "source", "left_semi")
    had = links.groupBy("source").agg(F.count("*").alias("had"))
    new = waiting.groupBy("source", "node").agg(F.min("ord").alias("ord")).join(links.select("source", "node"), ["source", "node"], "left_anti")
    new = new.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("ord", "node"))).join(had, "source", "left")
    return new.where(F.col("rank") + F.coalesce("had", F.lit(0)) <= cap).select("source", "node")


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """value, n: how often each value of the list stands in the column, 0 included."""
    kinds = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    n = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    return F.broadcast(kinds).join(n, F.col("value") == F.col("v"), "left").select("value", F.coalesce("c", F.lit(0)).alias("n"))


def review_stats(items: DataFrame, categories: list[str]) -> DataFrame:
    """category, n, high, medium, low, merged_variants, low_variants, rendered, summarised of every category, 0 included.

    Five high and three medium items of a category are rendered, low ones never. items: category, priority, variant_count; what has no category, or
    another one, is ``other``.
    """
    i = items.withColumn("category", F.when(F.col("category").isin(categories), F.col("category")).otherwise("other")).withColumn("v", F.coalesce("variant_count", F.lit(1)))
    p = F.col("priority")
    g = i.groupBy("category").agg(F.count("*").alias("n"), *[F.count_if(p == x).alias(x) for x in PRIORITIES], F.sum(F.greatest(F.col("v") - 1, F.lit(0))).alias("merged_variants"), F.sum(F.when(p == "low", F.col("v")).otherwise(0)).alias("low_variants"))
    kinds = items.sparkSession.createDataFrame([(c,) for c in categories], "kind string")
    out = F.broadcast(kinds).join(g, F.col("kind") == F.col("category"), "left").drop("category").withColumnRenamed("kind", "category").fillna(0)
    shown = F.least("high", F.lit(5)) + F.least("medium", F.lit(3))
    return out.select("category", "n", *PRIORITIES, "merged_variants", "low_variants", shown.alias("rendered"), (F.col("high") + F.col("medium") + F.col("low") - shown).alias("summarised"))


def place_in(value: Column, order: list[str], missing: int) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(missing))


def review_order() -> list[Column]:
    """Status, priority (medium if none), label by the rules of the alphabet."""
    return [place_in(F.col("status"), STATUSES, 9), place_in(F.col("priority"), PRIORITIES, 2), F.collate("label", "UNICODE")]


def seed_order() -> list[Column]:
    """Which of two seeds survives: evidence, sources, confidence, the quieter label."""
    return [F.desc("n_evidence"), F.desc("n_sources"), F.desc("confidence"), T.label_noise(F.col("label"))]


def section_order() -> list[Column]:
    """Rank (traits of a person first; stability, inference and evidence count for all types), the latest (none last), evidence, confidence."""
    stable = F.when(F.col("stability").isNull(), 1).otherwise(5 - place_in(F.col("stability"), T.STABILITY, 4))
    inferred = F.when(F.col("inference_level") == "explicit", 2).when(F.col("inference_level") != "", 1).otherwise(0)
    rank = F.when(F.col("type").isin(SELF_MODEL), 100).otherwise(0) + 10 * stable + inferred + F.col("n_evidence")
    return [rank.desc(), F.col("last_seen").desc_nulls_last(), F.desc("n_evidence"), F.desc("confidence")]


def synthesis_payload(nodes: DataFrame, most: int = 80) -> DataFrame:
    """The nodes that a synthesis is given: by type weight, evidence, confidence, the latest. A top-k over the whole table: no full sort."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])[F.col("type")], F.lit(0))
    return nodes.withColumn("weight", weight).orderBy(F.desc("weight"), F.desc("n_evidence"), F.desc("confidence"), F.col("last_seen").desc_nulls_last(), "node").limit(most)


def latest_sources(sources: DataFrame, most: int = 30) -> DataFrame:
    """The sources that a synthesis is given: the latest. sources: source, title, summary, last_seen."""
    return sources.orderBy(F.col("last_seen").desc_nulls_last(), "source").limit(most)


def over_cap(cost: Column, cap: Column) -> Column:
    """Whether a run must not start: strictly above the cap; 0 is no cap."""
    return (cap > 0) & (cost > cap)


def stale(checkpoint_at: Column, attempt_at: Column, attempt_status: Column) -> Column:
    """Whether a failed or running attempt is newer than the checkpoint."""
    return attempt_status.isin("failed", "running") & (attempt_at > checkpoint_at)
