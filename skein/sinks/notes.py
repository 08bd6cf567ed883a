"""Drafts of all notes: path, content, create_only, kind. A note is one row; what it lists is capped or ranked before it is gathered, or is the note's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.render import PREFIX, TYPES, cleaned, front_matter, mapped, node_note, number, reference, review_entry, typed_links
from ..operators.build import PRIORITIES, in_order, ranked, review_order, section_order
from . import paths

# How many items of a category and priority are shown, and the categories' order with their headings.
CAPS = {"high": 5, "medium": 3}
CATEGORIES = {"communication_style": "Communication Style", "writing_resume_pitch": "Writing, Resume, and Pitch", "visual_design": "Visual Design", "technical_workflow": "Technical Workflow", "product_strategy": "Product Strategy", "lookup_behavior": "Lookup Behavior", "other": "Other"}
# Sections of the context pack: type, title, file.
SECTIONS = [
    ("identity", "Identity", "00 Identity.md"), ("agent_instruction", "Agent Instructions", "01 Agent Instructions.md"), ("pattern", "Patterns", "02 Patterns.md"), ("principle", "Principles", "03 Principles.md"),
    ("preference", "Preferences", "04 Preferences.md"), ("project", "Active Projects", "05 Active Projects.md"), ("decision", "Decisions", "06 Decisions.md"), ("task", "Tasks", "07 Tasks.md"),
    ("topic", "Recent Topics", "08 Recent Topics.md"), ("entity", "Entities", "09 Entities.md"), ("artifact", "Artifacts", "10 Artifacts.md"), ("sources", "Source Conversations", "11 Sources.md"),
]
# Headings of the identity card.
CARD = ["Identity", "Active Focus (Top 3)", "Working Style & Preferences", "Building Style", "Product Taste", "Recurring Projects", "Constraints & Boundaries", "Key People", "Communication Preferences", "Tools & Stack", "How agents should help me"]
# The order of types in the context.
CONTEXT_TYPES = ["agent_instruction", "pattern", "principle", "preference", "project", "decision", "task", "topic", "entity", "artifact"]


def draft(path: Column, content: Column, kind: str, create_only: bool = False) -> list[Column]:
    return [path.alias("path"), content.alias("content"), F.lit(create_only).alias("create_only"), F.lit(kind).alias("kind")]


def key_of(kind: str) -> str:
    """The front-matter key of a type: its plural in small letters."""
    return TYPES[kind][1].lower().replace(" ", "_")


def identity_note(spark, root: str, prefix: str = PREFIX) -> DataFrame:
    """The card that is made once and never written over: create_only, and protected by its front matter."""
    head = front_matter([("type", F.lit("identity"), "text"), ("id", F.lit("identity_me"), "text"), ("managed", F.lit(True), "number"), ("protected", F.lit(True), "number"), ("aliases", F.array(*map(F.lit, ["About Me", "Identity", "Me"])), "list")], prefix)
    body = "\n# Me\n\n> Yours to edit: made at the first import and left alone while it is protected.\n" + "".join(f"\n## {h}\n- \n" for h in CARD)
    return spark.range(1).select(*draft(paths.identity_path(root), F.concat(head, F.lit(body)), "identity", True))


def source_notes(sources: DataFrame, links: DataFrame, items: DataFrame, turns: DataFrame, root: str, prefix: str = PREFIX) -> DataFrame:
    """A note a source: its links by type, what only it holds (eight a type), a quote for each link, and its transcript.

    sources: source, title, summary, confidence, last_seen, class; links: source, type, node, rank, label, confidence, summary, aliases, evidence;
    items: source, type, ord, label, summary, confidence, quote; turns: source, turn_ord, role, author, at, text. Links are capped a source and type.
    """
    c = F.col
    l = links.withColumn("path", paths.node_path(c("type"), c("label"), root)).withColumn("quote", F.filter("evidence", lambda e: e["source"] == c("source"))[0]["quote"])
    l = l.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("type", "rank", "path", "label", "node", "confidence", "quote", "summary"))).alias("links"))
    # what is filed under a linked node, by its label or another name, is no news
    names = links.select("source", "type", F.explode(F.transform(F.concat(F.array("label"), "aliases"), T.slug)).alias("slug")).distinct()
    own = items.withColumn("slug", T.slug(F.regexp_replace("label", r"(?i)\s+\(chunk\s+\d+\)$", ""))).join(names, ["source", "type", "slug"], "left_anti")
    own = ranked(own, ["source", "type"], [F.desc("confidence"), c("ord")], 8)
    said = F.concat(F.lit("- "), cleaned(c("label")), F.lit(" ("), number(T.round_half_up(c("confidence"))), F.lit("): "), cleaned(c("summary")), F.coalesce(F.when(c("quote") != "", F.concat(F.lit(' Evidence: "'), T.truncated(cleaned(c("quote")), 180), F.lit('"'))), F.lit("")))
    own = own.withColumn("line", said).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("type", "rank", "line"))).alias("own"))
    author = F.coalesce(F.concat(F.lit("/"), F.nullif(cleaned(c("author")), F.lit(""))), F.lit(""))
    turn = F.concat(F.lit("### "), "role", author, F.coalesce(F.concat(F.lit(" "), "at"), F.lit("")), F.lit("\n"), cleaned(c("text")))
    t = turns.withColumn("line", turn).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_ord", "line"))), lambda x: x["line"]), "\n\n").alias("transcript"))
    s = sources.join(l, "source", "left").join(own, "source", "left").join(t, "source", "left")
    s = s.withColumn("links", F.coalesce("links", F.array().cast(l.schema["links"].dataType))).withColumn("own", F.coalesce("own", F.array().cast(own.schema["own"].dataType)))

    def of(kind: str, column: str = "links") -> Column:
        return F.filter(column, lambda x: x["type"] == kind)

    typed = [f for k in TYPES for f in ((key_of(k), F.transform(of(k), lambda x: x["node"]), "list"), (f"{key_of(k)}_paths", F.transform(of(k), lambda x: x["path"]), "list"))]
    head = front_matter([("type", F.lit("source_conversation"), "text"), ("id", F.concat(F.lit("source_"), T.hash_id(c("source"))), "text"), ("source_id", c("source"), "text"), ("source_class", c("class"), "text"), ("managed", F.lit(True), "number"), ("confidence", T.round_half_up(c("confidence")), "number"), ("last_seen", c("last_seen"), "text"), ("evidence_count", F.size("links"), "number"), *typed], prefix)

    def shown(column: str, line, otherwise: str) -> Column:
        parts = [F.when(F.size(of(k, column)) > 0, F.concat(F.lit(f"### {many}\n"), F.array_join(F.transform(of(k, column), line), "\n"))) for k, (_, many) in TYPES.items()]
        out = F.concat_ws("\n\n", *parts)
        return F.when(out == "", otherwise).otherwise(out)

    quoted = shown("links", lambda x: F.concat(F.lit("- "), reference(x["path"], x["label"]), F.lit(" ("), number(T.round_half_up(x["confidence"])), F.lit("): "), F.coalesce(T.truncated(cleaned(x["quote"]), 220), cleaned(x["summary"]))), "No high-confidence evidence extracted.")
    body = F.concat(
        head, F.lit("\n# "), "title", F.lit("\n\n## Summary\n"), cleaned(F.coalesce(F.nullif("summary", F.lit("")), F.lit("No summary extracted."))), F.lit("\n\n## Context Links\n"), typed_links(c("links")),
        F.lit("\n\n## Source-Only Context\n"), shown("own", lambda x: x["line"], "No source-only context retained."), F.lit("\n\n## Extracted Evidence\n"), quoted, F.lit("\n\n## Transcript\n"), F.coalesce("transcript", F.lit("")),
    )
    return s.select(*draft(paths.source_path(c("title"), c("source"), root), body, "source"))


def node_notes(nodes: DataFrame, root: str, prefix: str = PREFIX) -> DataFrame:
    """A note a node. nodes: the columns of ``node_note``."""
    return nodes.select(*draft(paths.node_path(F.col("type"), F.col("label"), root), node_note(prefix=prefix), "node"))


def inbox_lines(items: DataFrame) -> DataFrame:
    """category, shown (entries in order), hidden counts and six examples: at most eight entries and six labels of a category are gathered."""
    i = items.withColumn("priority", F.coalesce("priority", F.lit("medium"))).withColumn("category", F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("other"))
    cap = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])[F.col("priority")]
    i = i.withColumn("place", F.row_number().over(Window.partitionBy("category", "priority").orderBy(*review_order(), "id"))).withColumn("entry", review_entry())
    i = i.withColumn("hidden", F.col("place") > F.coalesce(cap, F.lit(0)))
    shown = in_order(ranked(i.where("NOT hidden").drop("place"), ["category"], [*review_order(), F.col("id")], sum(CAPS.values())), ["category"], "entry", "shown")
    rest = i.where("hidden")
    n = [F.count_if(F.col("priority") == p).alias(f"n_{p}") for p in PRIORITIES]
    counts = rest.groupBy("category").agg(F.count("*").alias("n"), *n, F.sum(F.coalesce("variant_count", F.lit(1))).alias("n_variants"))
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    few = in_order(ranked(rest.drop("place"), ["category"], [order, *review_order(), F.col("id")], 6), ["category"], "label", "examples")
    return i.select("category").distinct().join(shown, "category", "left").join(counts, "category", "left").join(few, "category", "left")


def review_inbox(items: DataFrame, root: str, prefix: str = PREFIX) -> DataFrame:
    """The inbox: by category five high and three medium groups, the rest summed up."""
    c = F.col
    lines = inbox_lines(items)
    hidden = F.concat_ws("", F.lit("- **Hidden groups**: "), c("n").cast("string"), F.lit(" ("), c("n_high").cast("string"), F.lit(" high, "), c("n_medium").cast("string"), F.lit(" medium, "), c("n_low").cast("string"), F.lit(" low).\n- **Hidden variants**: "), c("n_variants").cast("string"), F.lit(".\n- **Examples**: "), F.array_join(F.transform("examples", cleaned), "; "), F.lit("."))
    part = F.concat_ws("\n\n", F.concat(F.lit("## "), mapped(c("category"), CATEGORIES)), F.array_join("shown", "\n\n"), F.when(c("n") > 0, F.concat(F.lit("### Overflow Summary\n\n"), hidden)))
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), c("category"))
    # at most a row a category
    whole = lines.select(place.alias("place"), part.alias("part"), F.coalesce(F.size("shown"), F.lit(0)).alias("s"), F.coalesce("n", F.lit(0)).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n\n").alias("body"), F.coalesce(F.sum(F.greatest("s", F.lit(0))), F.lit(0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    low = items.agg(F.count_if(c("priority") == "low").alias("low"))
    both = whole.join(low)  # one row each
    head = front_matter([("type", F.lit("review_queue"), "text"), ("id", F.lit("review_queue"), "text"), ("managed", F.lit(True), "number"), ("review_format", F.lit("inbox_v2"), "text"), ("review_item_count", c("s") + c("n"), "number"), ("review_group_count", c("s"), "number"), ("review_summarized_group_count", c("n"), "number"), ("review_low_priority_count", c("low"), "number")], prefix)
    body = F.concat(head, F.lit("\n# Review Queue\n\nTraits that are not sure yet: set the status of a group to `approved` or `rejected`, or leave it `pending`.\n\n"), F.when(c("body") == "", "No review items.").otherwise(c("body")))
    return both.select(*draft(paths.review_path(root), body, "review_queue"))


def context_pack(nodes: DataFrame, sources: DataFrame, root: str, prefix: str = PREFIX, wiki: bool = False) -> DataFrame:
    """The pack of sections: a README, a note a type with its nodes by rank, one of all sources by date. A section is one note, so it meets in one row.

    nodes: type, label, summary, agent_instruction, applies_to, stability, inference_level, n_evidence, last_seen, confidence, related (type, path, label);
    sources: source, title, summary, last_seen.
    """
    c = F.col
    spark = nodes.sparkSession

    def head(title: Column) -> Column:
        return F.concat(front_matter([("type", F.lit("agent_context_section"), "text"), ("id", F.concat(F.lit("agent_context_"), F.replace(F.lower(title), F.lit(" "), F.lit("_"))), "text"), ("managed", F.lit(True), "number")], prefix), F.lit("\n# "), title, F.lit("\n\n"))

    day = F.coalesce(F.concat(F.lit(" _("), F.substring(F.nullif("last_seen", F.lit("")), 1, 10), F.lit(")_")), F.lit(""))
    related = typed_links(c("related"), wiki)
    text = F.concat_ws("\n\n", F.concat_ws("\n", F.concat(F.lit("### "), reference(paths.node_path(c("type"), c("label"), root), c("label"), wiki), day), F.nullif(cleaned(c("summary")), F.lit(""))), F.concat(F.lit("**Agent instruction:** "), F.nullif(cleaned(c("agent_instruction")), F.lit(""))), F.when(F.size("applies_to") > 0, F.concat(F.lit("**Applies to:** "), F.array_join("applies_to", ", "))), F.when(~related.startswith("No high-confidence"), F.concat(F.lit("**Related:**\n"), related)))
    order = F.row_number().over(Window.partitionBy("type").orderBy(*section_order(), F.col("label")))
    by_type = in_order(nodes.withColumn("rank", order).withColumn("entry", text), ["type"], "entry", "entries").select("type", F.array_join("entries", "\n\n").alias("body"))
    line = F.concat(F.lit("- "), reference(paths.source_path(c("title"), c("source"), root), c("title"), wiki), day, F.lit(": "), "summary")
    latest = sources.withColumn("line", line).withColumn("after", F.when(F.coalesce("last_seen", F.lit("")) == "", 1).otherwise(0))
    # dates before none, the latest first: sorted inside the one row that holds the section
    said = F.reverse(F.array_sort(F.collect_list(F.struct((-c("after")).alias("k"), F.coalesce("last_seen", F.lit("")).alias("at"), "source", "line"))))
    listed = latest.agg(said.alias("x")).select(F.lit("sources").alias("type"), F.when(F.size("x") == 0, "None yet.").otherwise(F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("body"))
    card = spark.range(1).select(F.lit("identity").alias("type"), F.concat(F.lit("## Identity Card\n"), reference(paths.identity_path(root), F.lit("_Me"), wiki), F.lit(" — your protected identity card.")).alias("body"))
    sections = spark.createDataFrame(SECTIONS, "type string, title string, file string")
    filled = F.broadcast(sections).join(by_type.union(listed).union(card), "type", "left")
    body = F.concat(head(c("title")), F.when(c("type") == "sources", "## Conversations\n").otherwise(""), F.coalesce("body", F.lit("None extracted yet.")), F.lit("\n"))
    notes = filled.select(*draft(paths.joined(root, "Agent Context", c("file")), body, "agent_context"))
    index = "\n".join(["", "# Agent Context", "", "Read `00 Identity.md` first, then only the sections that the task needs.", "", "## Sections"])
    entries = [F.concat(F.lit("- "), reference(paths.joined(root, "Agent Context", f), F.lit(t), wiki)) for _, t, f in SECTIONS]
    start = front_matter([("type", F.lit("agent_context_index"), "text"), ("id", F.lit("agent_context_index"), "text"), ("managed", F.lit(True), "number")], prefix)
    readme = spark.range(1).select(*draft(paths.context_path(root, True), F.concat_ws("\n", F.concat(start, F.lit(index)), *entries), "agent_context"))
    return notes.unionByName(readme)


def agent_context(nodes: DataFrame, sources: DataFrame, edges: DataFrame, root: str, profile: str = "", prefix: str = PREFIX, wiki: bool = False) -> DataFrame:
    """The context as one note: the profile (given, or the summaries of the six surest sources), the twenty surest nodes of a type, all sources.

    nodes: type, label, summary, confidence, evidence (source, quote, confidence); sources: source, title, summary, confidence, last_seen, input_ord; edges: counted.
    Nodes are ranked before they are gathered; the list of sources is the note's own.
    """
    c = F.col
    n = F.size("evidence")
    name = reference(paths.node_path(c("type"), c("label"), root), c("label"), wiki)
    quote = F.coalesce(F.concat(F.lit(' Evidence: "'), T.truncated(cleaned(F.get("evidence", F.lit(0))["quote"]), 160), F.lit('"')), F.lit(""))
    line = F.concat(F.lit("- "), name, F.lit(" ("), number(T.round_half_up(c("confidence"))), F.lit(", "), n.cast("string"), F.when(n == 1, " evidence item): ").otherwise(" evidence items): "), cleaned(c("summary")), quote)
    top = in_order(ranked(nodes.withColumn("line", line), ["type"], [F.desc("confidence"), n.desc(), c("label")], 20), ["type"], "line", "lines")
    order = F.array(*map(F.lit, CONTEXT_TYPES))
    kinds = nodes.sparkSession.createDataFrame([(t,) for t in CONTEXT_TYPES], "type string")
    parts = F.broadcast(kinds).join(top, "type", "left").select(F.array_position(order, c("type")).alias("k"), F.concat(F.lit("## "), mapped(c("type"), {t: TYPES[t][1] for t in TYPES}), F.lit("\n"), F.coalesce(F.array_join("lines", "\n"), F.lit("None extracted yet."))).alias("part"))
    body = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n\n").alias("body"))
    told = sources.withColumn("s", T.trim_all(F.coalesce("summary", F.lit("")))).where("s <> ''").groupBy("s").agg(F.max(F.struct("confidence", (-c("input_ord")).alias("o"))).alias("m"))
    six = told.orderBy(F.desc("m.confidence"), F.desc("m.o")).limit(6)
    about = six.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("m.confidence")).alias("a"), (-c("m.o")).alias("o"), "s"))), lambda x: F.concat(F.lit("- "), x["s"])), "\n").alias("about"))
    listed = F.concat(F.lit("- "), reference(paths.source_path(c("title"), c("source"), root), c("title"), wiki), F.lit(": "), "summary")
    of = sources.withColumn("line", listed).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("input_ord", "line"))), lambda x: x["line"]), "\n").alias("listed"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("sure"), F.max("last_seen").alias("latest"))
    one = body.join(about).join(of).join(edges.agg(F.count("*").alias("n_edges")))  # one row each
    head = front_matter([("type", F.lit("agent_context"), "text"), ("id", F.lit("agent_context"), "text"), ("managed", F.lit(True), "number"), ("confidence", T.round_half_up(c("sure")), "number"), ("last_seen", c("latest"), "text"), ("evidence_count", c("n_edges"), "number")], prefix)
    said = F.lit(profile.strip()) if profile.strip() else F.when(c("about") == "", "No high-confidence context extracted yet.").otherwise(c("about"))
    text = F.concat(head, F.lit("\n# Agent Context\n\n## Identity Card\n"), reference(paths.identity_path(root), F.lit("_Me"), wiki), F.lit(" — your own protected note; read it before what is inferred.\n\n## Profile Summary\n"), said, F.lit("\n\n"), "body", F.lit("\n\n## Source Conversations\n"), "listed")
    return one.select(*draft(paths.context_path(root), text, "agent_context"))


def all_drafts(*drafts: DataFrame) -> DataFrame:
    """All drafts of a run, each path once: the first that was given stands."""
    every = [d.withColumn("place", F.lit(k)) for k, d in enumerate(drafts)]
    return ranked(reduce(DataFrame.unionByName, every), ["path"], [F.col("place"), F.col("content")], 1).select("path", "content", "create_only", "kind")

