"""Markdown of notes as Column expressions: front matter, references, evidence, cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B, round_half_up, trim_all, truncated

# Node types in their order, with the label of one and of many.
TYPES = {
    "topic": ("Topic", "Topics"), "entity": ("Entity", "Entities"), "project": ("Project", "Projects"), "pattern": ("Pattern", "Patterns"),
    "principle": ("Principle", "Principles"), "agent_instruction": ("Agent Instruction", "Agent Instructions"), "preference": ("Preference", "Preferences"),
    "decision": ("Decision", "Decisions"), "task": ("Task", "Tasks"), "artifact": ("Artifact", "Artifacts"), "style_pattern": ("Style Pattern", "Style Patterns"),
}
#: Front-matter keys begin with this, unless a caller names the prefix that their notes already have.
PREFIX = "skein_"
#: A product list as it is left in a transcript, and the places where such a list keeps names.
WIDGET = r"(?is)\[\[.*?(?:turn\d+product|product_entity|turnProduct).*?\]\]"
WIDGET_NAMES = [rf'(?i)"{k}"\s*:\s*"([^"]+)"' for k in ("title", "name", "label")]


def mapped(value: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value]


def quoted(x: Column) -> Column:
    """As a JSON string."""
    j = F.to_json(F.array(x))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def number(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def front_matter(fields: list[tuple[str, Column, str]], prefix: str = PREFIX) -> Column:
    """YAML between dashes. fields: (key, value, kind), kind one of text, number, list; null and empty text leave their line out."""
    lines = [F.lit("---")]
    for key, x, kind in fields:
        head = F.lit(f"{prefix}{key}: ")
        if kind == "list":
            items = F.array_join(F.transform(x, lambda v: F.concat(F.lit("  - "), quoted(v))), "\n")
            lines.append(F.when(F.coalesce(F.array_size(x), F.lit(0)) == 0, F.concat(head, F.lit("[]"))).otherwise(F.concat(F.lit(f"{prefix}{key}:\n"), items)))
        elif kind == "number":
            lines.append(F.concat(head, number(x)))
        else:
            lines.append(F.when(x != "", F.concat(head, quoted(x))))
    return F.concat_ws("\n", *lines, F.lit("---"))


def widget_names(widget: Column) -> Column:
    names = F.concat(*[F.regexp_extract_all(widget, F.lit(p), F.lit(1)) for p in WIDGET_NAMES])
    plain = F.transform(names, lambda n: trim_all(F.regexp_replace(n, r"\\u[0-9A-Fa-f]{4}", "")))
    kept = F.slice(F.array_distinct(F.filter(plain, lambda n: (n != "") & ~n.rlike(r"(?i)^turn\d+product") & (n != "product_entity"))), 1, 8)
    return F.when(F.size(kept) > 0, F.array_join(kept, "; ")).otherwise(F.lit("[product list omitted]"))


def cleaned(x: Column) -> Column:
    """Text that can stand in a note: product lists by their names, no images, citation marks or accidental links."""
    widgets = F.regexp_extract_all(x, F.lit(WIDGET), F.lit(0))
    between = F.split(x, WIDGET)
    x = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.when(i < F.size(widgets), widget_names(F.get(widgets, i))).otherwise(F.lit("")))), "")
    for pattern in (r'(?i)"product_entity"\s*:\s*"[^"]*"', rf"(?i){B}turn\d+product[A-Za-z0-9_]*", rf"(?i){B}turnProduct[A-Za-z0-9_]*", r"!\[[^\]]*\]\([^)]*\)", r"\[[0-9]+(?::[0-9]+)?\]"):
        x = F.regexp_replace(x, pattern, "")
    x = F.replace(F.replace(x, F.lit("[["), F.lit("[\\[")), F.lit("]]"), F.lit("\\]]"))
    return trim_all(F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def reference(path: Column, label: Column, wiki: bool = True) -> Column:
    if wiki:
        return F.concat(F.lit("[["), F.regexp_replace(path, r"(?i)\.md$", ""), F.lit("|"), F.replace(label, F.lit("|"), F.lit("-")), F.lit("]]"))
    return F.concat(label, F.lit(" ("), path, F.lit(")"))


def evidence_list(evidence: Column, most: int = 240) -> Column:
    """A line an entry; evidence: array of (title, path, confidence, quote)."""

    def line(e: Column) -> Column:
        return F.concat(F.lit("- "), cleaned(e["title"]), F.lit(" ("), e["path"], F.lit(") ("), number(round_half_up(e["confidence"])), F.lit('): "'), truncated(cleaned(e["quote"]), most), F.lit('"'))

    return F.when(F.coalesce(F.array_size(evidence), F.lit(0)) == 0, "No evidence captured.").otherwise(F.array_join(F.transform(evidence, line), "\n"))


def typed_links(links: Column, wiki: bool = True) -> Column:
    """A line a type in the order of types; links: array of (type, path, label)."""

    def line(kind: str, many: str) -> Column:
        of = F.filter(links, lambda n: n["type"] == kind)
        return F.when(F.size(of) > 0, F.concat(F.lit(f"- {many}: "), F.array_join(F.transform(of, lambda n: reference(n["path"], n["label"], wiki)), ", ")))

    out = F.concat_ws("\n", *[line(kind, many) for kind, (_, many) in TYPES.items()])
    return F.when(out == "", "No high-confidence links extracted.").otherwise(out)


def node_note(source: str = "skein", prefix: str = PREFIX) -> Column:
    """The note of a node with the columns type, id, label, confidence, last_seen, aliases, source_ids, summary, stability, inference_level,
    applies_to, agent_instruction, evidence (array of title, path, confidence, quote) and related (array of type, path, label)."""
    c = F.col
    paths = F.array_distinct(F.transform("evidence", lambda e: e["path"]))
    head = front_matter([
        ("type", c("type"), "text"), ("id", c("id"), "text"), ("source", F.lit(source), "text"), ("managed", F.lit(True), "number"),
        ("confidence", round_half_up(c("confidence")), "number"), ("last_seen", c("last_seen"), "text"), ("evidence_count", F.size("evidence"), "number"),
        ("aliases", c("aliases"), "list"), ("source_ids", c("source_ids"), "list"), ("source_paths", paths, "list"), ("stability", c("stability"), "text"),
        ("inference_level", c("inference_level"), "text"), ("applies_to", c("applies_to"), "list"), ("agent_instruction", c("agent_instruction"), "text"),
    ], prefix)
    about = F.concat_ws("\n", F.concat(F.lit("- **Stability**: "), F.nullif(c("stability"), F.lit(""))), F.concat(F.lit("- **Inference level**: "), F.nullif(c("inference_level"), F.lit(""))), F.when(F.size("applies_to") > 0, F.concat(F.lit("- **Applies to**: "), F.array_join("applies_to", ", "))))
    own = F.concat(F.coalesce(F.when(c("agent_instruction") != "", F.concat(F.lit("## Agent Instruction\n"), cleaned(c("agent_instruction")), F.lit("\n\n"))), F.lit("")), F.when(about != "", F.concat(F.lit("## Self-Model Metadata\n"), about, F.lit("\n\n"))).otherwise(F.lit("")))
    return F.concat(
        head, F.lit("\n# "), mapped(c("type"), {k: v[0] for k, v in TYPES.items()}), F.lit(": "), c("label"), F.lit("\n\n## Summary\n"), cleaned(c("summary")), F.lit("\n\n"), own,
        F.lit("\n## Evidence\n"), evidence_list(c("evidence")), F.lit("\n\n## Related Context\n"), typed_links(c("related")), F.lit("\n\n## Source Conversations\n"), F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- "), p)), "\n"),
    )


def review_entry() -> Column:
    """The inbox entry of a review item with the columns label, id, status, priority, category, type, confidence, aliases, source_ids, summary, evidence."""
    c = F.col

    def code(name: str, x: Column) -> Column:
        return F.when(x != "", F.concat(F.lit(f"- **{name}**: `"), x, F.lit("`")))

    def listed(name: str, x: Column) -> Column:
        return F.when(F.size(x) > 0, F.concat(F.lit(f"- **{name}**: "), F.array_join(x, "; ")))

    fields = [code("ID", c("id")), code("Status", c("status")), code("Priority", c("priority")), code("Category", c("category")), code("Target type", c("type")), F.concat(F.lit("- **Confidence**: "), number(round_half_up(c("confidence")))), listed("Aliases", c("aliases")), listed("Source IDs", c("source_ids"))]
    return F.concat_ws("\n", F.concat(F.lit("### Review: "), c("label")), *fields, F.lit("\n#### Summary"), cleaned(c("summary")), F.lit("\n#### Evidence"), evidence_list(c("evidence")))
