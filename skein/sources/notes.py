"""Managed notes read back as seeds: front matter, sections and evidence lines by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import PREFIX, TYPES, mapped
from ..functions.text import hash_id, slug, trim_all

# An evidence line in its link form and its plain form.
LINKED = r'^- \[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|([^\]]+))?\]\] \(([0-9.]+)\): "?(.+?)"?$'
PLAIN = r'^- (.+?) \((.+?)\) \(([0-9.]+)\): "?(.+?)"?$'
STATUSES = ["pending", "approved", "rejected"]


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the Markdown files below a folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def block(content: Column) -> Column:
    return F.regexp_extract(content, r"(?s)^---\n(.*?)\n---", 1)


def unquoted(v: Column) -> Column:
    return F.when(v.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]"), v)).otherwise(v)


def field(front: Column, key: str) -> Column:
    """The scalar of a key (the last, if it is repeated), else null."""
    return unquoted(trim_all(F.try_element_at(F.regexp_extract_all(front, F.lit(rf"(?m)^{key}:[ \t]*(\S.*)$"), F.lit(1)), F.lit(-1))))


def listed(front: Column, key: str) -> Column:
    """The items of a key, no items if it has none."""
    lines = F.split(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\n((?:  - .*(?:\n|\z))+)", 1), "\n")
    return F.transform(F.filter(lines, lambda x: x.startswith("  - ")), lambda x: unquoted(trim_all(F.regexp_replace(x, "^  - ", ""))))


def section(content: Column, heading: str, level: int = 2) -> Column:
    """The text below a heading, up to the next of its level (or, below level two, of a higher one)."""
    ends = "|".join("#" * k + r"\s" for k in range(3 if level > 2 else 2, level + 1))
    return trim_all(F.regexp_extract(content, rf"(?ms)^{'#' * level}\s+{heading}[ \t]*$(.*?)(?=^(?:{ends})|\z)", 1))


def evidence(text: Column) -> Column:
    """Array of (title, path, confidence, quote)."""

    def line(x: Column) -> Column:
        wiki = x.rlike(LINKED)

        def part(i: int, j: int) -> Column:
            return trim_all(F.when(wiki, F.regexp_extract(x, LINKED, i)).otherwise(F.regexp_extract(x, PLAIN, j)))

        path = part(1, 2)
        base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
        quote = trim_all(F.regexp_replace(part(4, 4), '^"|"$', ""))
        return F.struct(F.coalesce(F.nullif(part(2, 1), F.lit("")), base).alias("title"), path.alias("path"), F.coalesce(part(3, 3).try_cast("double"), F.lit(0.0)).alias("confidence"), quote.alias("quote"))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: (x.rlike(LINKED) | x.rlike(PLAIN)) & ~x.rlike("(?i)No evidence captured"))
    return F.transform(lines, line)


def managed(notes: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """The notes that say they are managed, with their front matter."""
    return notes.withColumn("front", block(F.col("content"))).where(field(F.col("front"), f"{prefix}managed") == "true")


def source_paths(notes: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """key, found: source ids by the path of their note, with and without its ending."""
    s = managed(notes, prefix).where(field(F.col("front"), f"{prefix}type") == "source_conversation").select("path", field(F.col("front"), f"{prefix}source_id").alias("found")).where("found <> ''")
    keys = F.array_distinct(F.array(F.col("path"), F.regexp_replace("path", r"\.md$", "")))
    return s.select(F.explode(keys).alias("key"), "found").groupBy("key").agg(F.max("found").alias("found"))


def with_sources(seeds: DataFrame, paths: DataFrame) -> DataFrame:
    """Evidence with source ids (unknown paths: an id made from the path), and these added to source_ids in order."""
    rows = seeds.select("seed", F.posexplode("evidence").alias("pos", "e")).withColumn("key", F.col("e.path")).withColumn("bare", F.regexp_replace("e.path", r"\.md$", ""))
    j = rows.join(paths, "key", "left").join(paths.select(F.col("key").alias("bare"), F.col("found").alias("found2")), "bare", "left")
    sid = F.coalesce("found", "found2", F.concat(F.lit("seed_"), hash_id(F.col("key"))))
    e = F.struct("pos", sid.alias("source_id"), F.col("e.title").alias("title"), F.col("e.path").alias("path"), F.col("e.confidence").alias("confidence"), F.col("e.quote").alias("quote"))
    found = j.groupBy("seed").agg(F.array_sort(F.collect_list(e)).alias("ev"))
    out = seeds.drop("evidence").join(found, "seed", "left").withColumn("evidence", F.coalesce("ev", F.array().cast("array<struct<pos:int,source_id:string,title:string,path:string,confidence:double,quote:string>>")))
    return out.withColumn("source_ids", F.array_distinct(F.concat("source_ids", F.transform("evidence", lambda x: x["source_id"])))).drop("ev", "seed")


def node_seeds(notes: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """The seeds of managed node notes; the label is the title after its type, else the file's name."""
    c, front = F.col("content"), F.col("front")

    def f(key: str) -> Column:
        return field(front, prefix + key)

    n = managed(notes, prefix).withColumn("type", f("type")).where(F.col("type").isin(list(TYPES)))
    title = F.regexp_extract(c, r"(?m)^#\s+[A-Z][A-Za-z ]*?:\s+(.+)$", 1)
    labelled = c.rlike(r"(?m)^#\s+[A-Z][A-Za-z ]*?:\s+.+$") & F.contains(c, F.concat(F.lit("# "), mapped(F.col("type"), {k: v[0] for k, v in TYPES.items()}), F.lit(":")))
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    n = n.withColumn("label", F.when(labelled, trim_all(title)).otherwise(base))
    seeds = n.select(
        F.col("path").alias("seed"), "type", F.coalesce(f("id"), F.concat_ws("_", "type", slug(F.col("label")))).alias("id"), "label", slug(F.col("label")).alias("slug"), listed(front, prefix + "aliases").alias("aliases"), "path",
        section(c, "Summary").alias("summary"), F.coalesce(f("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), listed(front, prefix + "source_ids").alias("source_ids"), f("last_seen").alias("last_seen"), f("stability").alias("stability"),
        f("inference_level").alias("inference_level"), listed(front, prefix + "applies_to").alias("applies_to"), f("agent_instruction").alias("agent_instruction"), evidence(section(c, "Evidence")).alias("evidence"),
    )
    return with_sources(seeds, source_paths(notes, prefix))


def legacy_seeds(notes: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Review items of the older form, a note each: fields in the front matter, the label in the title, else the file's name."""
    c, front = F.col("content"), F.col("front")

    def f(key: str) -> Column:
        return field(front, prefix + key)

    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    title = trim_all(F.regexp_extract(c, r"(?m)^#\s+Review:\s+(.+)$", 1))
    n = managed(notes, prefix).where(f("type") == "review_item").withColumn("label", F.when(title == "", base).otherwise(title)).withColumn("kind", f("target_type"))
    return n.select(
        F.col("path").alias("seed"), F.col("kind").alias("type"), F.coalesce(f("id"), F.concat(F.lit("review_"), "kind", F.lit("_"), slug(F.col("label")))).alias("id"), "label", slug(F.col("label")).alias("slug"), listed(front, prefix + "aliases").alias("aliases"), "path",
        F.coalesce(section(c, "Summary"), F.lit("")).alias("summary"), F.coalesce(f("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), listed(front, prefix + "source_ids").alias("source_ids"), f("review_status").alias("status"), f("review_priority").alias("priority"), f("review_category").alias("category"), evidence(section(c, "Evidence")).alias("evidence"),
    )


def review_seeds(notes: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """The entries of review inboxes and review items with a note each, with the status that a person gave them; those without a label, type or status are left out."""
    inbox = managed(notes, prefix).where(field(F.col("front"), f"{prefix}type") == "review_queue")
    x = F.col("entry")
    parts = inbox.select("path", F.posexplode(F.split("content", r"(?m)(?=^###\s+Review:\s+)")).alias("pos", "entry")).where(x.rlike(r"(?m)^###\s+Review:\s+"))

    def f(name: str) -> Column:
        return F.regexp_replace(trim_all(F.regexp_extract(x, rf"(?m)^- \*\*{name}\*\*:\s+(.+)$", 1)), "^`|`$", "")

    def many(name: str) -> Column:
        return F.filter(F.transform(F.split(f(name), ";"), trim_all), lambda v: v != "")

    label = trim_all(F.regexp_extract(x, r"(?m)^###\s+Review:\s+(.+)$", 1))
    seeds = parts.select(
        F.concat_ws("#", "path", "pos").alias("seed"), f("Target type").alias("type"), F.coalesce(F.nullif(f("ID"), F.lit("")), F.concat(F.lit("review_"), f("Target type"), F.lit("_"), slug(label))).alias("id"), label.alias("label"), slug(label).alias("slug"), many("Aliases").alias("aliases"), "path",
        section(x, "Summary", 4).alias("summary"), F.coalesce(f("Confidence").try_cast("double"), F.lit(0.0)).alias("confidence"), many("Source IDs").alias("source_ids"), f("Status").alias("status"), f("Priority").alias("priority"), f("Category").alias("category"), evidence(section(x, "Evidence", 4)).alias("evidence"),
    )
    seeds = seeds.unionByName(legacy_seeds(notes, prefix))
    return with_sources(seeds.where((F.col("label") != "") & F.col("type").isin(list(TYPES)) & F.col("status").isin(STATUSES)), source_paths(notes, prefix))
