"""Queries of paths and drafts of notes, with the SQL that each is checked with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .registry import TRIM, query, read
from .sinks import notes, paths

NAME_SQL = "regexp_replace(left(" + TRIM.format("regexp_replace(regexp_replace(url, '[\\\\/:*?\"<>|#^\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g')") + ", 96), '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH h AS (SELECT page_id, {NAME_SQL} AS name, left(lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: xor((h * 33) & 4294967295, c)), 36)), 8) AS id FROM pages)
 SELECT page_id, 'Out/Sources/Web/' || name || ' - ' || id || '.md' AS source_path, 'Out/Topics/' || name || '.md' AS node_path, name AS stem, 'Out/Topics' AS parent FROM h""")
def note_paths(spark, d):
    source = paths.source_path(F.col("url"), F.col("url"), "/Out/", "Web")
    node = paths.node_path(F.lit("topic"), F.col("url"), "Out")
    return read(spark, d, "pages").select("page_id", source.alias("source_path"), node.alias("node_path"), paths.stem(node).alias("stem"), paths.parent(node).alias("parent"))


@query("""WITH i AS (SELECT o_orderkey::VARCHAR AS id, 'L' || lpad(o_orderkey::VARCHAR, 12, '0') AS label, CASE WHEN o_custkey % 3 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
 CASE o_orderstatus WHEN 'F' THEN 'visual_design' WHEN 'O' THEN 'technical_workflow' ELSE 'other' END AS category, 1 + o_orderkey % 4 AS variants FROM orders),
 r AS (SELECT *, CASE status WHEN 'pending' THEN 0 ELSE 1 END AS s, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS p FROM i),
 n AS (SELECT *, row_number() OVER (PARTITION BY category, priority ORDER BY s, label) > CASE priority WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 0 END AS hidden FROM r),
 e AS (SELECT category, string_agg(label, '; ' ORDER BY k) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY p, s, label) AS k FROM n WHERE hidden) WHERE k <= 6 GROUP BY category)
 SELECT category, count(*) FILTER (NOT hidden)::INT AS shown, count(*) FILTER (hidden) AS n, count(*) FILTER (hidden AND priority = 'high') AS n_high, count(*) FILTER (hidden AND priority = 'medium') AS n_medium, count(*) FILTER (hidden AND priority = 'low') AS n_low, sum(variants) FILTER (hidden)::BIGINT AS n_variants, any_value(examples) AS examples FROM n LEFT JOIN e USING (category) GROUP BY category""")
def inbox_overflow(spark, d):
    """Orders as review items: what the inbox shows of each category, and what it sums up."""
    p, s = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("L"), F.format_string("%012d", "o_orderkey")).alias("label"), F.when(F.col("o_custkey") % 3 == 0, "approved").otherwise("pending").alias("status"), F.when(p == "1", "high").when(p.isin("2", "3"), "medium").otherwise("low").alias("priority"), F.when(s == "F", "visual_design").when(s == "O", "technical_workflow").alias("category"), F.lit("preference").alias("type"), F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("source_ids"), F.lit("said").alias("summary"), F.array().cast("array<struct<title:string,path:string,confidence:double,quote:string>>").alias("evidence"), (1 + F.col("o_orderkey") % 4).alias("variant_count"))
    return notes.inbox_lines(o.withColumn("category", F.coalesce("category", F.lit("other")))).select("category", F.size("shown").alias("shown"), "n", "n_high", "n_medium", "n_low", "n_variants", F.array_join("examples", "; ").alias("examples"))


def conversation_sources(spark, d):
    t = read(spark, d, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("source"), "turn", "role", "text")
    return t, t.groupBy("source").agg(F.min_by("text", "turn").alias("first"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT 'conv-' || conv_id AS source, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT source, 'Out/Sources/ChatGPT/Talk ' || n || ' - ' || left(lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(source, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: xor((h * 33) & 4294967295, c)), 36)), 8) || '.md' AS path, n AS turns FROM c""")
def source_note_files(spark, d):
    """A note for each conversation, read back: its path and the turns of its transcript."""
    t, s = conversation_sources(spark, d)
    sources = s.select("source", F.concat(F.lit("Talk "), "n").alias("title"), F.left("first", F.lit(80)).alias("summary"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("last_seen"), F.lit("other").alias("class"))
    links = s.select("source", F.lit("topic").alias("type"), F.concat(F.lit("topic_"), "n").alias("node"), F.lit(1).alias("rank"), F.concat(F.lit("Talk "), "n").alias("label"), F.lit(0.8).alias("confidence"), F.lit("s").alias("summary"), F.array().cast("array<string>").alias("aliases"), F.array(F.struct("source", F.left("first", F.lit(40)).alias("quote"), F.lit(0.7).alias("confidence"))).alias("evidence"))
    items = t.select("source", F.lit("task").alias("type"), F.col("turn").cast("long").alias("ord"), F.left("text", F.lit(30)).alias("label"), F.lit("said").alias("summary"), F.lit(0.7).alias("confidence"), F.col("role").alias("quote"))
    turns = t.select("source", F.col("turn").alias("turn_ord"), F.lit("turn").alias("role"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("at"), "text")
    out = notes.source_notes(sources, links, items, turns, "Out")
    source = F.regexp_extract("content", r'skein_source_id: "([^"]*)"', 1)
    transcript = F.split_part("content", F.lit("## Transcript\n"), F.lit(2))
    return out.select(source.alias("source"), "path", F.regexp_count(transcript, F.lit("(?m)^### turn$")).cast("long").alias("turns"))


@query("""SELECT CASE p_size % 3 WHEN 0 THEN 'preference' WHEN 1 THEN 'topic' ELSE 'task' END AS type, count(*) AS n FROM part GROUP BY ALL""")
def context_pack_files(spark, d):
    """The pack of sections with parts as nodes, read back: how many nodes a section lists."""
    k, none = F.col("p_size") % 3, F.array().cast("array<string>")
    nodes = read(spark, d, "part").select(F.when(k == 0, "preference").when(k == 1, "topic").otherwise("task").alias("type"), F.concat_ws(" ", "p_name", "p_partkey").alias("label"), F.col("p_type").alias("summary"), F.lit(None).cast("string").alias("agent_instruction"), none.alias("applies_to"), F.lit("stable").alias("stability"), F.lit("explicit").alias("inference_level"), F.col("p_size").alias("n_evidence"), F.col("p_brand").alias("last_seen"), F.col("p_retailprice").alias("confidence"), F.array().cast("array<struct<type:string,path:string,label:string>>").alias("related"))
    _, s = conversation_sources(spark, d)
    pack = notes.context_pack(nodes, s.select("source", F.lit("Talk").alias("title"), F.left("first", F.lit(80)).alias("summary"), F.lit(None).cast("string").alias("last_seen")), "Out")
    kind = F.when(F.endswith("path", F.lit("Preferences.md")), "preference").when(F.endswith("path", F.lit("Topics.md")), "topic").when(F.endswith("path", F.lit("Tasks.md")), "task")
    return pack.select(kind.alias("type"), F.regexp_count("content", F.lit("(?m)^### ")).cast("long").alias("n")).where("type IS NOT NULL")


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'topic' ELSE 'preference' END AS type, CASE p_size % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'bulleted' WHEN 2 THEN 'technical' ELSE '' END AS one, CASE p_partkey % 4 WHEN 0 THEN 'answers' WHEN 1 THEN 'output' WHEN 2 THEN 'detail' ELSE '' END AS two, p_name FROM part)
 SELECT p_partkey, CASE WHEN type = 'topic' THEN p_name WHEN one = 'short' AND two IN ('answers', 'output') THEN 'Concise, high-density communication' WHEN one = 'bulleted' AND two = 'output' THEN 'Structured bullet-based output' WHEN one = 'technical' AND two = 'detail' THEN 'Technically detailed implementation guidance' ELSE p_name END AS label FROM t""")
def family_labels(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    words = F.concat_ws(" ", F.when(s % 5 == 0, "short").when(s % 5 == 1, "bulleted").when(s % 5 == 2, "technical"), F.when(k % 4 == 0, "answers").when(k % 4 == 1, "output").when(k % 4 == 2, "detail"))
    return read(spark, d, "part").select("p_partkey", T.family_label(F.when(s % 4 == 0, "topic").otherwise("preference"), F.col("p_name"), words).alias("label"))

