"""Queries of the readers, renderers, clusterings and state tables, with the SQL that each is checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import render as R
from .functions import text as T
from .operators import clustering as C
from .operators import graph as G
from .operators import state as S
from .operators import windows as W
from .operators.common import cut
from .registry import TRIM, query, read, slug_sql, tokens_sql
from .sources import exports, notes


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """The conversations as export records; every third turn has no time."""
    at = F.when(F.col("turn") % 3 != 0, F.col("turn") * 1.5)
    message = F.struct(F.struct("role").alias("author"), at.alias("create_time"), F.struct(F.array("text").alias("parts")).alias("content"))
    entry = F.struct(F.format_string("n%05d", "turn").alias("key"), F.struct(message.alias("message")).alias("value"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("mapping"))
    record = F.to_json(F.struct(F.concat(F.lit("conv-"), "conv_id").alias("id"), "mapping"))
    return c.select(F.lit("archive").alias("archive"), F.lit("conversations.json").alias("entry"), F.col("conv_id").cast("long").alias("input_ord"), record.alias("json"))


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN role IN ('user','assistant','system','tool') THEN role ELSE 'unknown' END AS role, {TRIM.format("text")} AS text FROM conversations)
 SELECT 'conv-' || conv_id AS source_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END, turn)::INT AS turn_ord, role, text,
 CASE WHEN turn % 3 <> 0 THEN strftime(make_timestamp((turn * 1500000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%gZ') END AS create_time FROM t WHERE text <> ''""")
def export_turns(spark, d):
    return exports.turns(export_rows(spark, d)).select("source_id", "turn_ord", "role", "text", "create_time")


@query(f"SELECT 'conv-' || conv_id AS source_id, 'Untitled ChatGPT Conversation ' || (conv_id + 1) AS title, count(*)::INT AS raw_message_count FROM conversations GROUP BY conv_id HAVING count(*) FILTER ({TRIM.format('text')} <> '') > 0")
def export_conversations(spark, d):
    return exports.conversations(export_rows(spark, d)).select("source_id", "title", "raw_message_count")


def part_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as nodes with their suppliers' order lines as evidence (the first three)."""
    line = F.struct(F.concat(F.lit("order "), "l_orderkey").alias("title"), F.concat(F.lit("Sources/o"), "l_orderkey", F.lit(".md")).alias("path"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_returnflag").alias("quote"))
    first = W.top_per_group(read(spark, d, "lineitem").select("l_partkey", line.alias("e")), ["l_partkey"], [F.col("e")], 3)
    e = first.groupBy("l_partkey").agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    p = read(spark, d, "part").join(e, F.col("p_partkey") == F.col("l_partkey"), "left")
    none = F.array().cast("array<struct<title:string,path:string,confidence:double,quote:string>>")
    return p.select(
        F.lit("topic").alias("type"), F.concat(F.lit("topic_"), "p_partkey").alias("id"), F.col("p_name").alias("label"), (F.col("p_size") / 100).alias("confidence"), F.lit(None).cast("string").alias("last_seen"), F.array("p_brand", "p_type").alias("aliases"),
        F.array().cast("array<string>").alias("source_ids"), F.concat(F.col("p_type"), F.lit("  of\n\n\n\n"), "p_brand").alias("summary"), F.lit("stable").alias("stability"), F.lit("").alias("inference_level"), F.array().cast("array<string>").alias("applies_to"),
        F.lit(None).cast("string").alias("agent_instruction"), F.coalesce("evidence", none).alias("evidence"), F.array(F.struct(F.lit("entity").alias("type"), F.concat(F.lit("Entities/"), "p_brand", F.lit(".md")).alias("path"), F.col("p_brand").alias("label"))).alias("related"), F.col("p_partkey"),
    )


EVIDENCE_SQL = """(SELECT l_partkey, list({'o': l_orderkey, 'c': 1 - l_discount, 'q': l_returnflag} ORDER BY 'order ' || l_orderkey, 1 - l_discount, l_returnflag)[:3] AS ev FROM lineitem GROUP BY l_partkey)"""
NUM = "regexp_replace((floor({0} * 100 + 0.5) / 100)::DOUBLE::VARCHAR, '\\.0$', '')"


@query(f"""WITH n AS (SELECT p_partkey, p_name, p_brand, p_type, {NUM.format("(p_size / 100::DOUBLE)")} AS conf, coalesce(ev, []) AS ev FROM part LEFT JOIN {EVIDENCE_SQL} ON l_partkey = p_partkey),
 t AS (SELECT *, list_filter(list_transform(ev, lambda e: 'Sources/o' || e.o || '.md'), lambda p, i: list_position(list_transform(ev, lambda e: 'Sources/o' || e.o || '.md'), p) = i) AS paths, list_transform(ev, lambda e: '- order ' || e.o || ' (Sources/o' || e.o || '.md) (' || {NUM.format("e.c")} || '): "' || e.q || '"') AS lines FROM n)
 SELECT p_partkey, md5('---' || chr(10) || 'skein_type: "topic"' || chr(10) || 'skein_id: "topic_' || p_partkey || '"' || chr(10) || 'skein_source: "skein"' || chr(10) || 'skein_managed: true' || chr(10) || 'skein_confidence: ' || conf || chr(10) || 'skein_evidence_count: ' || len(ev) || chr(10)
 || 'skein_aliases:' || chr(10) || '  - "' || p_brand || '"' || chr(10) || '  - "' || p_type || '"' || chr(10) || 'skein_source_ids: []' || chr(10) || CASE WHEN len(paths) = 0 THEN 'skein_source_paths: []' ELSE 'skein_source_paths:' || chr(10) || array_to_string(list_transform(paths, lambda p: '  - "' || p || '"'), chr(10)) END || chr(10)
 || 'skein_stability: "stable"' || chr(10) || 'skein_applies_to: []' || chr(10) || '---' || chr(10) || '# Topic: ' || p_name || chr(10) || chr(10) || '## Summary' || chr(10) || p_type || ' of' || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || '## Self-Model Metadata' || chr(10) || '- **Stability**: stable' || chr(10) || chr(10)
 || chr(10) || '## Evidence' || chr(10) || CASE WHEN len(lines) = 0 THEN 'No evidence captured.' ELSE array_to_string(lines, chr(10)) END || chr(10) || chr(10) || '## Related Context' || chr(10) || '- Entities: [[Entities/' || p_brand || '|' || p_brand || ']]' || chr(10) || chr(10) || '## Source Conversations' || chr(10) || array_to_string(list_transform(paths, lambda p: '- ' || p), chr(10))) AS note FROM t""")
def node_note(spark, d):
    return part_nodes(spark, d).select("p_partkey", F.md5(R.node_note()).alias("note"))


@query(f"""SELECT 'topic_' || p_partkey AS id, p_name AS label, {slug_sql('p_name')} AS slug, p_brand || ';' || p_type AS aliases, p_size / 100::DOUBLE AS confidence, p_type || ' of' || chr(10) || chr(10) || p_brand AS summary, 'stable' AS stability,
 coalesce(len(ev), 0)::INT AS n_evidence, coalesce(array_to_string(list_transform(ev, lambda e: 'order ' || e.o || ':' || e.q), ';'), '') AS evidence FROM part LEFT JOIN {EVIDENCE_SQL} ON l_partkey = p_partkey""")
def note_seeds(spark, d):
    """Notes are rendered and read back."""
    written = part_nodes(spark, d).select(F.concat(F.lit("Topics/"), "p_partkey", F.lit(".md")).alias("path"), R.node_note().alias("content"))
    s = notes.node_seeds(C.cut(written))
    return s.select("id", "label", "slug", F.array_join("aliases", ";").alias("aliases"), "confidence", "summary", "stability", F.size("evidence").alias("n_evidence"), F.array_join(F.transform("evidence", lambda e: F.concat(e["title"], F.lit(":"), e["quote"])), ";").alias("evidence"))


STATUS_SQL = "CASE p_size % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'approved' ELSE 'pending' END"


@query(f"SELECT 'review_' || p_partkey AS id, p_name AS label, {STATUS_SQL} AS status, p_type AS summary, p_size / 100::DOUBLE AS confidence, 's' || p_size AS source_ids FROM part")
def inbox_seeds(spark, d):
    """One inbox a brand is rendered and read back."""
    size = F.col("p_size") % 3
    item = read(spark, d, "part").select(
        "p_partkey", "p_brand", F.col("p_name").alias("label"), F.concat(F.lit("review_"), "p_partkey").alias("id"), F.when(size == 0, "rejected").when(size == 1, "approved").otherwise("pending").alias("status"), F.lit("high").alias("priority"), F.lit("other").alias("category"),
        F.lit("pattern").alias("type"), (F.col("p_size") / 100).alias("confidence"), F.array().cast("array<string>").alias("aliases"), F.array(F.concat(F.lit("s"), "p_size")).alias("source_ids"), F.col("p_type").alias("summary"), F.array().cast("array<struct<title:string,path:string,confidence:double,quote:string>>").alias("evidence"),
    )
    head = R.front_matter([("type", F.lit("review_queue"), "text"), ("managed", F.lit(True), "number")])
    entries = item.select("p_brand", "p_partkey", R.review_entry().alias("entry")).groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "entry"))), lambda x: x["entry"]), "\n\n").alias("body"))
    inbox = entries.select(F.concat("p_brand", F.lit(".md")).alias("path"), F.concat(head, F.lit("\n# Review Queue\n\n"), "body").alias("content"))
    return notes.review_seeds(C.cut(inbox)).select("id", "label", "status", "summary", "confidence", F.array_join("source_ids", ";").alias("source_ids"))


CLEAN_SQL = "text"
for _p, _r in (("(?i)\"product_entity\"\\s*:\\s*\"[^\"]*\"", ""), ("(?i)\\bturn\\d+product\\w*", ""), ("(?i)\\bturnproduct\\w*", ""), ("!\\[[^\\]]*\\]\\([^)]*\\)", ""), ("\\[[0-9]+(?::[0-9]+)?\\]", "")):
    CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '{_p}', '{_r}', 'g')"
CLEAN_SQL = f"regexp_replace(regexp_replace(replace(replace({CLEAN_SQL}, '[[', '[\\['), ']]', '\\]]'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, md5({TRIM.format(CLEAN_SQL)}) AS clean FROM documents")
def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(R.cleaned(F.col("text"))).alias("clean"))


@query("""SELECT p_type, string_agg('- ' || p_name || ' (Parts/' || p_partkey || '.md)', chr(10) ORDER BY r) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 20 GROUP BY p_type""")
def context_sections(spark, d):
    top = W.top_per_group(read(spark, d, "part"), ["p_type"], [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")], 20)
    line = F.concat(F.lit("- "), R.reference(F.concat(F.lit("Parts/"), "p_partkey", F.lit(".md")), F.col("p_name"), wiki=False))
    return top.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))


HASH_SQL = "lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: xor((h * 33) & 4294967295, c)), 36))"


@query(f"""SELECT p_partkey, {HASH_SQL.format("'{\"kind\":\"embedding\",\"model\":\"m\",\"textHash\":\"' || th || '\"}'")} AS key FROM (SELECT p_partkey, {HASH_SQL.format("p_name")} AS th FROM part)""")
def cache_keys(spark, d):
    return read(spark, d, "part").select("p_partkey", S.cache_key("embedding", textHash=T.hash_id(F.col("p_name")), model=F.lit("m")).alias("key"))


MODEL_SQL = "CASE event_id % 5 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN ' gpt-5.5' WHEN 2 THEN 'gpt-5.4-mini' WHEN 3 THEN 'gpt-5.4-nano' ELSE 'other' END"


@query(f"""WITH e AS (SELECT event_id, event_type, event_id % 7 = 0 AS emb, floor(value * 100) AS n, {MODEL_SQL} AS m FROM events)
 SELECT event_type, count(*) AS calls, floor(sum(CASE WHEN emb THEN n * 0.13 ELSE n * CASE trim(m) WHEN 'gpt-5.4-nano' THEN 0.2 WHEN 'gpt-5.4-mini' THEN 0.75 WHEN 'gpt-5.5' THEN 5 ELSE 2.5 END + (n + 1) * CASE trim(m) WHEN 'gpt-5.4-nano' THEN 1.25 WHEN 'gpt-5.4-mini' THEN 4.5 WHEN 'gpt-5.5' THEN 30 ELSE 15 END END / 1e6) * 1000 + 0.5) / 1000 AS usd FROM e GROUP BY event_type""")
def usage_cost(spark, d):
    i = F.col("event_id") % 5
    model = F.when(i == 0, "gpt-5.4").when(i == 1, " gpt-5.5").when(i == 2, "gpt-5.4-mini").when(i == 3, "gpt-5.4-nano").otherwise("other")
    n = F.floor(F.col("value") * 100)
    usd = S.usage_cost(F.when(F.col("event_id") % 7 == 0, "embedding").otherwise("extraction"), model, n, n + 1, n)
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), (F.floor(F.sum(usd) * 1000 + 0.5) / 1000).alias("usd"))


RUN_SQL = "SELECT user_id AS run, event_id AS seq, ts AS began, event_type AS phase, CASE WHEN event_id % 3 = 0 THEN 'succeeded' WHEN event_id % 3 = 1 THEN 'failed' ELSE 'running' END AS status FROM events"


@query(f"""WITH e AS ({RUN_SQL}), g AS (SELECT run, arg_max(phase, seq) AS phase, arg_max(status, seq) AS s, min(began) AS st, arg_max(began, seq) FILTER (status <> 'running') AS done FROM e GROUP BY run),
 t AS (SELECT *, CASE WHEN s = 'running' THEN make_timestamp(2030, 1, 1, 0, 0, 0) ELSE done END AS fin FROM g)
 SELECT run, phase, CASE WHEN s = 'running' THEN 'failed' ELSE s END AS status, epoch_us(fin) // 1000 - epoch_us(st) // 1000 AS duration_ms, s = 'running' AS cut_off FROM t""")
def run_states(spark, d):
    k = F.col("event_id") % 3
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("phase"), F.when(k == 0, "succeeded").when(k == 1, "failed").otherwise("running").alias("status"))
    at = F.lit("2030-01-01 00:00:00").cast(e.schema["at"].dataType)
    return S.interrupted(S.run_states(e), at).select("run", "phase", "status", "duration_ms", F.col("error").isNotNull().alias("cut_off"))


@query("""WITH g AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n, max(1 - l_discount) AS c FROM lineitem GROUP BY l_partkey),
 k AS (SELECT p_partkey AS node, p_size, n, c::DOUBLE AS c, CASE p_partkey % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'entity' WHEN 2 THEN 'topic' WHEN 3 THEN 'task' ELSE 'pattern' END AS kind FROM part JOIN g ON l_partkey = p_partkey)
 SELECT node, kind, CASE WHEN kind = 'preference' THEN p_size > 20 AND ((n = 1 AND p_size > 30 AND c >= 0.94) OR (n >= 2 AND c >= 0.78)) WHEN kind = 'pattern' THEN p_size > 20 AND n >= 2 AND c >= 0.78
 ELSE n >= 2 OR (kind = 'entity' AND p_size > 10 AND c >= 0.94) OR (kind = 'topic' AND p_size > 10 AND c >= 0.94 + 0.03) END AS promoted FROM k""")
def cluster_promotion(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"), F.max(1 - F.col("l_discount")).cast("double").alias("c"))
    j = read(spark, d, "part").select("p_partkey", "p_size").join(g, F.col("p_partkey") == F.col("l_partkey"))
    kind = F.element_at(F.array(*map(F.lit, ["preference", "entity", "topic", "task", "pattern"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    j = j.withColumn("kind", kind)
    size = F.col("p_size")
    return j.select(F.col("p_partkey").alias("node"), "kind", S.promoted(F.col("kind"), F.col("n"), F.col("c"), size > 20, size > 30, size > 10).alias("promoted"))


@query(f"""WITH RECURSIVE k AS (SELECT p.p_partkey AS id, p_brand AS type, tokens FROM {tokens_sql('part', 'p_partkey', 'p_name')} t JOIN part p USING (p_partkey)),
 j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) AS w, len(list_intersect(a.tokens, b.tokens)) AS n FROM k a JOIN k b ON a.type = b.type AND a.id < b.id),
 e AS (SELECT b AS id, list(a) AS earlier FROM j WHERE n >= 2 AND w >= 0.25 GROUP BY b),
 o AS (SELECT k.id, type, row_number() OVER (PARTITION BY type ORDER BY k.id) AS i, coalesce(earlier, []) AS earlier FROM k LEFT JOIN e ON k.id = e.id),
 r AS (SELECT type, i, [id] AS leads FROM o WHERE i = 1 UNION ALL SELECT o.type, o.i, CASE WHEN list_has_any(r.leads, o.earlier) THEN r.leads ELSE list_append(r.leads, o.id) END FROM r JOIN o ON o.type = r.type AND o.i = r.i + 1),
 l AS (SELECT unnest(arg_max(leads, i)) AS id FROM r GROUP BY type)
 SELECT id, id AS leader FROM l UNION ALL SELECT b, arg_min(a, (-w, a)) FROM j WHERE n >= 2 AND w >= 0.25 AND a IN (SELECT id FROM l) AND b NOT IN (SELECT id FROM l) GROUP BY b""")
def review_groups(spark, d):
    """Parts of a brand with similar names, grouped as a pass in the order of keys would."""
    t = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), T.significant_tokens(F.col("p_name")).alias("tokens")).where(F.size("tokens") > 0)
    classes = cut(G.set_classes(t))
    firsts = classes.where("id = first").select("id", "type", F.col("toks").alias("tokens"))
    pairs = cut(G.similar_sets(firsts).select("a", "b", (F.col("n_shared") / F.col("n_all")).alias("weight")))
    return C.leader_clusters_of_classes(t.select("id", F.col("id").alias("ord")), classes.select("id", "first"), pairs)
