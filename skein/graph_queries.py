"""Queries of the graph build over parts (labels) and order lines (evidence), with the SQL that each is checked with."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import build as B
from .operators import totals as TT
from .operators.common import cut, dealt, shared_folder
from .operators.graph import extraction_totals as extraction_totals_of
from .operators.graph import link_counts, merge_actions
from .operators.incremental import NodeState
from .operators.matching import cascade
from .operators.seeds import placed, survivors
from .operators.state import write_summary
from .plans.graph_build import Graph, build_graph
from .registry import ORACLE_SQL, query, read, slug_sql, tokens_sql

STABLE_SQL = "CASE p_size % 5 WHEN 0 THEN 'temporary' WHEN 1 THEN 'situational' WHEN 2 THEN 'recurring' WHEN 3 THEN 'stable' END"


def stability(size: F.Column) -> F.Column:
    return F.when(size % 5 == 0, "temporary").when(size % 5 == 1, "situational").when(size % 5 == 2, "recurring").when(size % 5 == 3, "stable")


def filed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts filed under their brand, in the order of keys."""
    p = read(spark, d, "part")
    sure = F.col("p_size") / 100
    evidence = F.array(F.struct(F.col("p_type").alias("source"), F.col("p_name").alias("quote"), F.lit(0.4).alias("confidence")))
    return p.select(F.col("p_brand").alias("node"), F.col("p_partkey").alias("ord"), F.array("p_type").alias("sources"), F.array("p_name").alias("names"), F.col("p_type").alias("summary"), sure.alias("confidence"), evidence.alias("evidence"), stability(F.col("p_size")).alias("stability"), F.when(F.col("p_size") > 25, "explicit").otherwise("supported_inference").alias("inference_level"), F.array(F.substring_index("p_type", " ", 1)).alias("applies_to"), F.when(F.col("p_size") > 30, F.col("p_name")).alias("agent_instruction"), F.col("p_size").cast("string").alias("last_seen"))


@query(f"""WITH c AS (SELECT p_brand AS node, p_partkey AS ord, p_type AS source, p_name AS label, p_size / 100::DOUBLE AS conf, {STABLE_SQL} AS st, p_size FROM part),
 g AS (SELECT node, max(conf) AS confidence, count(DISTINCT source) AS n_sources, max(CASE st WHEN 'stable' THEN 4 WHEN 'recurring' THEN 3 WHEN 'situational' THEN 2 WHEN 'temporary' THEN 1 END) AS s, max(p_size) > 25 AS ex, arg_max(p_size::VARCHAR, ord) AS last_seen, arg_min(label, ord) FILTER (p_size > 30) AS agent_instruction FROM c GROUP BY node),
 a AS (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY o) AS r FROM (SELECT node, label, min(ord) AS o FROM c WHERE {slug_sql('label')} <> {slug_sql('node')} GROUP BY ALL)),
 f AS (SELECT node, source, label, arg_min(least(conf, 0.4), ord) AS conf, min(ord) AS ord FROM c GROUP BY ALL),
 q AS (SELECT node, source, label, row_number() OVER (PARTITION BY node ORDER BY conf DESC, ord) AS r FROM f),
 w AS (SELECT node, x, row_number() OVER (PARTITION BY node ORDER BY min(ord)) AS r FROM (SELECT node, ord, string_split(source, ' ')[1] AS x FROM c) GROUP BY node, x),
 t AS (SELECT node, list(source ORDER BY o, source) AS ss FROM (SELECT node, source, min(ord) AS o FROM c GROUP BY ALL) GROUP BY node)
 SELECT g.node, confidence, n_sources, CASE s WHEN 4 THEN 'stable' WHEN 3 THEN 'recurring' WHEN 2 THEN 'situational' WHEN 1 THEN 'temporary' END AS stability, CASE WHEN ex THEN 'explicit' ELSE 'supported_inference' END AS inference_level, last_seen, agent_instruction,
 (SELECT string_agg(label, ';' ORDER BY r) FROM a WHERE a.node = g.node AND r <= 12) AS aliases, (SELECT string_agg(source || ':' || label, ';' ORDER BY r) FROM q WHERE q.node = g.node AND r <= 30) AS evidence, (SELECT string_agg(x, ';' ORDER BY r) FROM w WHERE w.node = g.node AND r <= 8) AS applies_to,
 list_reduce(list_prepend('', ss), lambda x, y: CASE WHEN x = '' OR contains(y, x) THEN y WHEN contains(x, y) THEN x ELSE left(x || ' ' || y, 900) END) AS summary FROM g JOIN t USING (node)""")
def node_accumulate(spark, d):
    rows = filed_parts(spark, d)
    n = B.accumulated(rows, rows.select("node", F.col("node").alias("label")).distinct())
    return n.select("node", "confidence", "n_sources", "stability", "inference_level", "last_seen", "agent_instruction", F.array_join("aliases", ";").alias("aliases"), F.array_join(F.transform("evidence", lambda e: F.concat(e["source"], F.lit(":"), e["quote"])), ";").alias("evidence"), F.array_join("applies_to", ";").alias("applies_to"), "summary")


def part_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Traits named after parts, clustered by the parts' type."""
    p = read(spark, d, "part")
    evidence = F.array(F.struct(F.col("p_brand").alias("source"), F.concat("p_name", F.lit("!")).alias("quote"), F.lit(0.3).alias("confidence")))
    return p.select(F.col("p_type").alias("cluster"), F.col("p_partkey").alias("ord"), F.lit("preference").alias("type"), F.col("p_brand").alias("source"), F.lit("a title").alias("title"), F.col("p_name").alias("label"), F.lit("said").alias("summary"), (F.col("p_size") / 100).alias("confidence"), evidence.alias("evidence"), stability(F.col("p_size")).alias("stability"), F.when(F.col("p_size") > 25, "explicit").otherwise("supported_inference").alias("inference_level"), F.array("p_brand").alias("applies_to"), F.lit(None).cast("string").alias("agent_instruction"), F.col("p_size").cast("string").alias("last_seen"))


PRIORITY_SQL = "CASE WHEN {status} = 'rejected' THEN 'low' WHEN {sources} >= 2 OR coalesce({inference} = 'explicit' AND {stability} IN ('stable', 'recurring') AND {confidence} >= 0.9, false) THEN 'high' WHEN coalesce({stability} IN ('situational', 'temporary'), false) OR {confidence} < 0.8 THEN 'low' ELSE 'medium' END"


@query(f"""WITH c AS (SELECT p_type AS cluster, p_partkey AS ord, p_brand AS source, p_name AS label, p_size / 100::DOUBLE AS conf, p_name || '!' AS quote, p_size, {STABLE_SQL} AS st FROM part),
 b AS (SELECT cluster, label AS best, conf, st, p_size, {slug_sql('label')} AS slug FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, CASE WHEN length(label) > 80 THEN 3 ELSE 0 END, ord) AS r FROM c) WHERE r = 1),
 a AS (SELECT cluster, string_agg(label, ';' ORDER BY r) AS aliases FROM (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY min(ord), label) AS r FROM c JOIN b USING (cluster) WHERE {slug_sql('label')} <> slug GROUP BY cluster, label) WHERE r <= 8 GROUP BY cluster),
 e AS (SELECT cluster, source, quote, arg_min(least(conf, 0.3), ord) AS conf, min(ord) AS ord FROM c GROUP BY ALL),
 q AS (SELECT cluster, string_agg(quote, ';' ORDER BY r) FILTER (r <= 12) AS quotes, count(*) AS grouped_evidence FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY conf DESC, ord) AS r FROM e) GROUP BY cluster),
 n AS (SELECT cluster, count(DISTINCT source) AS n_sources, count(*) AS variant_count FROM c GROUP BY cluster)
 SELECT cluster, 'review_preference_' || slug AS id, best AS label, coalesce(aliases, '') AS aliases, quotes, conf AS confidence, n_sources, variant_count, grouped_evidence, {PRIORITY_SQL.format(status="'pending'", sources="n_sources", inference="CASE WHEN p_size > 25 THEN 'explicit' END", stability="st", confidence="conf")} AS priority
 FROM n JOIN b USING (cluster) LEFT JOIN a USING (cluster) JOIN q USING (cluster)""")
def review_item(spark, d):
    r = B.review_items(part_clusters(spark, d))
    return r.select("cluster", "id", "label", F.array_join("aliases", ";").alias("aliases"), F.array_join(F.transform("evidence", lambda e: e["quote"]), ";").alias("quotes"), "confidence", "n_sources", "variant_count", "grouped_evidence", "priority")


LABEL_SQL = "CASE p_size % 5 WHEN 0 THEN p_name || ' (chunk 3)' WHEN 1 THEN 'Chunk 12' WHEN 2 THEN 'See ' || replace(p_name, ' ', '_') || '.ts source file' WHEN 3 THEN '_x ' || p_name ELSE p_name || '  a.docx' END"


@query(f"""WITH l AS (SELECT p_partkey, p_name, p_size % 5 AS k, {LABEL_SQL} AS label FROM part)
 SELECT p_partkey, CASE k WHEN 1 THEN 'The title' WHEN 0 THEN p_name WHEN 4 THEN p_name || ' a.docx' ELSE label END AS clean, CASE WHEN k = 2 THEN {slug_sql("replace(p_name, ' ', '_')")} ELSE '' END AS file, CASE WHEN k = 2 THEN 'artifact' ELSE 'entity' END AS type FROM l""")
def label_rules(spark, d):
    k, name = F.col("p_size") % 5, F.col("p_name")
    label = F.when(k == 0, F.concat(name, F.lit(" (chunk 3)"))).when(k == 1, "Chunk 12").when(k == 2, F.concat(F.lit("See "), F.replace(name, F.lit(" "), F.lit("_")), F.lit(".ts source file"))).when(k == 3, F.concat(F.lit("_x "), name)).otherwise(F.concat(name, F.lit("  a.docx")))
    return read(spark, d, "part").select("p_partkey", T.clean_label(label, F.lit("The title")).alias("clean"), T.filename_slug(label).alias("file"), T.graph_type(F.lit("entity"), label).alias("type"))


@query(f"""WITH t AS (SELECT p.p_partkey, p_name, p_size, array_to_string(k.tokens[1:5], '-') AS slug5, array_to_string(k.tokens, '-') AS norm, {slug_sql('p_name')} AS slug, len(k.tokens) AS n FROM part p LEFT JOIN {tokens_sql('part', 'p_partkey', 'p_name')} k ON p.p_partkey = k.p_partkey)
 SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'non_project' WHEN p_size % 3 = 1 THEN 'durable_project' ELSE 'domain_evidence' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'phone-plan' ELSE 'custom:' || slug5 END AS domain FROM t WHERE n >= 2 AND NOT regexp_matches(p_name, '(?i)\\b(analysis|research|reference)\\b')""")
def project_triage(spark, d):
    """Projects named after parts: with a summary about phones, with one about a platform, and narrow actions of one."""
    k = F.col("p_size") % 3
    p = read(spark, d, "part").where((F.size(T.significant_tokens(F.col("p_name"))) >= 2) & ~T.has_word(F.col("p_name"), "analysis|research|reference"))
    label = F.col("p_name")
    as_action = T.project_kind(label, F.lit("a platform for everyone"))
    made = F.when(k == 0, T.project_kind(label, F.lit("about the family phone"))).otherwise(as_action)
    kind = F.when(k == 2, F.when(T.narrow_action(F.concat(F.lit("Build "), label)), "domain_evidence")).otherwise(made["kind"])
    return p.select("p_partkey", kind.alias("kind"), made["domain"].alias("domain"))


@query(f"""WITH t AS (SELECT p.p_partkey, {slug_sql('p_name')} AS slug, coalesce(array_to_string(tokens, '-'), '') AS norm FROM part p LEFT JOIN {tokens_sql('part', 'p_partkey', 'p_name')} k ON p.p_partkey = k.p_partkey)
 SELECT p_partkey, 'topic:' || slug || CASE WHEN norm <> '' AND norm <> slug THEN ' topic:normalized:' || norm ELSE '' END AS keys FROM t""")
def match_keys(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(T.match_keys(F.lit("topic"), F.col("p_name")), " ").alias("keys"))


@query("""WITH l AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS other, l_returnflag AS other_type, l_suppkey % 7 / 10::DOUBLE AS confidence, l_suppkey % 3 AS n_evidence, 'n' || l_suppkey AS label FROM lineitem),
 u AS (SELECT node, other, min(other_type) AS other_type, any_value(confidence) AS confidence, any_value(n_evidence) AS n_evidence, any_value(label) AS label FROM l GROUP BY node, other)
 SELECT node, other, other_type, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node, other_type ORDER BY confidence DESC, n_evidence DESC, label, other) AS rank FROM u) WHERE rank <= 2""")
def append_links(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("other"), "l_returnflag")
    n = l.count()
    l = cut(dealt(l, n, "node").groupBy("node", "other").agg(F.min("l_returnflag").alias("other_type")))
    l = l.withColumns({"confidence": F.col("other") % 7 / 10, "n_evidence": F.col("other") % 3, "label": F.concat(F.lit("n"), "other")})
    return B.appended_links(l.where("other_type = 'A'"), l.where("other_type <> 'A'").union(l.where("other_type = 'A'")), n_rows=n).select("node", "other", "other_type", "rank")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS node FROM lineitem WHERE l_discount < 0.01), n AS (SELECT p_partkey AS node, p_partkey + 1 AS other FROM part WHERE p_size < 5),
 e AS (SELECT node FROM s UNION SELECT node FROM n UNION SELECT other FROM n), k AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (SELECT node FROM e))
 SELECT 'node' AS part, count(*) AS n, sum(node)::BIGINT AS total FROM k UNION ALL SELECT 'source', count(*), sum(node)::BIGINT FROM s WHERE node IN (SELECT node FROM k) UNION ALL SELECT 'link', count(*), sum(node)::BIGINT FROM n WHERE node IN (SELECT node FROM k) AND other IN (SELECT node FROM k)""")
def graph_hygiene(spark, d):
    s = read(spark, d, "lineitem").where("l_discount < 0.01").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("node")).distinct()
    n = read(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + 1).alias("other"))
    kept = B.without_isolated(read(spark, d, "part").select(F.col("p_partkey").alias("node")), s, n)
    sums = [x.agg(F.count("*").alias("n"), F.sum("node").alias("total")).select(F.lit(name).alias("part"), "n", "total") for name, x in zip(("node", "source", "link"), kept, strict=True)]
    return sums[0].union(sums[1]).union(sums[2])


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS node FROM lineitem WHERE l_returnflag = 'A'), w AS (SELECT l_orderkey AS source, l_partkey AS node, min(l_linenumber) AS ord FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
 h AS (SELECT source, count(*) AS had FROM l GROUP BY source), n AS (SELECT w.* FROM w ANTI JOIN l USING (source, node)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord, node) AS r FROM n)
 SELECT source, node FROM r LEFT JOIN h USING (source) WHERE r + coalesce(had, 0) <= 3""")
def late_links(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("node"), F.col("l_linenumber").alias("ord"), "l_returnflag")
    return B.late_links(l.where("l_returnflag = 'A'").select("source", "node").distinct(), l.where("l_returnflag <> 'A'"))


@query("""WITH v AS (SELECT unnest(['communication_style', 'visual_design', 'product_strategy', 'other']) AS category),
 i AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'visual_design' WHEN 'O' THEN 'communication_style' ELSE 'other' END AS category, CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' ELSE 'low' END AS p, o_custkey % 4 AS k FROM orders),
 g AS (SELECT category, count(*) AS n, count(*) FILTER (p = 'high') AS high, count(*) FILTER (p = 'medium') AS medium, count(*) FILTER (p = 'low') AS low, sum(greatest(CASE k WHEN 0 THEN 1 ELSE k END - 1, 0)) AS merged_variants, sum(CASE WHEN p = 'low' THEN CASE k WHEN 0 THEN 1 ELSE k END ELSE 0 END) AS low_variants FROM i GROUP BY category)
 SELECT category, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(merged_variants, 0)::BIGINT AS merged_variants, coalesce(low_variants, 0)::BIGINT AS low_variants, coalesce(CASE WHEN n > 0 THEN least(high, 5) + least(medium, 3) END, 0) AS rendered, coalesce(CASE WHEN n > 0 THEN high + medium + low - least(high, 5) - least(medium, 3) END, 0) AS summarised FROM v LEFT JOIN g USING (category)""")
def review_stats(spark, d):
    p, s = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    o = read(spark, d, "orders").select(F.when(s == "F", "visual_design").when(s == "O", "communication_style").alias("category"), F.when(p == "1", "high").when(p == "2", "medium").otherwise("low").alias("priority"), F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("variant_count"))
    return B.review_stats(o, ["communication_style", "visual_design", "product_strategy", "other"])


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS input_ord FROM orders), f AS (SELECT * FROM o WHERE input_ord < 1000)
 SELECT o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, floor(sum(o_totalprice) * 100 + 0.5) / 100 > 20000000 AS over, false AS unlimited FROM f GROUP BY o_orderpriority""")
def first_import(spark, d):
    """The first thousand orders by date as conversations, and whether what they cost is above a cap (0: no cap)."""
    o = placed(read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")]).withColumnRenamed("place", "input_ord")
    g = B.first_conversations(o, 1000).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), (F.floor(F.sum("o_totalprice") * 100 + 0.5) / 100).alias("cost"))
    return g.select("o_orderpriority", "n", "keys", B.over_cap(F.col("cost"), F.lit(20_000_000)).alias("over"), B.over_cap(F.col("cost"), F.lit(0)).alias("unlimited"))


@query("""SELECT o_orderkey, o_orderstatus IN ('F', 'P') AND o_orderdate > DATE '1995-06-01' AS stale FROM orders""")
def stale_checkpoints(spark, d):
    """Orders as attempts after a checkpoint of June 1995: F failed, P running, O succeeded."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    return read(spark, d, "orders").select("o_orderkey", B.stale(F.to_date(F.lit("1995-06-01")), F.col("o_orderdate").cast("date"), status).alias("stale"))


@query("SELECT floor(avg((1 - l_discount)::DOUBLE) * 1000000 + 0.5) / 1000000 AS confidence, max(l_shipdate)::VARCHAR AS latest FROM lineitem")
def extraction_totals(spark, d):
    l = read(spark, d, "lineitem").select((1 - F.col("l_discount")).cast("double").alias("confidence"), F.lit(None).cast("string").alias("updated"), F.lit("").alias("created"), F.col("l_shipdate").cast("string").alias("extracted"))
    return extraction_totals_of(l).withColumn("confidence", F.floor(F.col("confidence") * 1000000 + 0.5) / 1000000)


@query("SELECT l_orderkey AS source, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def source_link_counts(spark, d):
    return link_counts(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), "l_partkey").distinct(), "source")


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'created' WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) <> 1 THEN 'skipped' ELSE 'updated' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY action""")
def write_counts(spark, d):
    """What a write of a note for each document would do where labelled documents have one: toxic ones protected, poor ones not ours."""
    docs, lab = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels")
    old = docs.join(lab, "doc_id").select(F.col("doc_id").cast("string").alias("path"), (F.coalesce("quality", F.lit(1)) == 1).alias("managed"), (F.coalesce("toxic", F.lit(0)) == 1).alias("protected"), F.lit("note").alias("kind"))
    plan = merge_actions(old, docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(False).alias("create_only")))
    s = write_summary(plan)
    return s.select(F.explode(F.create_map(*[x for c in ("created", "updated", "deleted", "skipped") for x in (F.lit(c), F.col(c))])).alias("action", "n")).where("n > 0")


@query("""WITH v AS (SELECT unnest(['durable_project', 'durable_profile', 'tool_workflow', 'writing_workflow', 'transactional_lookup', 'shopping_product_lookup', 'academic_problem', 'other']) AS value),
 c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'tool_workflow' WHEN '2-HIGH' THEN 'durable_project' ELSE 'other' END AS c FROM orders) SELECT value, count(c) AS n FROM v LEFT JOIN c ON value = c GROUP BY value""")
def class_counts(spark, d):
    classes = ["durable_project", "durable_profile", "tool_workflow", "writing_workflow", "transactional_lookup", "shopping_product_lookup", "academic_problem", "other"]
    o = read(spark, d, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "tool_workflow").when(F.col("o_orderpriority") == "2-HIGH", "durable_project").otherwise("other").alias("class"))
    return B.zero_filled(o, "class", classes)


@query("SELECT l_orderkey AS source, coalesce(string_agg(CASE WHEN l_quantity < 10 THEN NULL ELSE l_returnflag || l_linenumber END, ' ' ORDER BY l_linenumber, l_returnflag), '') AS summary, floor(avg((1 - l_discount)::DOUBLE) * 1000000 + 0.5) / 1000000 AS confidence, count(*) AS n_chunks FROM lineitem GROUP BY l_orderkey")
def chunk_merge(spark, d):
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("chunk"), F.when(F.col("l_quantity") < 10, "").otherwise(F.concat("l_returnflag", "l_linenumber")).alias("summary"), (1 - F.col("l_discount")).cast("double").alias("confidence"))
    return B.merged_chunks(c).withColumn("confidence", F.floor(F.col("confidence") * 1000000 + 0.5) / 1000000)


@query("SELECT p_partkey AS source, CASE WHEN contains(p_name, right(p_type, 4)) THEN p_name ELSE p_name || ' ' || right(p_type, 4) END AS summary, greatest(p_size / 100::DOUBLE, 0.25) AS confidence FROM part")
def pass_merge(spark, d):
    p = read(spark, d, "part")
    return B.merged_passes(p.select(F.col("p_partkey").alias("source"), F.col("p_name").alias("summary"), (F.col("p_size") / 100).alias("confidence")), p.select(F.col("p_partkey").alias("source"), F.right("p_type", F.lit(4)).alias("summary"), F.lit(0.25).alias("confidence")))


@query("""SELECT p_partkey AS node, weight FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN 40 WHEN 1 THEN 40 WHEN 2 THEN 20 WHEN 3 THEN 20 ELSE 0 END AS weight FROM part) ORDER BY weight DESC, p_size DESC, p_retailprice DESC, p_brand DESC, node LIMIT 80""")
def synthesis_payload(spark, d):
    k = F.col("p_size") % 5
    n = read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(k == 0, "preference").when(k == 1, "pattern").when(k == 2, "project").when(k == 3, "task").otherwise("topic").alias("type"), F.col("p_size").alias("n_evidence"), F.col("p_retailprice").alias("confidence"), F.col("p_brand").alias("last_seen"))
    return B.synthesis_payload(n).select("node", "weight")


@query(f"""WITH i AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS st, CASE WHEN p_size % 5 = 0 THEN 'lookup_behavior' ELSE 'other' END AS cat, 0.7 + p_size % 3 * 0.1::DOUBLE AS c, p_size % 7 AS ev, p_size % 4 AS src, {STABLE_SQL} AS stab,
 CASE p_partkey % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'supported_inference' END AS inf, CASE p_partkey % 5 WHEN 0 THEN 'topic' WHEN 1 THEN 'agent_instruction' ELSE 'pattern' END AS kind FROM part),
 p AS (SELECT *, {PRIORITY_SQL.format(status="st", sources="src", inference="inf", stability="stab", confidence="c")} AS pr FROM i)
 SELECT p_partkey, pr AS priority, CASE WHEN kind = 'topic' OR st = 'rejected' THEN false WHEN st = 'approved' THEN true WHEN cat = 'lookup_behavior' THEN false
 ELSE pr = 'high' AND coalesce(stab IN ('stable', 'recurring'), false) AND c >= 0.85 AND ev >= 4 AND CASE inf WHEN 'explicit' THEN src >= 2 WHEN 'supported_inference' THEN src >= 3 ELSE false END AND (kind <> 'agent_instruction' OR src >= 2) END AS promoted FROM p""")
def review_promotion(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    status, category = F.when(s % 4 == 0, "approved").when(s % 4 == 1, "rejected").otherwise("pending"), F.when(s % 5 == 0, "lookup_behavior").otherwise("other")
    kind, inference = F.when(k % 5 == 0, "topic").when(k % 5 == 1, "agent_instruction").otherwise("pattern"), F.when(k % 3 == 0, "explicit").when(k % 3 == 1, "supported_inference")
    sure, evidence, sources = F.lit(0.7) + s % 3 * F.lit(0.1), s % 7, s % 4
    priority = B.review_priority(status, inference, stability(s), sure, sources)
    return read(spark, d, "part").select("p_partkey", priority.alias("priority"), B.promoted_after_review(status, category, kind, priority, sure, evidence, sources, stability(s), inference).alias("promoted"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 2 = 0 THEN 100 ELSE 0 END + 10 * coalesce(CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 END, 1) + CASE WHEN p_size > 25 THEN 2 ELSE 1 END + p_size DESC, p_brand DESC NULLS LAST, p_size DESC, p_retailprice DESC, p_partkey) - 1 AS place FROM part""")
def section_places(spark, d):
    """The place of each node in its section: one sort by range, then counts a partition, so no task holds the table."""
    s = F.col("p_size")
    n = read(spark, d, "part").select("p_partkey", F.when(s % 2 == 0, "pattern").otherwise("topic").alias("type"), stability(s).alias("stability"), F.when(s > 25, "explicit").otherwise("supported_inference").alias("inference_level"), F.col("p_brand").alias("last_seen"), s.alias("n_evidence"), F.col("p_retailprice").alias("confidence"))
    return placed(n, [*B.section_order(), F.col("p_partkey")]).select("p_partkey", "place")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END, lower(l), l, p_partkey) - 1 AS place FROM (SELECT *, chr((CASE WHEN p_size % 7 > 2 THEN 97 ELSE 65 END + p_size % 7)::INT) || lpad(p_partkey::VARCHAR, 12, '0') AS l FROM part)""")
def review_places(spark, d):
    """The place of each item in the inbox, labels by the rules of the alphabet: small and capital letters next to each other."""
    s = F.col("p_size")
    label = F.concat(F.char(F.when(s % 7 > 2, 97).otherwise(65) + s % 7), F.format_string("%012d", "p_partkey"))
    n = read(spark, d, "part").select("p_partkey", F.when(s % 3 == 0, "pending").when(s % 3 == 1, "rejected").otherwise("approved").alias("status"), F.when(s % 4 == 0, "high").when(s % 4 == 1, "low").when(s % 4 == 2, "medium").alias("priority"), label.alias("label"))
    return placed(n, [*B.review_order(), F.col("p_partkey")]).select("p_partkey", "place")


@query(f"SELECT p_partkey, (r.place + 1)::INT AS review_place, (s.place + 1)::INT AS section_place FROM ({ORACLE_SQL['review_places']}) r JOIN ({ORACLE_SQL['section_places']}) s USING (p_partkey)")
def render_order(spark, d):
    r, s = review_places(spark, d), section_places(spark, d)
    return r.withColumnRenamed("place", "r").join(s.withColumnRenamed("place", "s"), "p_partkey").select("p_partkey", (F.col("r") + 1).cast("int").alias("review_place"), (F.col("s") + 1).cast("int").alias("section_place"))


def order_items(spark: SparkSession, d: str) -> DataFrame:
    """An item an order line: the part's name as label, its type as summary."""
    kind = F.when(F.col("p_size") % 3 == 0, "topic").when(F.col("p_size") % 3 == 1, "entity").otherwise("preference")
    p = read(spark, d, "part").select("p_partkey", kind.alias("type"), F.initcap("p_name").alias("label"), F.col("p_type").alias("summary"), stability(F.col("p_size")).alias("stability"), F.when(F.col("p_size") > 25, "explicit").otherwise("supported_inference").alias("inference_level"))
    l = read(spark, d, "lineitem").select("l_partkey", F.concat(F.lit("o"), "l_orderkey").alias("source"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.pmod(F.col("l_partkey"), F.lit(100))).alias("ord"), (1 - F.col("l_discount")).cast("double").alias("confidence"), F.concat("l_returnflag", "l_linestatus").alias("quote"), F.col("l_shipdate").cast("string").alias("last_seen"))
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


BUILT: dict[tuple[str, str], Graph] = {}


def built(spark: SparkSession, d: str) -> Graph:
    """The whole build, made once a session and folder: its parts are written tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in BUILT:
        BUILT.clear()
        BUILT[key] = build_graph(order_items(spark, d))
    return BUILT[key]


@query()
def graph_nodes(spark, d):
    """The whole build; its steps are checked with SQL or a plain pass one by one."""
    return built(spark, d).nodes.select("node", "type", "label", "confidence", "rescaled", "n_sources", "n_evidence", "summary", "stability", "inference_level")


@query()
def graph_edges(spark, d):
    return built(spark, d).edges


@query()
def graph_reviews(spark, d):
    return built(spark, d).reviews.select("id", "type", "label", "confidence", "n_sources", "variant_count", "grouped_evidence", "status", "priority", "category")


@query()
def graph_counts(spark, d):
    return built(spark, d).counts


@query()
def seed_survivors(spark, d):
    """Parts as nodes of earlier runs: those with the same tokens are merged into the one with the most evidence."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("seed"), F.lit("topic").alias("type"), F.col("p_name").alias("label"), F.array(F.initcap("p_name")).alias("aliases"), F.col("p_type").alias("summary"), F.col("p_size").alias("n_evidence"), (F.col("p_partkey") % 7).alias("n_sources"), F.col("p_retailprice").alias("confidence"), F.lit(None).cast("array<double>").alias("v"))
    return survivors(p, [*B.seed_order(), F.col("seed")])


@query()
def candidate_match(spark, d):
    """Vectors as candidates and nodes: each is matched with the nodes by key and likeness, the rest among themselves."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("kind"), "label").alias("type"), F.col("embedding").cast("array<double>").alias("v"))
    p = e.join(read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size"), F.col("id") == F.col("p_partkey"), "left").select("id", "type", F.coalesce("p_name", F.concat(F.lit("vector "), "id")).alias("label"), F.coalesce("p_type", F.lit("")).alias("summary"), (F.coalesce("p_size", F.lit(1)) / 50).alias("confidence"), F.lit(1).alias("n_evidence"), F.lit(True).alias("with_alias"), F.lit(True).alias("may_cluster"), "v")
    nodes = p.groupBy("type").agg(F.min(F.struct("id", "label", "summary", "v")).alias("f")).select(F.concat("type", F.lit("_"), "f.id").alias("node"), F.col("f.id").alias("ord"), "type", "f.label", "f.summary", F.array().cast("array<string>").alias("aliases"), "f.v")
    return cascade(nodes, p, 0.5)


@query(f"""WITH t AS (SELECT p_brand AS source, CASE WHEN p_size % 4 = 0 THEN 'style_pattern' WHEN p_size % 4 = 1 THEN 'pattern' ELSE 'preference' END AS kind, p_size % 3 AS second, p_partkey AS ord, p_type AS label, p_name AS summary, p_size / 100::DOUBLE AS conf, {STABLE_SQL} AS st, p_mfgr FROM (SELECT *, p_brand AS p_mfgr FROM part)),
 b AS (SELECT *, CASE WHEN second = 0 THEN 1 WHEN kind = 'style_pattern' THEN 2 ELSE 0 END AS pass, CASE WHEN kind = 'style_pattern' AND second > 0 THEN 'pattern' ELSE kind END AS type FROM t),
 g AS (SELECT source, type, lower(label) AS key, arg_min(label, pass * 100000000 + ord) AS label, max(conf) AS confidence, max(CASE st WHEN 'stable' THEN 4 WHEN 'recurring' THEN 3 WHEN 'situational' THEN 2 WHEN 'temporary' THEN 1 END) AS s, left(string_agg(summary, ' ' ORDER BY pass, ord), 800) AS summary FROM b GROUP BY ALL),
 q AS (SELECT source, type, key, string_agg(summary, '|' ORDER BY r) AS quotes FROM (SELECT *, row_number() OVER (PARTITION BY source, type, key ORDER BY o) AS r FROM (SELECT source, type, lower(label) AS key, summary, min(pass * 100000000 + ord) AS o FROM b GROUP BY ALL)) WHERE r <= 5 GROUP BY ALL)
 SELECT source, type, label, confidence, summary, quotes, CASE s WHEN 4 THEN 'stable' WHEN 3 THEN 'recurring' WHEN 2 THEN 'situational' WHEN 1 THEN 'temporary' END AS stability FROM g JOIN q USING (source, type, key)""")
def merged_extraction(spark, d):
    """Parts as the items of two passes over sources named after brands."""
    s = F.col("p_size")
    p = read(spark, d, "part").select(F.col("p_brand").alias("source"), F.when(s % 4 == 0, "style_pattern").when(s % 4 == 1, "pattern").otherwise("preference").alias("type"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("label"), F.col("p_name").alias("summary"), (s / 100).alias("confidence"), F.array(F.struct(F.col("p_name").alias("quote"), F.lit(0.5).alias("confidence"))).alias("evidence"), stability(s).alias("stability"), F.lit(None).cast("string").alias("inference_level"), F.array("p_brand").alias("applies_to"), F.lit(None).cast("string").alias("agent_instruction"), (s % 3).alias("second"))
    m = B.merged_pass_items(p.where("second > 0").drop("second"), p.where("second = 0").drop("second"))
    return m.select("source", "type", "label", "confidence", "summary", F.array_join(F.transform("evidence", lambda e: e["quote"]), "|").alias("quotes"), "stability")


def order_rows(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as what orders say of parts."""
    none, sure = F.array().cast("array<string>"), (1 - F.col("l_discount")).cast("double")
    source, node, quote = F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("part_"), "l_partkey"), F.concat_ws("-", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    return read(spark, d, "lineitem").select(source.alias("source"), node.alias("node"), F.lit("").alias("label"), (F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("ord"), F.array(source).alias("sources"), none.alias("names"), F.col("l_returnflag").alias("summary"), sure.alias("confidence"), F.array(F.struct(source.alias("source"), quote.alias("quote"), sure.alias("confidence"))).alias("evidence"), F.lit(None).cast("string").alias("stability"), F.lit(None).cast("string").alias("inference_level"), none.alias("applies_to"), F.lit(None).cast("string").alias("agent_instruction"), F.col("l_shipdate").cast("string").alias("last_seen"))


@query("""SELECT 'part_' || l_partkey AS node, count(DISTINCT l_orderkey) AS n_sources, max((1 - l_discount)::DOUBLE) AS confidence, least(count(DISTINCT l_orderkey || ':' || l_linenumber || '-' || l_suppkey || '-' || l_quantity || '-' || l_shipdate), 30)::INT AS n_evidence FROM lineitem GROUP BY l_partkey""")
def incremental_nodes(spark, d):
    """A first import of the orders of all but the last year, then one of all: the second reads and writes only what the new orders touch."""
    rows = order_rows(spark, d)
    state = NodeState(spark, f"{shared_folder(spark).rstrip('/')}/nodes-{uuid4()}", buckets=32)
    state.rebuild(rows.where("last_seen < '1998'"))
    return state.rebuild(rows).nodes.select("node", "n_sources", "confidence", F.size("evidence").alias("n_evidence"))


@query("""WITH e AS (SELECT event_type AS phase, event_id % 5 = 0 AS cached, CASE WHEN event_id % 5 = 0 THEN 0 ELSE floor(value * 100)::BIGINT END AS n, event_id FROM events),
 c AS (SELECT phase, cached, CASE WHEN event_id % 3 = 0 THEN NULL ELSE n END AS i, n // 2 AS o, CASE WHEN event_id % 7 = 0 THEN n + 9 ELSE 0 END AS total, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE n END, 0) / 1e6 * 2.5 + (n // 2) / 1e6 * 15 END AS usd FROM e)
 SELECT phase, count(*) FILTER (NOT cached) AS calls, count(*) FILTER (cached) AS hits, coalesce(sum(i), 0)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, sum(CASE WHEN total <> 0 THEN total ELSE coalesce(i, 0) + o END)::BIGINT AS tokens, floor(sum(usd) * 1000 + 0.5) / 1000 AS usd FROM c GROUP BY ROLLUP (phase)""")
def usage_report(spark, d):
    n = F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.floor(F.col("value") * 100)).cast("long")
    e = read(spark, d, "events").select(F.col("event_type").alias("phase"), F.lit("gpt-5.4").alias("model"), (F.col("event_id") % 5 == 0).alias("cached"), F.when(F.col("event_id") % 3 != 0, n).alias("tokens_in"), F.floor(n / 2).alias("tokens_out"), F.lit(0).cast("long").alias("tokens_embedded"), F.when(F.col("event_id") % 7 == 0, n + 9).otherwise(0).alias("total"), F.when(F.col("event_id") % 4 == 0, 0.5).alias("usd"))
    return TT.usage_totals(e).select("phase", "calls", "hits", F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"), "tokens_out", "tokens", (F.floor(F.col("usd") * 1000 + 0.5) / 1000).alias("usd"))


@query("""WITH n AS (SELECT p_partkey AS node, CASE p_size % 4 WHEN 0 THEN 'topic' WHEN 1 THEN 'entity' WHEN 2 THEN 'preference' ELSE 'task' END AS type, p_size > 25 AS inf FROM part), s AS (SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_discount < 0.02), k AS (SELECT p_partkey AS node FROM part WHERE p_size < 10 UNION SELECT -p_partkey FROM part WHERE p_size = 1)
 SELECT count(*) AS visible, count(*) FILTER (s.node IS NULL) AS isolated, count(*) FILTER (type = 'preference') AS self_model, count(*) FILTER (inf) AS inferred, count(*) FILTER (type IN ('topic', 'entity')) AS nouns, count(*) FILTER (k.node IS NOT NULL) AS seeded, (SELECT count(*) FROM k) - count(*) FILTER (k.node IS NOT NULL) AS unmatched_seeds,
 floor(count(*) FILTER (type IN ('topic', 'entity'))::DOUBLE / count(*) FILTER (type = 'preference') * 100 + 0.5) / 100 AS ratio FROM n LEFT JOIN s ON n.node = s.node LEFT JOIN k ON n.node = k.node""")
def graph_report(spark, d):
    k = F.col("p_size") % 4
    p = read(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), F.when(k == 0, "topic").when(k == 1, "entity").when(k == 2, "preference").otherwise("task").alias("type"), F.when(F.col("p_size") > 25, "supported_inference").otherwise("explicit").alias("inference_level"))
    linked = read(spark, d, "lineitem").where("l_discount < 0.02").select(F.col("l_partkey").alias("node"))
    seeds = p.where("p_size < 10").select(F.col("p_partkey").alias("node")).union(p.where("p_size = 1").select(-F.col("p_partkey")))
    return TT.graph_totals(nodes, linked, B.SELF_MODEL, seeds)


@query("""WITH e AS (SELECT l_partkey AS node, 'o' || l_orderkey AS source, l_linenumber || '-' || l_suppkey || '-' || l_quantity || '-' || l_shipdate AS quote, min(l_discount) AS x FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY x, source, quote) AS r FROM e),
 l AS (SELECT DISTINCT l_partkey AS node, 'o' || l_orderkey AS source FROM lineitem), f AS (SELECT node, source, string_agg(quote, ';' ORDER BY r) FILTER (k <= 3) AS quotes FROM (SELECT *, row_number() OVER (PARTITION BY node, source ORDER BY r) AS k FROM r WHERE r <= 30) GROUP BY ALL)
 SELECT l.source, l.node, p_size / 100::DOUBLE AS confidence, coalesce(quotes, '') AS quotes FROM l JOIN part ON p_partkey = l.node LEFT JOIN f ON l.node = f.node AND l.source = f.source""")
def evidence_edges(spark, d):
    """Edges of orders and parts: a part keeps thirty quotes, an edge the first three of its order."""
    rows = order_rows(spark, d).select(F.substring("node", 6, 99).cast("long").alias("node"), "source", F.col("evidence")[0]["quote"].alias("quote"), F.col("confidence"))
    e = rows.groupBy("node", "source", "quote").agg(F.max("confidence").alias("confidence"))
    e = B.in_order(B.ranked(e.withColumn("e", F.struct("source", "quote", "confidence")), ["node"], [F.desc("confidence"), F.col("source"), F.col("quote")], 30), ["node"], "e", "evidence")
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 100).alias("confidence")).join(e, "node")
    return TT.evidence_edges(rows, nodes).select("source", "node", "confidence", F.array_join(F.transform("evidence", lambda x: x["quote"]), ";").alias("quotes"))


@query(f"""WITH i AS (SELECT l_orderkey AS source, 'topic' AS type, p_name AS label, 1 - l_discount AS c, l_linenumber AS ord, l_partkey, l_suppkey, {slug_sql('p_name')} AS slug, p_size FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT DISTINCT source, slug FROM i WHERE p_size > 25),
 r AS (SELECT i.*, row_number() OVER (PARTITION BY source ORDER BY c DESC, ord, l_partkey, l_suppkey) AS rank FROM i ANTI JOIN n ON i.source = n.source AND i.slug = n.slug) SELECT source, label, ord, rank::INT AS rank FROM r WHERE rank <= 8""")
def source_only_items(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("label"), "p_size")
    i = read(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("source"), F.lit("topic").alias("type"), F.concat("label", F.lit(" (chunk 2)")).alias("label"), (1 - F.col("l_discount")).alias("confidence"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.col("label").alias("plain"), "p_size")
    names = i.where("p_size > 25").select("source", "type", T.slug(F.col("plain")).alias("slug"))
    return TT.source_only(i, names).select("source", F.col("plain").alias("label"), F.col("ord.l_linenumber").alias("ord"), "rank")


@query(r"""SELECT 'conv-' || conv_id AS source_id, md5('Title: Talk ' || conv_id || chr(10) || 'Source ID: conv-' || conv_id || chr(10) || 'Updated: 2024' || chr(10) || chr(10) || 'Transcript:' || chr(10) || CASE WHEN length(t) <= 900 THEN t ELSE regexp_replace(left(t, 885), '\s+$', '') || chr(10) || chr(10) || '[truncated]' END) AS prompt
 FROM (SELECT conv_id, string_agg('### ' || role || '/A' || turn || ' 2024' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""")
def conversation_prompts(spark, d):
    shown = TT.shown_turn(F.col("role"), F.col("text"), F.concat(F.lit("A"), "turn"), F.lit("2024"))
    t = TT.transcripts(read(spark, d, "conversations").select("conv_id", F.concat(F.lit("conv-"), "conv_id").alias("source_id"), F.col("turn").alias("turn_ord"), shown.alias("shown")))
    whole = TT.prompt(F.concat(F.lit("Talk "), F.substring("source_id", 6, 99)), F.col("source_id"), F.lit(""), F.lit("2024"), F.col("transcript"), 900)
    return t.select("source_id", F.md5(whole).alias("prompt"))
