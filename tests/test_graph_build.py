"""The graph build and its steps on small rows: what each must give is written out."""

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import build as B
from skein.operators.common import coded, cut, once_each
from skein.operators.graph import cooccurrence
from skein.operators.review import compacted, same_items
from skein.operators.seeds import survivors
from skein.plans.graph_build import build_graph, completed, source_classes

ITEM = "source string, title string, type string, ord long, label string, summary string, confidence double, evidence array<struct<quote:string,confidence:double>>, stability string, inference_level string, applies_to array<string>, agent_instruction string, last_seen string"


def item(source, title, kind, ord_, label, confidence, quotes, stability=None, inference=None, summary="s", applies=(), told=None):
    return (source, title, kind, ord_, label, summary, confidence, [(q, c) for q, c in quotes], stability, inference, list(applies), told, f"2024-01-{ord_ % 28 + 1:02d}")


CONCISE = ["Concise copy preference", "Prefers short useful answers", "Brevity with dense responses"]
ROWS = [
    item("a", "A", "topic", 1, "Semantic topic", 0.82, [("qa", 0.9)]),
    item("b", "B", "topic", 2, "Semantic topic (chunk 2)", 0.81, [("qb", 0.7)]),
    item("c", "C", "topic", 3, "One-off topic", 0.82, [("qc", 0.8)]),
    item("p", "UX references", "pattern", 4, "Reference-driven UX design", 0.78, [("p1", 0.78)], "recurring", "supported_inference", "Draws mechanics from proven apps."),
    *[item(f"k{i}", f"Output style {i}", "preference", 10 + i, x, 0.88, [(f"one {i}", 0.88), (f"two {i}", 0.87)], "recurring", "supported_inference", "Prefers concise, high-density communication.", ["communication", "writing"], "Keep responses concise.") for i, x in enumerate(CONCISE)],
    item("i", "Output style", "agent_instruction", 20, "Be concise and directly useful", 0.97, [("be concise", 0.97)], "stable", "explicit", "Asks for concise useful output.", ["writing"], "Keep answers concise."),
    item("j", "Output schema", "preference", 21, "JSON over prose for model outputs", 0.97, [("JSON", 0.97)], "stable", "explicit", "Explicitly prefers JSON."),
    item("s", "Which razor should I buy", "entity", 30, "Gillette Labs", 0.96, [("razor price", 0.9)]),
    item("s", "Which razor should I buy", "topic", 31, "Semantic topic", 0.9, [("late", 0.5)]),
    item("n", "Notes", "entity", 40, "Acme Corp", 0.72, [("acme", 0.7)]),
    item("n", "Notes", "project", 41, "Homework app", 0.99, [("x", 0.9)], summary="a class assignment"),
    item("r", "Notes", "preference", 50, "Never call me", 0.99, [("no", 0.9)], "stable", "explicit"),
]
REVIEW = "id string, type string, label string, aliases array<string>, variants array<string>, summary string, confidence double, evidence array<struct<source:string,quote:string,confidence:double>>, sources array<string>, n_sources long, variant_count long, grouped_evidence long, stability string, inference_level string, applies_to array<string>, agent_instruction string, last_seen string, status string, priority string, category string"


def review(status, label, sources, category="other", **more):
    row = dict(id=f"review_preference_{label}", type="preference", label=label, aliases=[], variants=[], summary="s", confidence=0.9, evidence=[(s, f"{label} {s}", 0.9) for s in sources], sources=sources, n_sources=len(sources), variant_count=1, grouped_evidence=2 * len(sources), stability="recurring", inference_level="supported_inference", applies_to=[], agent_instruction=None, last_seen=None, status=status, priority="high", category=category)
    return tuple((row | more)[c.split()[0]] for c in REVIEW.replace("struct<source:string,quote:string,confidence:double>", "x").split(", "))


@pytest.fixture(scope="module")
def graph(spark):
    reviews = [review("rejected", "Never call me", ["z"]), review("pending", "Product lookup style", ["l1", "l2", "l3"], "lookup_behavior"), review("approved", "Window seats", ["w1"])]
    g = build_graph(spark.createDataFrame(ROWS, ITEM), reviews=spark.createDataFrame(reviews, REVIEW))
    return {n: getattr(g, n).collect() for n in ("nodes", "source_links", "node_links", "edges", "reviews", "classes", "counts")}


def test_what_becomes_a_node(graph):
    nodes = {r.node: r for r in graph["nodes"]}
    assert set(nodes) == {"topic_semantic-topic", "preference_concise-high-density-communication", "preference_json-over-prose-for-model-outputs", "entity_acme-corp", "preference_window-seats"}
    t = nodes["topic_semantic-topic"]
    # the look-up links late; quotes are no surer than their items
    assert (t.label, t.n_sources, t.confidence, [tuple(e) for e in t.evidence]) == ("Semantic topic", 3, 0.9, [("a", "qa", 0.82), ("b", "qb", 0.7), ("s", "late", 0.5)])
    c = nodes["preference_concise-high-density-communication"]
    assert (c.label, c.n_sources, c.n_evidence, set(CONCISE) <= set(c.aliases), c.applies_to) == ("Concise, high-density communication", 3, 6, True, ["communication", "writing"])


def test_what_waits_for_review(graph):
    waiting = {r.label: (r.status, r.priority, r.category) for r in graph["reviews"]}
    assert waiting == {"Reference-driven UX design": ("pending", "low", "visual_design"), "Concise, high-density communication": ("pending", "high", "communication_style"), "Never call me": ("rejected", "low", "other"), "Product lookup style": ("pending", "high", "lookup_behavior")}
    assert {r.type for r in graph["reviews"] if r.label.startswith("Concise")} == {"agent_instruction"}


def test_links_classes_and_counts(graph):
    assert {(r.source, r.node) for r in graph["source_links"] if r.node.startswith(("topic", "entity"))} == {("a", "topic_semantic-topic"), ("b", "topic_semantic-topic"), ("s", "topic_semantic-topic"), ("n", "entity_acme-corp")}
    classes = {r.source: r["class"] for r in graph["classes"]}
    assert (classes["s"], classes["a"], classes["n"]) == ("shopping_product_lookup", "other", "other")
    assert {r.name: r.n for r in graph["counts"]}["promoted_reviews"] == 1
    assert {round(r.rescaled, 2) for r in graph["nodes"] if r.type == "entity"} == {0.85}


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_summaries_fold_as_written(spark):
    long_, more = "x" * 600, "y" * 600
    got = rows(spark, "a string, b string", ("ab", "xaby"), ("xaby", "ab"), ("", "b"), ("a", ""), (long_, more), ("a", "b")).select(T.merged_summary(F.col("a"), F.col("b")).alias("m"), T.joined_text(F.col("a"), F.col("b"), 1000).alias("j")).collect()
    assert [r.m for r in got] == ["xaby", "xaby", "b", "a", (long_ + " " + more)[:900], "a b"]
    assert got[4].j == (long_ + " " + more)[:1000] and got[0].j == "ab xaby"


def test_chunks_and_passes(spark):
    c = B.merged_chunks(rows(spark, "source string, chunk int, summary string, confidence double", ("s", 2, "b", 0.5), ("s", 0, "a", 1.0), ("s", 1, "", 0.6))).collect()
    assert [(r.summary, round(r.confidence, 3), r.n_chunks) for r in c] == [("a b", 0.7, 3)]
    schema = "source string, type string, ord long, label string, summary string, confidence double, evidence array<struct<quote:string,confidence:double>>, stability string, inference_level string, applies_to array<string>, agent_instruction string"
    base = rows(spark, schema, ("s", "pattern", 1, "Tidy", "one", 0.7, [("q", 0.7)], "temporary", None, ["A"], None), ("s", "style_pattern", 2, "tidy", "style", 0.9, [("q", 0.1), ("r", 0.2)], "stable", "explicit", ["a", "b"], "do"), ("s", "topic", 3, "T", "t", 0.5, [], None, None, None, None))
    second = rows(spark, schema, ("s", "pattern", 1, "TIDY", "two", 0.8, [("z", 0.3)], None, "supported_inference", [], ""), ("s", "style_pattern", 2, "Terse", "z", 0.4, [], None, None, [], None), ("s", "topic", 3, "Other", "t", 0.5, [], None, None, None, None))
    got = {(r.type, r.label): r for r in B.merged_pass_items(base, second).collect()}
    assert set(got) == {("pattern", "Tidy"), ("style_pattern", "Terse"), ("topic", "T")}
    p = got["pattern", "Tidy"]
    assert (p.summary, p.confidence, [tuple(e) for e in p.evidence], p.stability, p.inference_level, p.applies_to, p.agent_instruction) == ("one two style", 0.9, [("q", 0.7), ("z", 0.3), ("r", 0.2)], "stable", "explicit", ["A", "b"], "do")


def test_review_rules(spark):
    r = rows(spark, "status string, kind string, category string, stability string, inference string, confidence double, sources int, evidence int",
        ("pending", "pattern", "other", "stable", "explicit", 0.9, 1, 9), ("pending", "pattern", "other", "situational", None, 0.99, 1, 9), ("pending", "pattern", "other", None, None, 0.8, 1, 9), ("rejected", "pattern", "other", "stable", "explicit", 0.99, 5, 9),
        ("pending", "pattern", "other", "recurring", "supported_inference", 0.88, 3, 4), ("pending", "pattern", "other", "recurring", None, 0.88, 9, 9), ("approved", "topic", "other", "stable", "explicit", 0.99, 5, 9), ("approved", "preference", "lookup_behavior", None, None, 0.1, 0, 0), ("pending", "agent_instruction", "lookup_behavior", "recurring", "supported_inference", 0.9, 3, 6))
    c = F.col
    pr = B.review_priority(c("status"), c("inference"), c("stability"), c("confidence"), c("sources"))
    got = r.select(pr.alias("p"), B.promoted_after_review(c("status"), c("category"), c("kind"), pr, c("confidence"), c("evidence"), c("sources"), c("stability"), c("inference")).alias("u")).collect()
    assert [(x.p, x.u) for x in got] == [("high", False), ("low", False), ("medium", False), ("low", False), ("high", True), ("high", False), ("high", False), ("low", True), ("high", False)]


def test_orders(spark):
    n = rows(spark, "node string, type string, stability string, inference_level string, n_evidence int, last_seen string, confidence double", ("a", "topic", "stable", "explicit", 1, None, 0.5), ("b", "topic", None, None, 1, "2024", 0.5), ("c", "pattern", None, None, 0, None, 0.5), ("d", "topic", "temporary", None, 1, "2025", 0.5), ("e", "task", None, None, 1, "2023", 0.9))
    assert [r.node for r in n.orderBy(*B.section_order()).collect()] == ["c", "a", "d", "b", "e"]
    assert [(r.node, r.weight) for r in B.synthesis_payload(n).collect()] == [("c", 40), ("e", 20), ("d", 0), ("b", 0), ("a", 0)]
    assert [r.node for r in n.orderBy(F.collate("node", "UNICODE")).collect()] == list("abcde")
    q = rows(spark, "status string, priority string, label string", ("approved", "high", "a"), ("pending", None, "b"), ("pending", "high", "B"), ("pending", "high", "a"))
    assert [r.label for r in q.orderBy(*B.review_order()).collect()] == ["a", "B", "b", "a"]
    assert [r.source for r in B.latest_sources(rows(spark, "source string, title string, summary string, last_seen string", ("a", "", "", None), ("b", "", "", "2024"), ("c", "", "", "2025")), 2).collect()] == ["c", "b"]


def test_compaction_follows_moving_labels(spark):
    def it(k, label, conf, ev):
        return (k, int(k), "preference", label, [], [], "s", conf, [("s" + k, "q" + k, conf)] * 1, 1, 1, ev, "stable", "explicit", ["x"], None, "2024", "pending", None, "other")

    schema = "id string, ord long, type string, label string, variants array<string>, aliases array<string>, summary string, confidence double, evidence array<struct<source:string,quote:string,confidence:double>>, n_sources long, variant_count long, grouped_evidence long, stability string, inference_level string, applies_to array<string>, agent_instruction string, last_seen string, status string, priority string, category string"
    items = rows(spark, schema, it("1", "Window seats flights", 0.8, 1), it("2", "Window seats trains", 0.9, 2), it("3", "Trains tickets early window", 0.7, 1), it("4", "Bread", 0.9, 1))
    assert {tuple(sorted(r)) for r in same_items(items).collect()} == {("1", "2"), ("2", "3")}
    out, src = compacted(items, rows(spark, "id string, source string", *[(k, "s" + k) for k in "1234"]))
    got = {r.label: r for r in out.collect()}
    assert set(got) == {"Window seats trains", "Bread"}
    w = got["Window seats trains"]
    assert (w.variant_count, w.grouped_evidence, w.n_sources, w.priority, set(w.aliases)) == (3, 4, 3, "high", {"Window seats flights", "Trains tickets early window"})
    assert src.count() == 4


def test_seeds_survive_in_order(spark):
    s = rows(spark, "seed string, type string, label string, aliases array<string>, summary string, n_evidence int, n_sources int, confidence double, v array<double>", ("a", "topic", "Solar Panel", ["Sun Roof"], "s", 3, 1, 0.9, None), ("b", "topic", "Sun Roof", ["Roof Kit"], "s", 2, 1, 0.9, None), ("c", "topic", "Roof Kit", [], "s", 1, 1, 0.9, None), ("d", "topic", "Wind", [], "s", 9, 1, 0.9, [1.0, 0.0]), ("e", "topic", "Breeze", [], "s", 1, 0, 0.9, [1.0, 0.001]))
    got = {r.seed: (r.place, r.survivor) for r in survivors(s, [*B.seed_order(), F.col("seed")]).collect()}
    assert got == {"d": (0, "d"), "a": (1, "a"), "b": (2, "a"), "c": (3, "a"), "e": (4, "d")}


def test_sanitised_items(spark):
    schema = "label string, summary string, quote string, confidence double, stability string, inference_level string, applies_to array<string>"
    got = B.sanitised(spark.createDataFrame([(" a ", "b", "c", 1.7, "stable", "odd", [" x ", "", "y"]), ("", "b", "c", 0.5, None, None, []), ("a", "b", "c", float("nan"), "odd", "explicit", None)], schema)).collect()
    assert [(r.label, r.confidence, r.stability, r.inference_level, r.applies_to) for r in got] == [("a", 1.0, "stable", None, ["x", "y"]), ("a", 0.0, None, "explicit", None)]


def test_facts_of_repeated_texts_are_worked_out_once(spark):
    df = rows(spark, "k int, a string, q array<string>", (1, "x", ["b"]), (2, "x", ["b"]), (3, None, None), (4, None, None), (5, "y", [])).withColumn("n", F.lit(0))
    facts = {"n": F.length("a"), "m": F.coalesce(F.size("q"), F.lit(-1))}
    once, plain = once_each(df, ["a", "q"], facts), once_each(df, ["a", "q"], facts, most=0)
    assert sorted(map(tuple, once.select("k", "n", "m").collect())) == sorted(map(tuple, plain.select("k", "n", "m").collect())) and once.count() == 5
    # written by columns: a reader of one column does not read the others
    assert cut(df).select("k").columns == ["k"] and all(f.endswith(".parquet") for f in cut(df).inputFiles())


def test_a_number_stands_for_repeated_columns(spark):
    df = rows(spark, "k int, a string, q array<string>", (1, "x", ["b"]), (2, "x", ["b"]), (3, None, None), (4, None, None), (5, "y", [None]))
    for most in (100, 0):
        narrow, back = coded(df, ["a", "q"], most)
        assert ("a" in narrow.columns) == (most == 0)
        assert sorted(map(str, back(narrow.repartition(3, "k")).select("k", "a", "q").collect())) == sorted(map(str, df.collect()))


def test_labels_are_read_once_and_rows_keep_what_they_are_judged_by(spark):
    df = rows(spark, "k int, a string, q array<string>", (1, "x", ["b"]), (2, "x", ["b"]), (3, None, None), (4, None, None), (5, "yy", [])).withColumn("more", F.col("k") * 2)
    told = lambda d: d.withColumns({"a": F.upper("a"), "was": F.col("a"), "n": F.coalesce(F.length("a"), F.lit(-1))}).drop("q")
    out = []
    for most in (100, 0):
        narrow, back = coded(df, ["a", "q"], most, told, ["n"])
        assert {"k", "more", "n"} <= set(narrow.columns) and ("was" in narrow.columns) == (most == 0)
        out.append(sorted(map(str, back(narrow.where("n <> 2").repartition(3, "k")).select("k", "more", "n", "a", "was").collect())))
    assert out[0] == out[1] and len(out[0]) == 4


def test_a_sources_facts_are_gathered_in_one_number(spark):
    items = spark.createDataFrame(ROWS, ITEM)
    plan = source_classes(completed(items))._jdf.queryExecution().executedPlan().toString()
    assert "bit_or(facts" in plan and "max(p0" not in plan
    clusters = completed(items).withColumn("cluster", F.col("ord") % 3)
    told = lambda d: sorted(map(str, d.collect()))
    assert told(B.review_items(clusters, clusters.select("cluster", "source").distinct())) == told(B.review_items(clusters))


def test_pairs_of_few_nodes_are_the_same_by_either_way(spark):
    links = rows(spark, "s int, n string, kind string, c double", *[(s, f"n{(s * 7 + j * j) % 9}", "ab"[(s * 7 + j * j) % 9 % 2], (s * 7 + j * j) % 9 / 10) for s in range(60) for j in range(3)]).distinct()
    plain, few = cooccurrence(links, "s", "n", "kind", ["c"], 2), cooccurrence(links, "s", "n", "kind", ["c"], 2, 180, 9)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, few.collect())) and plain.count()
