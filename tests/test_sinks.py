"""Notes as drafts and files, reports, and stored settings and states of older versions."""

import json

import pytest
from pyspark.sql import functions as F

from skein import settings as S
from skein.operators.graph import merge_actions
from skein.sinks import notes as N
from skein.sinks import paths
from skein.sinks.files import guarded_path, write_notes
from skein.sinks.report import observed, redacted, report


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


PLAN = "path string, content string, action string"


def test_writer_applies_a_plan(spark, tmp_path):
    root = tmp_path / "vault"
    write_notes(spark, spark.createDataFrame([("Topics/a.md", "A", "create"), ("Topics/deep/er/b.md", "B", "create"), ("c.md", "C", "create"), ("x.md", "no", "skip_protected")], PLAN), str(root))
    assert files(root) == {"Topics/a.md": "A", "Topics/deep/er/b.md": "B", "c.md": "C"}
    (root / "Topics/mine.txt").write_text("kept")
    write_notes(spark, spark.createDataFrame([("Topics/a.md", "A2", "update"), ("Topics/deep/er/b.md", None, "delete"), ("gone.md", None, "delete")], PLAN).repartition(3), str(root))
    assert files(root) == {"Topics/a.md": "A2", "Topics/mine.txt": "kept", "c.md": "C"}
    assert not (root / "Topics/deep").exists() and (root / "Topics").is_dir()
    assert not list(root.glob(".skein-stage*"))


def test_a_failed_task_leaves_the_folder_as_it_was(spark, tmp_path):
    root = tmp_path / "vault"
    write_notes(spark, spark.createDataFrame([("a.md", "A", "create")], PLAN), str(root))
    bad = spark.createDataFrame([("a.md", "changed", "update"), ("b.md", "B", "create"), ("../out.md", "evil", "create")], PLAN).repartition(3)
    with pytest.raises(Exception, match="not a path inside"):
        write_notes(spark, bad, str(root))
    assert files(root) == {"a.md": "A"} and not (tmp_path / "out.md").exists()
    assert not list(root.glob(".skein-stage*"))


@pytest.mark.parametrize("path", ["", None, "/etc/x", "a/../../b", "..", "a/./../b", "C:/x", ".skein-stage-1/x"])
def test_paths_that_leave_the_folder(path):
    with pytest.raises(ValueError, match="not a path inside"):
        guarded_path(path)


def test_path_columns(spark):
    d = spark.createDataFrame([("topic", "What: a/b?", "conv-1")], "kind string, label string, source string")
    r = d.select(paths.node_path(F.col("kind"), F.col("label"), "/Out/").alias("n"), paths.source_path(F.col("label"), F.col("source"), "Out").alias("s"), paths.context_path("Out", True).alias("c"), paths.identity_path("").alias("i"), paths.normal_path(F.lit("\\a//b/")).alias("p"), paths.inside(F.lit("Out/../x"), "Out").alias("no"), paths.inside(F.lit("Out/x"), "Out/").alias("yes"), paths.inside(F.lit("Outer/x"), "Out").alias("near"), paths.stem(F.lit("a/b.MD")).alias("t"), paths.parent(F.lit("a/b/c")).alias("u"), paths.parent(F.lit("c")).alias("v")).first()
    assert r.n == "Out/Topics/What a b.md" and r.s.startswith("Out/Sources/ChatGPT/What a b - ") and r.s.endswith(".md")
    assert tuple(r)[2:] == ("Out/Agent Context/README.md", "Entities/_Me.md", "a/b", False, True, False, "b", "a/b", "")


def test_source_note(spark):
    sources = spark.createDataFrame([("c1", "Panels", "About panels", 0.876, "2024-05-01", "other"), ("c2", "Empty", "", 0.5, None, "other")], "source string, title string, summary string, confidence double, last_seen string, class string")
    links = spark.createDataFrame([("c1", "topic", "topic_solar", 1, "Solar", 0.9, "sum", ["Sun Power"], [("c1", "a quote", 0.8), ("c9", "other", 0.9)])], "source string, type string, node string, rank int, label string, confidence double, summary string, aliases array<string>, evidence array<struct<source:string,quote:string,confidence:double>>")
    items = spark.createDataFrame([("c1", "topic", 1, "sun power (chunk 2)", "s", 0.9, "q"), ("c1", "topic", 2, "Batteries", "store it", 0.8, "we need one"), ("c1", "entity", 3, "Acme", "a firm", 0.7, None)], "source string, type string, ord long, label string, summary string, confidence double, quote string")
    turns = spark.createDataFrame([("c1", 2, "assistant", None, None, "sure"), ("c1", 1, "user", "Al", "2024", "hello [[x]]")], "source string, turn_ord int, role string, author string, at string, text string")
    got = {r.path.split(" - ")[0]: r.content for r in N.source_notes(sources, links, items, turns, "Out").collect()}
    text = got["Out/Sources/ChatGPT/Panels"]
    assert "skein_evidence_count: 1\n" in text and 'skein_topics:\n  - "topic_solar"' in text and "skein_tasks: []" in text and "skein_confidence: 0.88" in text
    assert '### Topics\n- Batteries (0.8): store it Evidence: "we need one"\n\n### Entities\n- Acme (0.7): a firm' in text and "sun power" not in text
    assert "- [[Out/Topics/Solar|Solar]] (0.9): a quote" in text
    assert text.endswith("## Transcript\n### user/Al 2024\nhello [\\[x\\]]\n\n### assistant\nsure")
    assert "No summary extracted." in got["Out/Sources/ChatGPT/Empty"] and "No source-only context retained." in got["Out/Sources/ChatGPT/Empty"]


def test_inbox_sums_up_what_it_does_not_show(spark):
    def it(k, priority, category="other", status="pending", variants=2):
        return (f"i{k}", f"Label {k:02d}", status, priority, category, "preference", 0.9, [], [], "s", variants, [])

    rows = [it(k, "high") for k in range(7)] + [it(20 + k, "medium") for k in range(4)] + [it(30, "low", variants=5), it(40, None, "visual_design"), it(41, "high", "unheard")]
    d = spark.createDataFrame(rows, "id string, label string, status string, priority string, category string, type string, confidence double, aliases array<string>, source_ids array<string>, summary string, variant_count long, evidence array<struct<title:string,path:string,confidence:double,quote:string>>")
    text = N.review_inbox(d, "Out").first().content
    # an unknown category is filed under other
    assert text.index("## Visual Design") < text.index("## Other") and text.count("### Review:") == 5 + 3 + 1
    assert "- **Hidden groups**: 5 (3 high, 1 medium, 1 low).\n- **Hidden variants**: 13." in text
    assert "- **Examples**: Label 05; Label 06; Label 41; Label 23; Label 30." in text
    assert "skein_review_group_count: 9\n" in text and "skein_review_summarized_group_count: 5\n" in text and "skein_review_low_priority_count: 1\n" in text
    empty = N.review_inbox(d.limit(0), "Out").first()
    assert (empty.path, empty.content.endswith("No review items.")) == ("Out/Review Queue.md", True)


def test_pack_identity_and_all_drafts(spark):
    nodes = spark.createDataFrame([("preference", "Short answers", "s", "be short", ["writing"], "stable", "explicit", 3, "2024-01-02T00", 0.9, [("topic", "p.md", "T")]), ("preference", "Long walks", "w", None, [], None, None, 1, None, 0.9, [])], "type string, label string, summary string, agent_instruction string, applies_to array<string>, stability string, inference_level string, n_evidence int, last_seen string, confidence double, related array<struct<type:string,path:string,label:string>>")
    sources = spark.createDataFrame([("a", "A", "sa", "2024-01-01"), ("b", "B", "sb", "2025-01-01"), ("c", "C", "sc", None)], "source string, title string, summary string, last_seen string")
    d = N.all_drafts(N.identity_note(spark, "Out"), N.context_pack(nodes, sources, "Out"), N.identity_note(spark, "Out"))
    got = {r.path: r for r in d.collect()}
    assert len(got) == 14 and got["Out/Entities/_Me.md"].create_only and "skein_protected: true" in got["Out/Entities/_Me.md"].content
    p = got["Out/Agent Context/04 Preferences.md"].content
    assert p.index("### Short answers (Out/Preferences/Short answers.md) _(2024-01-02)_\ns\n\n**Agent instruction:** be short\n\n**Applies to:** writing\n\n**Related:**\n- Topics: T (p.md)") < p.index("### Long walks")
    s = got["Out/Agent Context/11 Sources.md"].content
    assert s.index("B (Out") < s.index("A (Out") < s.index("C (Out") and "None extracted yet." in got["Out/Agent Context/07 Tasks.md"].content
    assert got["Out/Agent Context/README.md"].content.count("\n- ") == 12


def test_report_counts_what_the_write_did(spark, tmp_path):
    old = spark.createDataFrame([("a.md", True, False, "node"), ("b.md", True, False, "node"), ("mine.md", False, False, "node")], "path string, managed boolean, protected boolean, kind string")
    new = spark.createDataFrame([("a.md", False, "A"), ("n.md", False, "N"), ("mine.md", False, "M")], "path string, create_only boolean, content string")
    plan = merge_actions(old, new.drop("content")).join(new.select("path", "content"), "path", "left")
    o = observed(plan)
    write_notes(spark, o.rows, str(tmp_path / "vault"))
    r = report(spark, "2024-01-01T00:00:00Z", 3, {"openAiApiKey": "sk-secret", "x": 1}, {"nodes": 2}, o.seen).first()
    counts = {a.action: a["count"] for a in plan.groupBy("action").count().collect()}
    assert r.wrote == {"created": counts["create"], "updated": counts["update"], "deleted": counts["delete"], "skipped": counts["skip_unmanaged"], "notes": 4}
    assert "sk-secret" not in r.settings and json.loads(r.settings)["openAiApiKey"] == "[redacted]" and r.import_id.startswith("import_")
    assert redacted({"openAiApiKey": ""}) == {"openAiApiKey": ""}


def test_settings_of_older_versions():
    assert S.read_settings(None) == S.read_settings("[1]") == S.read_settings("{") == S.DEFAULTS
    one = S.migrated({"confidenceThreshold": 0.5, "maxSimilarityLinksPerType": 9, "agentContextSections": True, "other": 1})
    assert (one["confidenceThreshold"], one["maxSimilarityLinksPerType"], one["agentContextSections"], one["other"]) == (0.78, 2, False, 1)
    two = S.migrated({"visualGraphDefaultsVersion": 2, "maxSimilarityLinksPerType": 9, "singleSourcePromotionThreshold": 0.5, "minimumCanonicalSources": 0, "maxSourceLinksPerType": -3, "confidenceThreshold": 0.97})
    assert (two["maxSimilarityLinksPerType"], two["singleSourcePromotionThreshold"], two["minimumCanonicalSources"], two["maxSourceLinksPerType"]) == (9, 0.97, 1, 1)
    three = S.migrated({"singleSourcePromotionThreshold": 0.8, "rememberOpenAiApiKey": None})
    assert (three["singleSourcePromotionThreshold"], three["rememberOpenAiApiKey"]) == (0.94, False)
    assert S.for_storage(three | {"openAiApiKey": "k"})["openAiApiKey"] == "" and S.for_storage(three | {"openAiApiKey": "k", "rememberOpenAiApiKey": True})["openAiApiKey"] == "k"


def test_states_of_older_versions(spark):
    runs = spark.createDataFrame([("a", json.dumps({"lastImportPhase": "extracting", "lastImportStatus": "odd", "lastImportDurationMs": 12, "lastImportTotal": 3})), ("b", "{not json"), ("c", json.dumps({"lastImportPhase": "dreaming", "lastImportDurationMs": "x", "lastImportStatus": "failed"})), ("d", None)], "run string, json string")
    got = {r.run: (r.phase, r.status, r.duration_ms) for r in S.run_states(runs).collect()}
    assert got == {"a": ("extracting", None, 12), "b": (None, None, None), "c": (None, "failed", None), "d": (None, None, None)}
    old = {"importId": "i1", "report": {"x": 1}, "conversations": [{"sourceId": "s1", "title": "", "createTime": "2024"}, {"sourceId": "s2", "title": "T"}], "graph": {"sourcePathsById": {"s1": "p1"}}}
    new = {"report": {}, "sourceManifest": [{"sourceId": "s3", "title": "N", "path": "p3"}]}
    c = spark.createDataFrame([(json.dumps(x),) for x in (old, new, {"conversations": []}, [])] + [("zzz",), (None,)], "json string")
    got = sorted(tuple(r) for r in S.source_manifests(c).fillna("-").collect())
    assert got == [("i1", "s1", "Untitled conversation", "p1", "2024", "-"), ("i1", "s2", "T", "", "-", "-"), ("legacy_import", "s3", "N", "p3", "-", "-")]


def test_agent_context_is_one_note(spark):
    nodes = spark.createDataFrame([("topic", f"T{k:02d}", "about", 0.5 + k / 100, [("s", f"q{k}", 0.5)]) for k in range(25)] + [("task", "Do it", "now", 0.9, [])], "type string, label string, summary string, confidence double, evidence array<struct<source:string,quote:string,confidence:double>>")
    sources = spark.createDataFrame([(f"s{k}", f"S{k}", f"sum {k // 2}", 0.1 * k, f"2024-0{k + 1}", k) for k in range(8)], "source string, title string, summary string, confidence double, last_seen string, input_ord int")
    text = N.agent_context(nodes, sources, nodes.limit(3), "Out").first().content
    assert text.count("\n- T") == 20 and "- T24 (Out/Topics/T24.md) (0.74, 1 evidence item): about Evidence: \"q24\"" in text and "T04 (" not in text
    assert "## Profile Summary\n- sum 3\n- sum 2\n- sum 1\n- sum 0\n" in text and "## Entities\nNone extracted yet." in text and "- Do it (Out/Tasks/Do it.md) (0.9, 0 evidence items): now" in text
    assert "skein_evidence_count: 3\n" in text and 'skein_last_seen: "2024-08"' in text and text.index("S0 (Out") < text.index("S7 (Out")
    assert "## Profile Summary\nmine\n" in N.agent_context(nodes, sources, nodes, "Out", " mine ").first().content


def test_notes_of_the_last_run_are_seeds_and_decisions(spark):
    from skein.plans.rerun import previous

    legacy = "---\nskein_managed: true\nskein_type: review_item\nskein_target_type: preference\nskein_review_status: rejected\nskein_confidence: 0.8\n---\n# Review: Never call me\n\n## Summary\nno calls\n"
    node = spark.createDataFrame([("topic", "topic_solar-grid", "Solar Grid", 0.9, "2023", ["Sun Net"], ["old"], "kept words", "stable", None, [], None, [("Old talk", "Out/Sources/old.md", 0.9, "seen before")], [])], "type string, id string, label string, confidence double, last_seen string, aliases array<string>, source_ids array<string>, summary string, stability string, inference_level string, applies_to array<string>, agent_instruction string, evidence array<struct<title:string,path:string,confidence:double,quote:string>>, related array<struct<type:string,path:string,label:string>>")
    notes = N.node_notes(node, "Out").select("path", "content").union(spark.createDataFrame([("Out/Review/x.md", legacy), ("Out/free.md", "# not ours")], "path string, content string"))
    seeds, reviews = previous(notes)
    assert [(r.label, r.aliases, r.sources[0]) for r in seeds.collect()] == [("Solar Grid", ["Sun Net"], "old")] and [(r.label, r.status) for r in reviews.collect()] == [("Never call me", "rejected")]
