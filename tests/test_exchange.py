"""Readers, renderers, clusterings, state and the continuous import on small rows."""

import json
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.functions import render as R
from skein.operators import clustering as C
from skein.operators import graph as G
from skein.operators import state as S
from skein.sources import exports, notes
from skein.streaming.imports import arriving, cached, import_stream
from skein.streaming.progress import listen
from skein.streaming.progress import rows as progress_rows

SPOKEN = {"author": {"role": "user"}, "create_time": 2.5, "content": {"parts": ["  hello ", "", {"k": 1}]}}


def archive(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, value in entries.items():
            z.writestr(name, value if isinstance(value, str) else json.dumps(value))


def test_archive_to_turns(spark, tmp_path):
    one = {"title": " ", "id": "", "mapping": {"n1": {"message": SPOKEN}, "n2": {"message": None}, "n3": {"message": {"author": {"role": "robot"}, "create_time": 1, "content": {"text": "first"}}}, "n0": {"message": {"content": {"text": "no time"}}}}}
    silent = {"id": "quiet", "mapping": {"x": {"message": {"content": {"parts": [" "]}}}}}
    archive(tmp_path / "a.zip", {"in/conversations-2.json": [silent, one], "other.json": "nonsense"})
    raw = exports.read_archives(spark, str(tmp_path / "a.zip"))
    rows = exports.turns(raw).orderBy("turn_ord").collect()
    assert [(r.role, r.text, r.create_time) for r in rows] == [("unknown", "first", "1970-01-01T00:00:01.000Z"), ("user", 'hello \n\n{"k":1}', "1970-01-01T00:00:02.500Z"), ("unknown", "no time", None)]
    got = exports.conversations(raw).collect()
    assert [(r.title, r.raw_message_count) for r in got] == [("Untitled ChatGPT Conversation 2", 4)]
    assert got[0].source_id.startswith("chatgpt-")


@pytest.mark.parametrize("text", ["{}", "[1, 2", "[{]"])
def test_malformed_entries_are_named(spark, tmp_path, text):
    archive(tmp_path / "b.zip", {"conversations.json": text})
    with pytest.raises(Exception, match="conversations.json"):
        exports.read_archives(spark, str(tmp_path / "b.zip")).collect()


def test_notes_from_files(spark, tmp_path):
    (tmp_path / "Topics").mkdir()
    (tmp_path / "s.md").write_text('---\nskein_type: "source_conversation"\nskein_managed: true\nskein_source_id: "conv-1"\n---\n# A\n')
    (tmp_path / "Topics" / "t.md").write_text('---\nskein_type: "topic"\nskein_managed: true\nskein_aliases:\n  - "One \\"two\\""\n  - three\nskein_confidence: 0.9\n---\n# Topic: Name\n\n## Summary\nWhat it is.\n\n## Evidence\n- [[S/s#x|A title]] (0.8): "a quote"\n- Plain (S/p.md) (0.7): "b"\nnot a line\n\n## Related Context\n- x\n')
    (tmp_path / "mine.md").write_text("# My own note\n")
    s = notes.node_seeds(notes.read_notes(spark, str(tmp_path))).collect()
    assert len(s) == 1
    r = s[0]
    assert (r.label, r.aliases, r.confidence, r.summary) == ("Name", ['One "two"', "three"], 0.9, "What it is.")
    assert [(e.title, e.path, e.confidence, e.quote) for e in r.evidence] == [("A title", "S/s", 0.8, "a quote"), ("Plain", "S/p.md", 0.7, "b")]
    table = spark.createDataFrame([("S/s.md", '---\nskein_type: "source_conversation"\nskein_managed: true\nskein_source_id: "conv-1"\n---\n')], "path string, content string")
    known = notes.node_seeds(notes.read_notes(spark, str(tmp_path)).union(table)).first()
    assert known.source_ids[0] == "conv-1" and known.source_ids[1].startswith("seed_")


def test_product_lists_become_names(spark):
    text = 'See [[turn0product1 {"title": "Red Shoe", "name":"turn0product9"}]] and [[product_entity]] ![i](u) [1:2] [[Link]]'
    out = spark.createDataFrame([(text,)], ["x"]).select(R.cleaned(F.col("x")).alias("c")).first().c
    assert out == "See Red Shoe and [product list omitted] [\\[Link\\]]"


def test_leaders_are_those_of_a_sequential_pass(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (40, 60), (60, 400)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))): rng.randint(1, 9) for _ in range(m)} if n > 1 else {}
        near = {}
        for (a, b), w in pairs.items():
            near.setdefault(b, {})[a] = w
        want = {}
        for i in range(n):
            mine = {a: w for a, w in near.get(i, {}).items() if want[a] == a}
            want[i] = min(mine, key=lambda a: (-mine[a], a)) if mine else i
        nodes = spark.range(n).select("id", F.col("id").alias("ord"))
        edges = spark.createDataFrame([(b, a, float(w)) for (a, b), w in pairs.items()], "a long, b long, weight double")
        assert {r.id: r.leader for r in C.leader_clusters(nodes, edges).collect()} == want


def test_groups_merge(spark):
    items = spark.createDataFrame([(1, "a", 0.7, "pending", "low", 2), (2, "b", 0.9, "approved", "high", 3), (3, "a", 0.8, "rejected", "medium", 1)], "id long, label string, confidence double, status string, priority string, evidence long")
    r = C.merged_groups(items, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, leader long")).first()
    assert (r.label, r.aliases, r.n_items, r.evidence, r.status, r.priority) == ("b", "a", 3, 6, "rejected", "high")


def test_cache_split_and_next_notes(spark):
    hit, miss = S.cache_split(spark.createDataFrame([("k1",), ("k2",), ("k3",)], ["key"]), spark.createDataFrame([("k1", "v"), ("k2", None)], "key string, value string"))
    assert [tuple(r) for r in hit.collect()] == [("k1", "v")]
    assert sorted(r.key for r in miss.collect()) == ["k2", "k3"]
    ex = spark.createDataFrame([("a", "old", True, False, "note"), ("gone", "x", True, False, "note"), ("mine", "x", False, False, "note")], "path string, content string, managed boolean, protected boolean, kind string")
    dr = spark.createDataFrame([("a", "new", False, "note"), ("b", "b", False, "note"), ("mine", "y", False, "note")], "path string, content string, create_only boolean, kind string")
    assert {r.path: r.content for r in S.merged_notes(ex, dr).collect()} == {"a": "new", "b": "b", "mine": "x"}


def test_stream_extracts_each_conversation_once(spark, tmp_path):
    def land(k, texts):
        spark.createDataFrame([("a", "e", i, t) for i, t in enumerate(texts)], exports.RAW).write.parquet(str(tmp_path / "in" / str(k)))

    def go():
        stream = arriving(spark, str(tmp_path / "in" / "*"))
        import_stream(stream, lambda df: df.withColumn("value", F.upper("json")), str(tmp_path / "cache"), str(tmp_path / "check")).awaitTermination(120)
        return sorted(r.value for r in cached(spark, str(tmp_path / "cache")).collect())

    land(0, ["x", "y", "x"])
    assert go() == ["X", "Y"]
    land(1, ["y", "z"])
    assert go() == ["X", "Y", "Z"]


def test_progress_is_told_for_each_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", "e", 10 * k + i, f"t{k}{i}") for i in range(k + 1)], "archive string, entry string, input_ord long, json string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    heard = listen(spark, str(tmp_path / "progress"), total=6)
    try:
        import_stream(arriving(spark, str(tmp_path / "in"), 1), lambda df: df.withColumn("value", F.upper("json")), str(tmp_path / "cache"), str(tmp_path / "check")).awaitTermination(120)
        for _ in range(60):
            got = progress_rows(heard).collect()
            if any(r.kind == "ended" for r in got):
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(heard)
    batches = sorted((r.batch, r.completed) for r in got if r.kind == "batch" and r.duration_ms is not None)
    assert {r.total for r in got} == {6} and max(c for _, c in batches) == 6 and len({b for b, _ in batches}) >= 3
    assert {r.kind for r in got} == {"started", "batch", "ended"}


def test_equal_sets_stand_by_their_first(spark):
    rng = random.Random(8)
    for words, most, n in ((4, 2, 120), (6, 4, 90)):
        sets = [(k, rng.choice("ab"), rng.sample("uvwxyz"[:words], rng.randint(1, most))) for k in range(n)]
        df = spark.createDataFrame(sets, "id long, type string, tokens array<string>").cache()
        every, few = G.similar_sets(df).cache(), G.similar_classes(df).collect()
        first = {r.id: r.first for r in G.set_classes(df).select("id", F.col("first")).collect()}
        # each link of the pairwise join follows from the classes, and nothing else does; copies are not paired with each other
        links = {(r.a, r.b) for r in few}
        up = lambda a, b: (first[a], first[b]) if first[a] < first[b] else (first[b], first[a])
        want = {(r.a, r.b) for r in every.collect()}
        assert want == {(a, b) for a in first for b in first if a < b and (first[a] == first[b] or up(a, b) in links)}
        assert sum(first[r.b] == r.a for r in few) == len(first) - len(set(first.values())) and len(few) < len(want)
        nodes = df.select("id", F.col("id").alias("ord"))
        weighed = every.select("a", "b", (F.col("n_shared") / F.col("n_all")).alias("weight"))
        classes = G.set_classes(df)
        firsts = classes.where("id = first").select("id", "type", F.col("toks").alias("tokens"))
        pairs = G.similar_sets(firsts).select("a", "b", (F.col("n_shared") / F.col("n_all")).alias("weight"))
        got = C.leader_clusters_of_classes(nodes, classes.select("id", "first"), pairs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.leader_clusters(nodes, weighed).collect()))
