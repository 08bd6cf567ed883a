"""Rebuilding what changed gives what a full build gives, and leaves the rest unread and unwritten."""

from pyspark.sql import functions as F

from skein.operators.build import accumulated
from skein.operators.incremental import NodeState

ROW = "source string, node string, label string, ord long, sources array<string>, names array<string>, summary string, confidence double, evidence array<struct<source:string,quote:string,confidence:double>>, stability string, inference_level string, applies_to array<string>, agent_instruction string, last_seen string"


def row(source, node, ord_, confidence=0.9, name="x"):
    return (source, node, node.title(), ord_, [source], [name], f"about {name}", confidence, [(source, f"q{ord_}", confidence)], "stable", None, [], None, f"2024-{ord_:04d}")


def told(df):
    cols = sorted(c for c in df.columns if c not in ("bucket", "label"))
    return sorted(map(str, (tuple(r) for r in df.select(cols).collect())))


def full(df):
    return told(accumulated(df, df.groupBy("node").agg(F.min_by("label", "ord").alias("label"))))


def test_rebuild_equals_a_full_build(spark, tmp_path):
    state = NodeState(spark, str(tmp_path / "state"), buckets=8)
    assert state.nodes() is None
    rows = [row(f"s{k}", f"n{k % 20}", k, 0.5 + k % 5 / 10, f"name {k % 7}") for k in range(60)]
    first = state.rebuild(spark.createDataFrame(rows, ROW))
    assert (first.version, first.changed_sources, first.touched_nodes) == (1, 60, 20) and told(first.nodes) == full(spark.createDataFrame(rows, ROW))
    # one source more, one changed, one gone, one moved to a new node; the others in another order
    later = [r for r in rows if r[0] not in ("s3", "s4", "s5")] + [row("s4", "n4", 4, 0.99), row("s5", "new", 5), row("s99", "n1", 99)]
    again = state.rebuild(spark.createDataFrame(later[::-1], ROW))
    assert (again.version, again.changed_sources, again.touched_nodes) == (2, 4, 5) and told(again.nodes) == full(spark.createDataFrame(later, ROW))
    assert again.written_buckets != list(range(8))
    left = {p.name for p in (tmp_path / "state" / "nodes" / "v=2").iterdir() if p.name.startswith("bucket=")}
    assert left == {f"bucket={b}" for b in again.written_buckets}
    assert told(state.nodes()) == told(again.nodes)
    same = state.rebuild(spark.createDataFrame(later, ROW))
    assert (same.changed_sources, same.touched_nodes, same.written_buckets) == (0, 0, []) and told(same.nodes) == told(again.nodes)


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    state = NodeState(spark, str(tmp_path / "state"), buckets=4)
    rows = [row("s1", "a", 1), row("s2", "b", 2)]
    state.rebuild(spark.createDataFrame(rows, ROW))
    (tmp_path / "state" / "nodes" / "v=2").mkdir()  # as a lost run would leave it
    (tmp_path / "state" / "nodes" / "v=2" / "part-0.parquet").write_bytes(b"half a file")
    assert state.version() == 1 and state.nodes().count() == 2
    assert state.rebuild(spark.createDataFrame([*rows, row("s3", "a", 3)], ROW)).nodes.count() == 2
    assert state.version() == 2


def test_rows_of_changed_sources_by_bits(spark, tmp_path):
    rows = [row(f"s{k}", f"n{k % 6}", k) for k in range(40)]
    rows[7] = (*rows[7][:4], ["s7", "s8"], *rows[7][5:])  # names another source
    rows[8] = (*rows[8][:8], [(None, "q", None)], *rows[8][9:])
    for most in (4, 30):  # changed sources are the fewer, and the more
        state = NodeState(spark, str(tmp_path / f"few{most}"), buckets=4, few=0)
        first = state.rebuild(spark.createDataFrame(rows, ROW))
        assert told(first.nodes) == full(spark.createDataFrame(rows, ROW))
        later = [row(r[0], "n2", k + 100) if k < most else r for k, r in enumerate(rows)][1:]
        again = state.rebuild(spark.createDataFrame(later, ROW))
        assert again.changed_sources == most and told(again.nodes) == full(spark.createDataFrame(later, ROW))


def test_no_source_is_written_twice(spark, tmp_path):
    rows = spark.createDataFrame([row(f"s{k}", f"n{k % 3}", k) for k in range(9)], ROW)
    NodeState(spark, str(tmp_path / "s"), buckets=2).rebuild(rows)
    assert not (tmp_path / "s" / "links").exists()
    members = spark.read.parquet(str(tmp_path / "s" / "members" / "v=1"))
    assert members.where("own AND sources IS NULL AND evidence[0].source IS NULL AND evidence[0].quote IS NOT NULL").count() == 9
