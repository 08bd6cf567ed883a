"""Text functions and graph operators on small literal rows."""

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import windows as W


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column.alias("v")).first().v


def test_hash_of_empty_and_a(spark):
    assert value(spark, T.hash_id(F.col("x")), x="") == "45h"
    assert value(spark, T.hash_id(F.col("x")), x="a") == "3t1g"


def test_slug(spark):
    assert value(spark, T.slug(F.col("x")), x="  L'Été — Déjà vu!  ") == "lete-deja-vu"
    assert value(spark, T.slug(F.col("x")), x="!!!") == "untitled"


def test_slug_decomposes(spark):
    assert value(spark, T.slug(F.col("x")), x="Łódź Őszi Šárka ﬁn") == "odz-oszi-sarka-fin"
    assert value(spark, T.slug(F.col("x")), x="½ ㎏ K’s 𝐀b") == "1-2-kg-ks-ab"


def test_hash_takes_utf16_units(spark):
    h = 5381
    for unit in (97, 0xD83D, 0xDE00, 98):
        h = (h * 33 & 0xFFFFFFFF) ^ unit
    assert int(value(spark, T.hash_id(F.col("x")), x="a😀b"), 36) == h


def test_labels(spark):
    assert value(spark, T.filename_slug(F.col("x")), x="Notes on main_view.swift source file") == "main-view"
    assert value(spark, T.clean_label(F.col("x"), F.lit("Title")), x="chunk 3") == "Title"
    assert tuple(value(spark, T.project_kind(F.col("x"), F.lit("")), x="Graph Atlas Platform")) == ("durable_project", "custom:graph-atla-platform")
    assert tuple(value(spark, T.project_kind(F.col("x"), F.lit("")), x="Family iPhone plan")) == ("non_project", "phone-plan")
    assert value(spark, T.strongest(F.lit("recurring"), F.col("x"), T.STABILITY), x="stable") == "stable"
    assert value(spark, T.joined_text(F.col("x"), F.lit("b"), 900), x="a b") == "a b"


def test_tokens_are_singular_and_distinct(spark):
    assert value(spark, T.significant_tokens(F.col("x")), x="Scoring the scores of Policies, and 42 boxes") == ["score", "policy", "42", "boxe"]


def test_cosine(spark):
    assert value(spark, T.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == 1 / 2**0.5
    assert value(spark, T.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0


def test_secrets(spark):
    assert value(spark, T.masked_secrets(F.col("x")), x="key sk-abcdefgh1234 and sk-proj-ABC_1") == "key sk-[redacted] and sk-proj-[redacted]"


def test_rescale_ends_and_single(spark):
    df = spark.createDataFrame([("a", 3), ("a", 2), ("a", 1), ("b", 1)], ["t", "n"])
    got = sorted((r.t, r.rescaled) for r in W.rescaled(df, "t", [F.desc("n")]).collect())
    assert got == [("a", 0.55), ("a", 0.77), ("a", 0.99), ("b", 0.85)]


def test_chunks_break_before_the_turn_that_is_too_much(spark):
    turns = spark.createDataFrame([("s", i, "x" * 20) for i in range(4)], ["source_id", "turn_ord", "text"])
    got = sorted((r.turn_ord, r.chunk) for r in G.chunked(turns, 250).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1)]
    lengths = turns.withColumn("shown", F.lit(30))
    assert {r.chunk for r in G.chunked(lengths, 126).collect()} == {0} and len({r.chunk for r in G.chunked(lengths, 125).collect()}) == 4


def test_write_plan(spark):
    ex = spark.createDataFrame([("a", True, False, "note"), ("b", False, False, "note"), ("c", True, True, "note"), ("d", True, True, "review_item"), ("e", True, False, "note")], "path string, managed boolean, protected boolean, kind string")
    dr = spark.createDataFrame([("a", False), ("b", False), ("new", False), ("e", True)], "path string, create_only boolean")
    assert {r.path: r.action for r in G.merge_actions(ex, dr).collect()} == {"a": "update", "b": "skip_unmanaged", "c": "keep", "d": "delete", "e": "skip_create_only", "new": "create"}
