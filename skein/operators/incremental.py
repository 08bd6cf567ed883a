"""Nodes that are kept between runs: a rebuild aggregates only the nodes that changed sources touch.

State is a folder of written versions. A version holds each source's hash, and, by buckets of
nodes, what was filed under the nodes (members, which also tell a source's nodes) and the nodes. A rebuild writes only buckets with a touched node; a small map
says in which version a bucket's files are. The version's number is appended to a log last, so a run that is lost half-way leaves
the state as it was, and the next one writes over what it had begun.

Rows travel once to their bucket and their quotes once to their node. They do not travel to find out whether their source changed: bits of
the fewer sources, changed or not, are sent to them, and only rows that these leave in doubt are joined. A nodes' task writes the buckets it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .build import accumulated
from .common import beside, cut


SLOTS = 1 << 27  # bits that tell sources apart, 16 MB


def bits(ids: DataFrame) -> DataFrame:
    """A bit for each of 2^27 slots, 32 768 a row: whether a source falls into it."""
    x = slot()
    at = ids.select(F.bitmap_bucket_number(x).alias("__part"), F.bitmap_bit_position(x).alias("__at")).repartition("__part")
    return at.groupBy("__part").agg(F.bitmap_construct_agg("__at").alias("__bits"))


def slot() -> Column:
    return F.pmod(F.xxhash64("source"), F.lit(SLOTS)) + 1


def divider(kinds: DataFrame, most: int = 100_000):
    """Of sources, each ``changed`` or not: a function that gives the rows of those that are (or are not)."""
    counts = {r.changed: r.n for r in kinds.groupBy("changed").agg(F.count("*").alias("n")).collect()}
    fewer = counts.get(True, 0) <= counts.get(False, 0)
    some, few = kinds.where(F.col("changed") == fewer).select("source"), min(counts.get(True, 0), counts.get(False, 0)) <= most
    told = None if few else cut(bits(some))

    def rows_of(rows: DataFrame, changed: bool) -> DataFrame:
        how = "left_semi" if changed == fewer else "left_anti"
        if few:
            return rows.join(F.broadcast(some), "source", how)
        at = F.bitmap_bit_position(slot()).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        seen = rows.join(F.broadcast(told), F.bitmap_bucket_number(slot()) == F.col("__part"), "left")
        hit = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
        doubt = seen.where(hit).select(*rows.columns).join(some.hint("merge"), "source", how)
        return doubt if how == "left_semi" else doubt.unionByName(seen.where(~hit).select(*rows.columns))

    return rows_of


def packed(rows: DataFrame) -> DataFrame:
    """Rows without what their own source and confidence say already: ``own`` marks those whose sources and evidence name nothing else."""
    mine = F.forall("evidence", lambda e: (e["source"] == F.col("source")) & (e["confidence"] == F.col("confidence")))
    own = F.coalesce((F.col("sources") == F.array("source")) & mine, F.lit(False))
    kind = rows.schema["evidence"].dataType.simpleString()
    bare = F.transform("evidence", lambda e: F.struct(F.lit(None).cast("string").alias("source"), e["quote"].alias("quote"), F.lit(None).cast("double").alias("confidence"))).cast(kind)
    return rows.withColumns({"own": own, "sources": F.when(~own, F.col("sources")), "evidence": F.when(own, bare).otherwise(F.col("evidence"))})


def unpacked(rows: DataFrame) -> DataFrame:
    own, kind = F.coalesce("own", F.lit(False)), rows.schema["evidence"].dataType.simpleString()
    whole = F.transform("evidence", lambda e: F.struct(F.col("source").alias("source"), e["quote"].alias("quote"), F.col("confidence").alias("confidence"))).cast(kind)
    return rows.withColumns({"sources": F.when(own, F.array("source")).otherwise(F.col("sources")), "evidence": F.when(own, whole).otherwise(F.col("evidence"))}).drop("own")


@dataclass
class Rebuild:
    nodes: DataFrame
    version: int
    changed_sources: int
    touched_nodes: int
    written_buckets: list[int]


class NodeState:
    """The state in ``root``, a folder that the driver and all executors share. Buckets are fixed when the state begins."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, few: int = 100_000) -> None:
        """few: sources that are sent to all rows as they are."""
        self.spark, self.root, self.buckets, self.few = spark, root.rstrip("/"), buckets, few

    def version(self) -> int:
        """The last complete version; 0 for none."""
        log = self.spark.createDataFrame([], "version int")
        log.write.mode("append").parquet(f"{self.root}/log")
        return self.spark.read.schema("version int").parquet(f"{self.root}/log").agg(F.max("version")).first()[0] or 0

    def part(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v={version}")

    def places(self, version: int) -> dict[int, int]:
        """Bucket to the version that wrote it: at most ``buckets`` rows."""
        return {r.bucket: r.at for r in self.part("places", version).collect()} if version else {}

    def buckets_of(self, name: str, places: dict[int, int], only: list[int] | None = None, schema: StructType | None = None) -> DataFrame | None:
        """The rows of buckets; only their own folders are read."""
        read = self.spark.read if schema is None else self.spark.read.schema(schema)
        paths = [f"{self.root}/{name}/v={at}/bucket={b}" for b, at in sorted(places.items()) if only is None or b in only]
        return read.parquet(*paths) if paths else None

    def nodes(self) -> DataFrame | None:
        v = self.version()
        return self.buckets_of("nodes", self.places(v)) if v else None

    def rebuild(self, rows: DataFrame) -> Rebuild:
        """rows: source, label (of the node), and the columns of ``accumulated``: all there is now. Returns all nodes, as a full build has them.

        A source whose rows are the same as before, in any order, is not looked at again; one that is gone takes its rows along.
        """
        old = self.version()
        new = old + 1
        places = self.places(old)
        rows = rows.where("source IS NOT NULL")
        stored = packed(rows.limit(0)).schema
        h = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(rows.columns)])
        # order-free: a count, a sum and an exclusive or of row hashes
        sources = cut(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))).alias("s"), F.bit_xor(h).alias("x")))
        bucket = F.pmod(F.xxhash64("node"), F.lit(self.buckets)).cast("int")
        if old:
            was = self.part("sources", old).toDF("was", "wn", "ws", "wx")
            both = sources.join(was, F.col("source") == F.col("was"), "full_outer")
            same = (F.col("n") == F.col("wn")) & (F.col("s") == F.col("ws")) & (F.col("x") == F.col("wx"))
            kinds = cut(both.select(F.coalesce("source", "was").alias("source"), (~F.coalesce(same, F.lit(False))).alias("changed")).where("source IS NOT NULL"))
            n_changed, rows_of = kinds.where("changed").count(), divider(kinds, self.few)
            fresh, filed = rows_of(rows, True), self.buckets_of("members", places, schema=stored)
            touched = fresh.select("node")
            if filed is not None:
                touched = touched.union(rows_of(filed.select("source", "node"), True).select("node"))
        else:
            n_changed, fresh, touched = sources.count(), rows, rows.select("node")
        touched = cut(touched.distinct().withColumn("bucket", bucket))
        here = sorted(r.bucket for r in touched.select("bucket").distinct().collect())  # at most ``buckets``
        members = packed(fresh)
        before = self.buckets_of("members", places, here, stored)
        if before is not None:
            members = members.unionByName(rows_of(before, False))
        if here:
            members = members.withColumn("bucket", bucket)
            members.repartition("bucket", F.pmod(F.xxhash64("node"), F.lit(self.buckets * 8))).sortWithinPartitions("bucket", "node").write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/members/v={new}")
            now = unpacked(self.spark.read.parquet(f"{self.root}/members/v={new}"))
            again = now.join(beside(touched.select("node")), "node", "left_semi")
            heads = again.groupBy("node").agg(F.min_by("label", "ord").alias("label"))
            nodes = accumulated(again, heads, by_node=True).join(heads, "node").withColumn("bucket", bucket)
            was_nodes = self.buckets_of("nodes", places, here)
            if was_nodes is not None:
                nodes = nodes.unionByName(was_nodes.join(touched.select("node"), "node", "left_anti").withColumn("bucket", bucket))
            nodes.write.option("compression", "zstd").partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/nodes/v={new}")
            written = [r.bucket for r in self.spark.read.parquet(f"{self.root}/nodes/v={new}").select("bucket").distinct().collect()]
        else:
            written = []
        places = {b: at for b, at in places.items() if b not in here} | {b: new for b in written}
        sources.write.mode("overwrite").parquet(f"{self.root}/sources/v={new}")
        self.spark.createDataFrame(sorted(places.items()), "bucket int, at int").write.mode("overwrite").parquet(f"{self.root}/places/v={new}")
        self.spark.createDataFrame([(new,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        found = self.buckets_of("nodes", places)
        if found is None:
            found = accumulated(rows.limit(0), rows.select("node", "label").limit(0)).withColumn("label", F.lit(""))
        return Rebuild(found, new, n_changed, touched.count(), here)
