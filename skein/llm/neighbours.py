"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, searched greedily.

Equal vectors are one node. Nodes are dealt to blocks around pivots; inside the blocks of its nearest
pivots a node meets its first neighbours. Then neighbours of neighbours meet, round by round, around the node that they share: its
neighbours' vectors (either way) come to it by a join, each takes the best it meets into its list, and the rounds
end when one changes few lists (``settled`` of them); what met in an earlier round does not meet again. Of those that have a node as neighbour
a round takes at most twice as many as of its own, drawn by hash, so a node that is near to very many holds up nobody.
A query starts at its own node, expands the best nodes that it has not yet expanded by
a join with the graph, and ends when all of its best have been.

In a round a vector travels once to each node that it is around, in the search once to each block that asks for it, never once a pair. Blocks above ``block`` rows are cut by hash, so no
task's memory grows with a crowded pivot. Pivots are a bounded, reproducible sample (at most ``MAX_PIVOTS``) and broadcast;
every vector is indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of unequal
length have no inner product, and only those of the commonest length (ties: the shortest) take part; with fewer candidates than k
all are returned; rows with the same id and vector count once; a vec_id with several vectors is one query and one candidate that is as
near as its nearest vector; an empty table gives no rows; other columns are ignored. Sums and scores are doubles throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import cut, groups_of, mix

MAX_PIVOTS = 2048
GRAPH = "node long, near array<long>, sims array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part: floats stay floats, which take half the room on the way and are computed with as doubles; other numbers become doubles."""
    v = F.col("embedding")
    kind = "array<float>" if vectors.schema["embedding"].dataType.elementType == FloatType() else "array<double>"
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    ok = vectors.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind).alias("v"))
    sizes = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return ok.where(F.size("v") == (sizes[0].d if sizes else 0)).dropDuplicates(["vec_id", "v"])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1).astype(np.float64)


def best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest similarities, ties to the smaller id."""
    k = min(k, sims.shape[1])
    if k < sims.shape[1]:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.tile(np.arange(k), (len(sims), 1))
    s, i = np.take_along_axis(sims, part, 1), ids[part]
    order = np.lexsort((i, -s), axis=1)
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def lists(s: np.ndarray, i: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """As Arrow lists, without the places that are -inf."""
    keep = np.isfinite(s)
    offsets = pa.array(np.r_[0, np.cumsum(keep.sum(1))].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(i[keep], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(s[keep]))


def with_blocks(nodes: DataFrame, total: int, block: int, near: int) -> DataFrame:
    """node, v, blocks: its ``near`` nearest pivots' blocks, home first."""
    wanted = max(1, min(MAX_PIVOTS, total // block))
    pivots = np.array([r.v for r in nodes.orderBy(F.xxhash64("node"), "node").limit(wanted).collect()], np.float64)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-30)
    parts = max(1, total // (wanted * block * 4))  # crowded beyond what pivots can divide: cut by hash

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(pa.chunked_array([b.column("v")]))
                _, at = best(x @ pivots.T, np.arange(len(pivots)), near)
                # another division at each pivot: nodes that are apart at one meet at the next
                drawn = mix(b.column("node").to_numpy().view(np.uint64)[:, None] ^ mix(at.astype(np.uint64) + np.uint64(1)))
                at = at * parts + (drawn % np.uint64(parts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), pa.array(list(at), pa.list_(pa.int64()))], ["node", "v", "blocks"])

    return nodes.select("node", "v").mapInArrow(run, f"node long, v {nodes.schema['v'].dataType.simpleString()}, blocks array<long>")


def first_graph(blocked: DataFrame, k: int) -> DataFrame:
    """Each node's best k of the blocks it is in."""

    def run(t: pa.Table) -> pa.Table:
        x, ids = matrix(t.column("v")), t.column("node").to_numpy()
        out_s, out_i = [], []
        for a in range(0, len(ids), 256):
            s = x[a : a + 256] @ x.T
            s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
            s, i = best(s, ids, k)
            out_s.append(s)
            out_i.append(i)
        near, sims = lists(np.concatenate(out_s), np.concatenate(out_i))
        return pa.table({"node": ids, "near": near, "sims": sims})

    rows = blocked.select("node", "v", F.explode("blocks").alias("b")).groupBy("b").applyInArrow(run, GRAPH)
    return merged(rows, k)


def merged(rows: DataFrame, k: int) -> DataFrame:
    """One list a node: the best k of its lists, each neighbour once."""
    flat = rows.groupBy("node").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("near", "sims")))).alias("z"))
    once = F.filter("z", lambda x, i: (i == 0) | (F.get("z", i - 1)["near"] != x["near"]))
    top = F.slice(F.array_sort(F.transform(once, lambda x: F.struct((-x["sims"]).alias("far"), x["near"].alias("near")))), 1, k)
    return flat.select("node", top.alias("z")).select("node", F.col("z.near").alias("near"), F.transform("z.far", lambda x: -x).alias("sims"))


def meet(members: DataFrame, asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Each member's (b, node, v) best k of the candidates (b, c) that its block has asked for."""
    candidates = asked.join(vectors.select(F.col("node").alias("c"), "v"), "c").select(F.col("b").alias("asker"), F.col("c").alias("c"), F.col("v").alias("v"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64())), "sims": pa.array([], pa.list_(pa.float64()))})
        x, ids = matrix(left.column("v")), left.column("node").to_numpy()
        y, cs = matrix(right.column("v")), right.column("c").to_numpy()
        out_s, out_i = [], []
        for a in range(0, len(ids), 64):
            s, i = best(x[a : a + 64] @ y.T, cs, k)
            out_s.append(s)
            out_i.append(i)
        near, sims = lists(np.concatenate(out_s), np.concatenate(out_i))
        return pa.table({"node": ids, "near": near, "sims": sims})

    return members.select(F.col("b").alias("block"), F.col("node").alias("node"), F.col("v").alias("v")).groupBy("block").cogroup(candidates.groupBy("asker")).applyInArrow(run, GRAPH)


def met_at(rows: DataFrame) -> DataFrame:
    """What the members (via, c, fresh, least, v) of each ``via`` find in each other: pairs of which one is fresh and that reach the first's ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "via"):
            via, ids, fresh, least = (t.column(c).to_numpy() for c in ("via", "c", "fresh", "least"))
            x = matrix(t.column("v"))
            start = np.flatnonzero(np.r_[True, via[1:] != via[:-1]])
            size = np.diff(np.r_[start, len(via)])
            for a in range(0, len(start), 256):  # groups side by side, filled up to the largest of them
                places = np.arange(size[a : a + 256].max())
                there = places < size[a : a + 256, None]
                at = np.where(there, start[a : a + 256, None] + places, 0)
                s = x[at] @ x[at].transpose(0, 2, 1)
                c, new = ids[at], fresh[at]
                ok = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (c[:, :, None] != c[:, None, :]) & (s >= least[at][:, :, None])
                found = ok.any(2)
                near, sims = lists(np.where(ok, s, -np.inf)[found], np.broadcast_to(c[:, None, :], s.shape)[found])
                yield pa.RecordBatch.from_arrays([pa.array(c[found]), near, sims], ["node", "near", "sims"])

    return rows.repartition("via").sortWithinPartitions("via").mapInArrow(run, GRAPH)


def descend(graph: DataFrame, was: DataFrame | None, vectors: DataFrame, k: int, width: int) -> DataFrame:
    """One round: around each node its ``width`` nearest neighbours and at most twice as many of those that have it as one meet; each node keeps the best k of these and its own.

    Two old neighbours have met before, so only pairs with a neighbour that the last graph ``was`` without meet. A node's vector
    travels once to each node around which it meets others: at most 3 * ``width`` times a round, whatever the number of nodes.
    """
    now = graph.select("node", F.slice("near", 1, width).alias("near"))
    if was is not None:
        now = now.join(was.select("node", F.slice("near", 1, width).alias("old")), "node", "left")
        now = now.select("node", F.explode("near").alias("to"), F.coalesce("old", F.array().cast("array<long>")).alias("old")).select("node", "to", (~F.array_contains("old", F.col("to"))).alias("fresh"))
    else:
        now = now.select("node", F.explode("near").alias("to"), F.lit(True).alias("fresh"))
    edges = cut(now)
    drawn = Window.partitionBy("to").orderBy(F.xxhash64("node", "to"), "node")
    back = edges.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= 2 * width).select("to", "node", "fresh")
    both = edges.union(back).groupBy(F.col("node").alias("via"), F.col("to").alias("c")).agg(F.max("fresh").alias("fresh"))
    members = both.join(both.where("fresh").select("via").distinct(), "via", "left_semi")
    # a full list takes nothing that is farther than its last
    least = graph.select(F.col("node").alias("c"), F.when(F.size("sims") >= k, F.element_at("sims", -1)).otherwise(float("-inf")).alias("least"))
    about = vectors.select(F.col("node").alias("c"), "v").join(least, "c", "left").select("c", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    return merged(met_at(members.join(about, "c").select("via", "c", "fresh", "least", "v")).union(graph), k)


def changed(old: DataFrame, new: DataFrame) -> float:
    """The share of nodes whose lists differ."""
    both = new.select("node", "near").join(old.select("node", F.col("near").alias("was")), "node", "left")
    n, moved = both.agg(F.count("*"), F.count_if(~F.col("near").eqNullSafe(F.col("was")))).first()
    return moved / n if n else 0.0


def search(graph: DataFrame, queries: DataFrame, vectors: DataFrame, beam: int, expand: int) -> DataFrame:
    """Greedy search from each query's own node: node, near, sims of the ``beam`` best met, its own node among them.

    Each hop expands the ``expand`` best nodes not yet expanded; it ends when all of every query's beam have been. Expanded nodes
    are not expanded again and a beam only gets nearer, so it does end.
    """
    own = F.aggregate(F.zip_with("v", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    start = queries.join(graph, "node").select("node", F.concat(F.array("node"), "near").alias("near"), F.concat(F.array(own), "sims").alias("sims"))
    start = queries.select("node").join(start, "node", "left").select("node", F.coalesce("near", F.array("node")).alias("near"), "sims")
    state = cut(start.withColumn("done", F.array("node")))
    while True:
        ahead = state.withColumn("now", F.slice(F.array_except("near", "done"), 1, expand))
        frontier = cut(ahead.withColumn("done", F.array_union("done", "now")))
        if frontier.where(F.size("now") > 0).isEmpty():
            break
        via = frontier.join(queries.select("node", "b"), "node").select("b", F.explode("now").alias("via")).distinct()
        asked = via.join(graph.select(F.col("node").alias("via"), "near"), "via").select("b", F.explode("near").alias("c")).distinct()
        met = merged(meet(queries, asked, vectors, beam).union(frontier.select("node", "near", "sims")), beam)
        state = cut(met.join(frontier.select("node", "done"), "node"))
    return state.select("node", "near", "sims")


def nearest(vectors: DataFrame, k: int = 20, degree: int = 24, block: int = 512, near: int = 4, settled: float = 0.05, width: int = 10, beam: int = 64, expand: int = 24, divisor: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``divisor``."""
    rows = cut(usable(vectors))
    none = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if rows.isEmpty():
        return none
    # equal vectors are one node; its number is their smallest id, or drawn where ids have several vectors
    by_vector = cut(rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    if by_vector.select("node").distinct().count() < by_vector.count():
        by_vector = cut(by_vector.withColumn("node", F.monotonically_increasing_id()))
    if by_vector.where("n > 1").isEmpty() and rows.select("vec_id").distinct().count() == rows.count():
        classed = rows.withColumn("node", F.col("vec_id"))
    else:
        classed = rows.join(by_vector.select("v", "node"), "v")
    classed = cut(classed)
    nodes = by_vector.select("node", "v")
    total = nodes.count()
    blocked = cut(with_blocks(nodes, total, block, near))
    homes = blocked.select("node", "v", F.col("blocks")[0].alias("b"))
    graph = cut(first_graph(blocked, degree))
    was = None
    while True:
        better = cut(descend(graph, was, nodes, degree, width))
        moved, was, graph = changed(graph, better), graph, better
        if moved <= settled:
            break
    asks = classed.where(F.col("vec_id") % divisor == 0).select("node").distinct()
    queries = cut(homes.join(asks, "node", "left_semi"))
    found = search(graph, queries, nodes, beam, expand)
    # nodes back to rows: of equal vectors the k + 1 smallest ids are enough
    ranked = Window.partitionBy("node").orderBy("vec_id")
    members = classed.select("node", "vec_id", F.row_number().over(ranked).alias("m")).where(F.col("m") <= k + 1)
    pairs = found.select("node", F.explode(F.arrays_zip("near", "sims")).alias("z")).select("node", F.col("z.near").alias("c"), F.col("z.sims").alias("score"))
    # a few more than k, scored again in double precision from the original vectors, term by term
    best_k = Window.partitionBy("node").orderBy(F.desc("score"), "c")
    pairs = pairs.withColumn("r", F.row_number().over(best_k)).where(F.col("r") <= k + 5).select("node", "c")
    both = pairs.join(nodes.withColumnRenamed("v", "x"), "node").join(nodes.select(F.col("node").alias("c"), F.col("v").alias("y")), "c")
    pairs = both.select("node", "c", F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x).alias("score"))
    hits = pairs.join(members.select(F.col("node").alias("c"), "vec_id"), "c").select("node", "vec_id", "score")
    ids = classed.where(F.col("vec_id") % divisor == 0).select(F.col("vec_id").alias("query_id"), "node")
    out = ids.join(hits, "node").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
