"""Merkle manifest of a dataset: a tree of digests a source, a tree over the sources' roots, and a proof for every document.

Leaves are sorted by range, so a partition holds runs of neighbours, and numbered from counts a partition. A node's arrival
is an event: its partial parent takes the digest under its index until as many children are there as the tree's size says,
then the parent itself arrives one level up. Partitions combine what they hold, as ``combineByKey`` does before its shuffle;
children of parents still open are the frontier, which is dealt anew by ever wider spans until all roots stand. Every
finished parent leaves reverse links from its children (above the level of units); a unit's way to the root is
joined from those, a level at a time, and inside a unit each leaf's proof is read off the unit's own small tree. Texts
are read once; what is shuffled has some hundred bytes a document, and no source, however large, meets in one task.

Defined cases: null fields hash as ``-``; a null source is a source of its own, first in order; rows without doc_id come
first and are never tampered with; rows that share a doc_id stand by their leaf's digest; repeated rows are leaves of their
own; a tree of one leaf is that leaf, and its proof the digest of nothing; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, cut

#: Children of a node, and the levels of a unit, the subtree whose proofs are made at once: 3**6 leaves.
ARITY, UNIT = 3, 6
NODE = "tree binary, size long, level int, i long, digest binary"
EVENT = NODE + ", kind string, up long, step binary"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(doc: dict[str, Column]) -> Column:
    """The digest of a document's fields, 64 hex digits."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(doc[c]).cast("string"), F.lit(":"), doc[c]), F.lit("-")) for c in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source, so that bytes sort it), digest, and altered: the leaf of a tampered text where that differs."""
    doc = {c: F.col(c).cast("string") for c in FIELDS}
    tampered = doc | {"text": F.replace(doc["text"], F.lit("\n"), F.lit(""))}
    altered = (F.crc32(doc["doc_id"].cast("binary")) % 2 == 0) & F.contains(doc["text"], F.lit("\n"))
    tree = F.when(doc["source"].isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), doc["source"].cast("binary")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(leaf(doc)).alias("digest"), F.when(altered, F.unhex(leaf(tampered))).alias("altered"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with i, their place in their tree from 0 in the order of ``by``, and size, the tree's leaves.

    One sort by range; then places follow from a count a tree and partition. The sorted rows are written, as a second
    sort may draw other borders.
    """
    placed = cut(rows.repartitionByRange("tree", *by).sortWithinPartitions("tree", *by).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.select("tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(tree).alias("size")))
    return placed.join(beside(runs), ["tree", "part"]).withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def hashed(children: list[bytes]) -> bytes:
    return sha256(b"".join(c.hex().encode() for c in children)).digest()


def width(size: int, level: int) -> int:
    """Nodes on a level of a tree."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


class Parents:
    """Partial parents: children by index, until the number that the size of the tree gives is met."""

    def __init__(self, unit: int = UNIT) -> None:
        self.unit = unit
        self.open: dict[tuple, dict[int, bytes]] = {}
        self.done: list[tuple] = []

    def arrive(self, tree: bytes, size: int, level: int, i: int, digest: bytes) -> None:
        n = width(size, level)
        while n > 1:
            up = i // ARITY
            key = (tree, size, level, up)
            children = self.open.setdefault(key, {})
            children[i] = digest
            if len(children) < min(ARITY, n - ARITY * up):
                return
            del self.open[key]
            in_order = sorted(children.items())
            if level >= self.unit:
                for at, own in in_order:
                    self.done.append((tree, size, level, at, own, "link", up, step(at, [d for j, d in in_order if j != at])))
            digest = hashed([d for _, d in in_order])
            level, i, n = level + 1, up, -(-n // ARITY)
        self.done.append((tree, size, level, i, digest, "root", None, None))

    def frontier(self) -> list[tuple]:
        return [(tree, size, level, i, d, "node", None, None) for (tree, size, level, _), children in self.open.items() for i, d in children.items()]


def step(i: int, siblings: list[bytes]) -> bytes:
    """One level of a proof: the node's place in its run, the number of siblings, the siblings."""
    return bytes((i % ARITY, len(siblings))) + b"".join(siblings)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[k : k + 32] for k in range(at + 2, at + 2 + 32 * n, 32)]
        at += 2 + 32 * n


def proof(path: bytes) -> str:
    return sha256(b"".join(s.hex().encode() for _, siblings in steps(path) for s in siblings)).hexdigest()


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings of its proof give."""
    for place, siblings in steps(path):
        digest = hashed([*siblings[:place], digest, *siblings[place:]])
    return digest


def combined(nodes: DataFrame, unit: int) -> DataFrame:
    """The events' outcome, partition by partition: links of finished parents, roots, and the frontier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.binary()), ("size", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("digest", pa.binary()), ("kind", pa.string()), ("up", pa.int64()), ("step", pa.binary())])
        parents = Parents(unit)

        def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), schema.types, strict=True)], schema=schema)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("tree", "size", "level", "i", "digest")), strict=True):
                parents.arrive(*row)
            yield from told(parents.done)
            parents.done.clear()
        yield from told(parents.frontier())

    return nodes.select("tree", "size", "level", "i", "digest").mapInArrow(run, EVENT)


def grown(placed: DataFrame, unit: int) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, root) and links (tree, level, i, up, step) of all trees. placed: tree, size, i, digest of the leaves.

    Round k deals the frontier by spans of 3**(unit * (k + 1)) leaves, so a group has at most 3**unit whole subtrees and
    the open ends of the partitions that meet in it; the rounds are the height over the unit's.
    """
    found = cut(combined(placed.withColumn("level", F.lit(0)), unit))
    every, k = found, 0
    while found.where("kind = 'node'").limit(1).count():
        k += 1
        first_leaf = F.col("i").cast("decimal(38)") * F.pow(F.lit(float(ARITY)), F.col("level")).cast("decimal(38)")
        span = F.floor(first_leaf / F.lit(ARITY ** (unit * (k + 1))).cast("decimal(38)"))
        found = cut(combined(found.where("kind = 'node'").repartition("tree", span), unit))
        every = every.union(found)
    return every.where("kind = 'root'").select("tree", F.col("digest").alias("root")), every.where("kind = 'link'").select("tree", "level", "i", "up", "step")


def unit_paths(placed: DataFrame, links: DataFrame, unit: int) -> DataFrame:
    """tree, unit, path: each unit's way from its own top to its tree's root, by reverse links."""
    here = placed.groupBy("tree", "size", F.floor(F.col("i") / ARITY**unit).alias("unit")).count().drop("count")
    tallest = here.agg(F.max("size")).first()[0]
    here = here.withColumn("i", F.col("unit")).withColumn("path", F.lit(b""))
    level = unit
    while width(tallest, level) > 1:
        of = links.where(F.col("level") == level).select("tree", "i", "up", "step")
        here = here.join(of, ["tree", "i"], "left").select("tree", "size", "unit", F.coalesce("up", "i").alias("i"), F.concat("path", F.coalesce("step", F.lit(b""))).alias("path"))
        level += 1
    return here.select("tree", "unit", "path")


def inside(size: int, start: int, digests: list[bytes], unit: int) -> list[bytes]:
    """The way of each leaf of a unit to the unit's top. start: the place of the unit's first leaf in its tree."""
    levels, level = [digests], 0
    while level < unit and width(size, level) > 1:
        row = levels[-1]
        levels.append([hashed(row[k : k + ARITY]) for k in range(0, len(row), ARITY)])
        level += 1
    out = []
    for j in range(len(digests)):
        path, i, first = b"", j, start
        for row in levels[:-1]:
            run = i - i % ARITY
            path += step(first + i, [d for k, d in enumerate(row[run : run + ARITY], run) if k != i])
            i, first = i // ARITY, first // ARITY
        out.append(path)
    return out


def proved(placed: DataFrame, ways: DataFrame, unit: int, rows_of, schema: str) -> DataFrame:
    """Runs ``rows_of(leaf row, path inside its unit, the unit's row)`` for all leaves, unit by unit.

    placed: tree, size, i, digest, more; ways: tree, unit, path, more. Both are dealt by unit; a unit's row sorts before its leaves.
    """
    own = [c for c in placed.columns if c != "tree"]
    rest = [c for c in ways.columns if c not in ("tree", "unit")]
    both = placed.withColumn("unit", F.floor(F.col("i") / ARITY**unit)).unionByName(ways.withColumn("i", F.lit(-1).cast("long")), allowMissingColumns=True)
    both = both.repartition("tree", "unit").sortWithinPartitions("tree", "unit", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way: dict | None = None
        held: list[dict] = []

        def told() -> list[dict]:
            paths = inside(held[0]["size"], held[0]["i"], [r["digest"] for r in held], unit) if held else []
            return [rows_of(r, p, way) for r, p in zip(held, paths, strict=True)]

        for b in batches:
            done: list[dict] = []
            for r in b.to_pylist():
                if r["i"] < 0:
                    done += told()
                    way, held = {c: r[c] for c in ("tree", *rest)}, []
                else:
                    held.append({c: r[c] for c in own})
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=pa_schema)
        if last := told():
            yield pa.RecordBatch.from_pylist(last, schema=pa_schema)

    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    pa_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return both.mapInArrow(run, schema)


def manifest(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document. unit: the levels of a unit."""
    placed = numbered(leaves(docs), ["doc_id", "digest"])
    roots, links = grown(placed, unit)
    # the sources' roots are the leaves of one more tree
    top = numbered(roots.select(F.lit(b"").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), ["source"])
    top_roots, top_links = grown(top, unit)
    if not top_roots.limit(1).count():
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    top_ways = unit_paths(top, top_links, unit).join(F.broadcast(top_roots), "tree")  # one root
    sources = cut(proved(top, top_ways, unit, source_row, "tree binary, subroot binary, root binary, above binary"))
    ways = unit_paths(placed, links, unit).join(beside(sources), "tree")
    return proved(placed, ways, unit, document_row, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def source_row(leaf: dict, path: bytes, way: dict) -> dict:
    return {"tree": leaf["source"], "subroot": leaf["digest"], "root": way["root"], "above": path + way["path"]}


def document_row(leaf: dict, path: bytes, way: dict) -> dict:
    path += way["path"] + way["above"]
    root = folded(leaf["altered"] or leaf["digest"], path)
    return {"doc_id": leaf["doc_id"], "leaf": leaf["digest"].hex(), "subroot": way["subroot"].hex(), "root": way["root"].hex(), "proof_sha256": proof(path), "folded_root": root.hex(), "verified": root == way["root"]}


def leaf_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


#: The remainder of crc32 by 2, bit by bit: xor of a byte, then eight shifts.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT) % 2"
TREE_SQL = """
 {t}nodes AS (SELECT tree, 0 AS level, i, digest, count(*) OVER (PARTITION BY tree) AS width FROM {t}leaves
   UNION ALL SELECT tree, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (width + 2) // 3 FROM {t}nodes WHERE width > 1 GROUP BY tree, level, i // 3, width),
 {t}runs AS (SELECT tree, level, i // 3 AS up, list(digest ORDER BY i) AS ds FROM {t}nodes WHERE width > 1 GROUP BY ALL),
 {t}paths AS (SELECT row, tree, 0 AS level, i, '' AS siblings, changed AS folded FROM {t}leaves
   UNION ALL SELECT row, p.tree, p.level + 1, up, siblings || array_to_string(ds[:i % 3] || ds[i % 3 + 2:], ''), sha256(array_to_string(ds[:i % 3] || [folded] || ds[i % 3 + 2:], '')) FROM {t}paths p JOIN {t}runs r ON p.tree = r.tree AND p.level = r.level AND p.i // 3 = r.up),
 {t}proofs AS (SELECT row, tree, siblings, folded FROM {t}paths QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1)"""
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('1' || source, '0') AS source_, {leaf_sql("text")} AS digest, CASE WHEN {CRC_SQL} = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS changed FROM documents),
 leaves AS (SELECT row, source_ AS tree, row_number() OVER (PARTITION BY source_ ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, digest, changed FROM d),{TREE_SQL.format(t="")},
 s AS (SELECT tree AS source_, digest AS subroot FROM nodes WHERE width = 1),
 top_leaves AS (SELECT row_number() OVER () AS row, source_, 0 AS tree, row_number() OVER (ORDER BY source_) - 1 AS i, subroot AS digest, subroot AS changed FROM s),{TREE_SQL.format(t="top_")},
 r AS (SELECT digest AS root FROM top_nodes WHERE width = 1),
 low AS (SELECT row, doc_id, source_, d.digest AS leaf, siblings, folded FROM d JOIN proofs USING (row)),
 high AS (SELECT source_, siblings AS above, top_leaves.row FROM top_leaves JOIN top_proofs USING (row)),
 f AS (SELECT low.row, low.folded, high.row AS place, top_leaves.i, 0 AS level FROM low JOIN high USING (source_) JOIN top_leaves ON high.row = top_leaves.row
   UNION ALL SELECT f.row, sha256(array_to_string(ds[:i % 3] || [folded] || ds[i % 3 + 2:], '')), place, up, f.level + 1 FROM f JOIN top_runs r ON f.level = r.level AND f.i // 3 = r.up),
 e AS (SELECT row, folded AS folded_root FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings || above) AS proof_sha256, folded_root, folded_root = root AS verified FROM low JOIN s USING (source_) JOIN high USING (source_) JOIN e ON e.row = low.row, r
"""
