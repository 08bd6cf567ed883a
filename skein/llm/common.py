"""Small helpers shared by the corpus operators: text access, word hashing, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word, as a Java pattern and as the ASCII white space that bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes() -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))


def text_hash() -> Column:
    """Tells documents of one doc_id, or of none, apart."""
    return F.xxhash64(text_bytes())


def text_of(docs: DataFrame, *extra: str | Column) -> DataFrame:
    """doc_id, text as UTF-8 bytes (null: empty) and the given columns, and nothing else of the input."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), *extra)


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` for functions that turn one batch into one batch; ``after`` is called at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                if b.num_rows:
                    for k in range(0, b.num_rows, 512):  # long texts: few at a time
                        out = f(b.slice(k, 512))
                        if out is not None:
                            yield out
        finally:
            if after:
                after()

    return df.mapInArrow(run, schema)


WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64, for i up to n."""
    if len(_POWERS[0]) <= n:
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(n + n // 8 + 64, b, np.uint64)  # a worker keeps them
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_hashes(text: bytes, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word of a text, for all words at once: polynomials in their bytes, from running sums.

    Texts longer than ``most`` bytes go part by part, cut at white space, so that memory stays in proportion to a part.
    """
    if len(text) > most:
        parts, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > most:
                window = WHITE[np.frombuffer(text, np.uint8, offset=at + most)]
                end = at + most + int(np.argmax(window)) if window.any() else end
            parts.append(word_hashes(text[at:end], len(text) + 1))
            at = end
        return np.concatenate(parts)
    a = np.frombuffer(text, np.uint8)
    black = np.zeros(len(a) + 2, np.int8)
    black[1:-1] = ~WHITE[a]
    step = np.diff(black)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(a))
    with np.errstate(over="ignore"):
        run = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=run[1:])
        return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values of h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[j : j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one in the warehouse where it is unset and all runs in one process, as in tests."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(small: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of one row a group, ready to be joined to all rows: broadcast if it has at most ``most`` rows, so that a
    group's rows stay where they are; else as it is, for a join that splits skewed partitions."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def slots_of(ids: DataFrame, column: str = "doc_id", slots: int = 1 << 20) -> DataFrame:
    """The hash slots that ids fall into: at most ``slots`` rows whatever the input, so small enough to broadcast.

    A semi join with them passes all rows with such an id and few others; an exact join follows.
    """
    return ids.select(slot(column, slots).alias("slot")).distinct()


def slot(column: str, slots: int = 1 << 20):
    return F.pmod(F.xxhash64(column), F.lit(slots)).cast("int")


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that end where a key ends, from batches sorted by key; a key's rows are never split over two tables."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1], "left"))
        if last == 0 and held and held[-1].column(key)[-1].as_py() == k[0]:
            held.append(b)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def component_labels(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of an edge list: rows (node, root), root the smallest node of the component.

    Every node takes the smallest node that it or a neighbour knows of, then follows that node's own
    choice (pointer jumping), until nothing changes. Each round is one aggregation and two joins on the
    nodes that have an edge; hubs are reduced map-side. Lineage is cut each round in the shared folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct()
    both = cut(both)
    label = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
    label = cut(label)
    for _ in range(rounds):
        seen = both.join(label.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        # a root also takes what its members have seen, so that whole trees move at once
        step = label.join(seen, label["node"] == seen["u"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        best = step.groupBy("old").agg(F.min("new").alias("best"))
        hung = step.join(best, "old").select("node", "old", F.least("new", "best").alias("to"))
        top = hung.select(F.col("node").alias("to"), F.col("to").alias("up"))
        nxt = cut(hung.join(top, "to").select("node", "old", F.least("to", "up").alias("root")))
        changed = nxt.where("old <> root").limit(1).count()
        label = nxt.select("node", "root")
        if not changed:
            return label
    raise RuntimeError(f"components not settled in {rounds} rounds")

