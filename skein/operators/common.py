"""Helpers that several operators share: lineage cuts, checked broadcasts, and a running maximum that no hot key holds up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one in the warehouse if all runs in one process, as in tests, else an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return where


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder, and read from there. By columns: repeated values take little room, and a reader takes only the columns it needs."""
    spark = df.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/cut-{uuid4()}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def once_each(df: DataFrame, of: list[str], columns: dict[str, Column], most: int = 100_000) -> DataFrame:
    """df with ``columns``, which read only the columns ``of``: worked out once for each different value of these where there are about ``most`` at most
    (an estimate decides, and both ways give the same), else row by row."""
    if df.agg(F.approx_count_distinct(F.xxhash64(*of))).first()[0] > most:
        return df.withColumns(columns)
    kinds = df.select(*of).distinct().withColumns({f"__new_{c}": x for c, x in columns.items()})
    kinds = cut(kinds.select(*[F.col(c).alias(f"__{c}") for c in of], *[f"__new_{c}" for c in columns]))
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in of]
    rest = [c for c in df.columns if c not in columns]
    return df.join(F.broadcast(kinds), cond).select(*rest, *[F.col(f"__new_{c}").alias(c) for c in columns])


def coded(df: DataFrame, of: list[str], most: int = 100_000, told: Callable[[DataFrame], DataFrame] | None = None, beside_number: Sequence[str] = (), counted: DataFrame | None = None):
    """df with a number in place of the columns ``of``, and a function that puts them back: rows that travel or are sorted take a number where the
    columns have about ``most`` different values at most (an estimate decides, and both ways give the same), else they go as they are.

    told: adds or replaces columns by what it reads in ``of``, once for each different value; those of ``beside_number`` stay on the rows, the others come
    back with ``of``. counted: rows with the same values of ``of`` that are simpler to read than df.
    """
    told, counted = told or (lambda rows: rows), counted if counted is not None else df
    if counted.agg(F.approx_count_distinct(F.xxhash64(*of))).first()[0] > most:
        return told(df), lambda rows: rows
    code = f"__code_{of[0]}"
    kinds = told(counted.select(*of).distinct().withColumns({f"__{c}": F.col(c) for c in of}))
    back = [c for c in kinds.columns if c not in {f"__{c}" for c in of} and c not in beside_number]
    kinds = cut(kinds.withColumn(code, F.monotonically_increasing_id()))
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in of]
    narrow = df.join(F.broadcast(kinds.select(*[f"__{c}" for c in of], *beside_number, code)), cond).select(*[c for c in df.columns if c not in of], *beside_number, code)
    return narrow, lambda rows: rows.join(F.broadcast(kinds.select(*back, code)), code).drop(code)


def dealt(df: DataFrame, rows: int, *keys: str, per: int = 400_000) -> DataFrame:
    """df dealt by keys to as many tasks as ``rows`` need at about ``per`` each, at least the session's: what a task holds does not grow with the input.
    Groupings, windows and joins by these keys and more need no further exchange."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // per)), *keys)


def beside(small: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to be joined to many rows: broadcast if it has at most ``most`` rows, else left to a join that splits skewed keys."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def running_best(events: DataFrame, probes: DataFrame, keys: list[str], at: str, value: str, buckets: int = 64) -> DataFrame:
    """The probes, each with ``best``: the greatest value of the events of its keys strictly before its own ``at``; null for none.

    A prefix maximum in two steps, over stretches of ``at`` and inside a stretch, so that one key's events and probes are
    dealt to ``buckets`` tasks. With (time, x) as the value this is an as-of join. events: keys, at, value; probes: keys, at, more.
    """
    more = [c for c in probes.columns if c not in (*keys, at)]
    kind = events.schema[value].dataType
    rows = events.select(*keys, at, F.col(value).alias("__v"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{probes.schema[c].dataType.simpleString()}" for c in more) + ">").alias("__p"))
    rows = rows.union(probes.select(*keys, at, F.lit(None).cast(kind), F.struct(*more)))
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    if lo is None:
        return probes.withColumn("best", F.lit(None).cast(kind))
    rows = rows.withColumn("__b", F.floor((F.col(at) - lo) / ((hi - lo) // buckets + 1)))
    # one row a key and stretch
    upto = rows.groupBy(*keys, "__b").agg(F.max("__v").alias("__top"))
    upto = upto.select(*keys, "__b", F.max("__top").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = Window.partitionBy(*keys, "__b").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("__in", F.max("__v").over(inside)).where("__p IS NOT NULL").join(upto, [*keys, "__b"])
    best = F.when(F.col("__in").isNull() | (F.col("__before") > F.col("__in")), F.col("__before")).otherwise(F.col("__in"))
    return found.select(*keys, at, "__p.*", best.alias("best"))
