"""Ranking and capping per group. Every window ends in a total order, so reruns agree; ``row_number() <= k`` prunes before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many items of a type are taken from one source.
ITEM_LIMITS = {"topic": 6, "entity": 5, "project": 4, "pattern": 8, "principle": 6, "agent_instruction": 8, "preference": 7, "decision": 7, "task": 8, "artifact": 5, "style_pattern": 5}


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First-wins dedupe. ``row_number() <= 1`` is cut down in each task before the shuffle, so a group sends one row a task."""
    rest = [c for c in df.columns if c not in keys]
    return top_per_group(df, keys, order, 1).select(*keys, *rest)


def capped_links(links: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The links kept, with the number removed from their group."""
    group = Window.partitionBy(*keys)
    out = links.withColumn("rank", F.row_number().over(group.orderBy(*order))).withColumn("removed", F.greatest(F.count("*").over(group) - cap, F.lit(0)))
    return out.where(F.col("rank") <= cap)


def rescaled(nodes: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """confidence by rank in the group: from 0.99 down to 0.55, 0.85 for one alone, rounded half up to two digits."""
    w = Window.partitionBy(group)
    rank, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    value = F.when(n == 1, F.lit(0.85)).otherwise(F.lit(0.99) - rank / F.greatest(n - 1, F.lit(1)) * F.lit(0.44))
    return nodes.withColumn("rescaled", F.floor(value * 100 + 0.5) / 100)


def phase_timings(events: DataFrame, run: str, at: str, tie: str) -> DataFrame:
    """Each phase ends where the run's next begins; the last is open."""
    w = Window.partitionBy(run).orderBy(at, tie)
    done = F.lead(at).over(w)
    return events.withColumn("completed_at", done).withColumn("duration_ms", F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col(at).cast("timestamp")))
