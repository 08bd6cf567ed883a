"""Reports of a run: counts that the write itself gathers, and the settings without secrets."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_id

SECRET_KEYS = ("openAiApiKey", "api_key")
ACTIONS = {"created": "create", "updated": "update", "deleted": "delete"}


def redacted(settings: dict) -> dict:
    """The settings with secrets as ``[redacted]`` (empty ones stay empty)."""
    return {k: ("[redacted]" if v else "") if k in SECRET_KEYS else v for k, v in settings.items()}


@dataclass
class Observed:
    """A table with the observation that its next action fills."""

    rows: DataFrame
    seen: Observation


def observed(plan: DataFrame) -> Observed:
    """plan (path, action, ...) whose write counts what it does: no other job is needed."""
    seen = Observation()
    a = F.col("action")
    counts = [F.count_if(a == v).alias(k) for k, v in ACTIONS.items()] + [F.count_if(a.startswith("skip")).alias("skipped"), F.count(F.lit(1)).alias("notes")]
    return Observed(plan.observe(seen, *counts), seen)


def import_id(spark: SparkSession, started_at: str, conversations: int) -> str:
    return "import_" + spark.range(1).select(hash_id(F.lit(f"{started_at}:{conversations}"))).first()[0]


def report(spark: SparkSession, started_at: str, conversations: int, settings: dict, counts: dict[str, int], seen: Observation, warnings: tuple[str, ...] = ()) -> DataFrame:
    """One row: import_id, started_at, conversations, the write's counts, the graph's counts, settings and warnings. Call it after the write."""
    wrote = {k: int(v) for k, v in seen.get.items()}
    row = (import_id(spark, started_at, conversations), started_at, conversations, wrote, {k: int(v) for k, v in counts.items()}, json.dumps(redacted(settings), sort_keys=True), list(warnings))
    return spark.createDataFrame([row], "import_id string, started_at string, conversations long, wrote map<string,long>, counts map<string,long>, settings string, warnings array<string>")


def manifest(sources: DataFrame) -> DataFrame:
    """What was imported: source_id, title, path, create_time, update_time, one row a source."""
    return sources.select("source_id", "title", "path", "create_time", "update_time").dropDuplicates(["source_id"])
