"""Settings and states of older versions: read leniently, with defaults and clamps."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 2
# The defaults.
DEFAULTS: dict[str, Any] = {
    "openAiApiKey": "", "rememberOpenAiApiKey": False, "extractionModel": "gpt-5.4", "embeddingModel": "text-embedding-3-large", "outputFolder": "Context Graph", "maxConversations": 0, "costCapUsd": 5, "overwritePolicy": "managed-only",
    "confidenceThreshold": 0.78, "singleSourcePromotionThreshold": 0.94, "semanticMergeThreshold": 0.92, "minimumCanonicalSources": 2, "maxSourceLinksPerType": 3, "maxProjectLinksPerType": 3, "maxCoOccurrenceLinksPerType": 2,
    "maxSimilarityLinksPerType": 2, "similarityLinkThreshold": 0.78, "maxPromptChars": 36000, "linkAgentContextToGraph": False, "pruneStaleManagedFiles": True, "synthesizeNodeSummaries": True, "synthesizeNodeSummaryMinEvidence": 3,
    "agentContextSections": False, "visualGraphDefaultsVersion": VERSION, "enableSelfModelExtraction": True, "enableImportCache": True, "synthesizeAgentContextProfile": True, "estimatedExtractionCostPer1MInputTokensUsd": 0.25,
}
# Settings whose defaults replace what versions before 2 had stored, and the least confidence that is believed.
RESET_BEFORE_2 = ["agentContextSections", "maxCoOccurrenceLinksPerType", "maxSimilarityLinksPerType"]
LEAST_CONFIDENCE = 0.72
# Phases and states of a run.
PHASES = ["parsing_zip", "preview_ready", "confirmed", "extracting", "building_graph", "rendering_markdown", "writing_vault", "saving_checkpoint", "completed", "failed"]
STATES = ["running", "succeeded", "failed", "cancelled"]


def migrated(stored: dict[str, Any] | None) -> dict[str, Any]:
    """Stored settings of any version as today's: unknown keys stay, missing ones and those of old versions take their defaults, limits are at least 1."""
    stored = {k: v for k, v in (stored or {}).items() if v is not None}
    out = DEFAULTS | stored
    if (stored.get("visualGraphDefaultsVersion") or 0) < VERSION:
        out |= {k: DEFAULTS[k] for k in RESET_BEFORE_2}
    out["visualGraphDefaultsVersion"] = VERSION
    if out["confidenceThreshold"] < LEAST_CONFIDENCE:
        out["confidenceThreshold"] = DEFAULTS["confidenceThreshold"]
    alone = "singleSourcePromotionThreshold"
    if out[alone] < out["confidenceThreshold"]:
        out[alone] = max(DEFAULTS[alone], out["confidenceThreshold"])
    if "minimumCanonicalSources" not in stored:  # stored before there was such a limit
        out[alone] = max(out[alone], DEFAULTS[alone])
    for k in ("minimumCanonicalSources", "maxSourceLinksPerType", "maxProjectLinksPerType"):
        out[k] = max(1, out[k])
    return out


def for_storage(settings: dict[str, Any]) -> dict[str, Any]:
    """Settings as they are stored: a key that is not to be remembered is left out."""
    return settings | {"openAiApiKey": settings["openAiApiKey"] if settings["rememberOpenAiApiKey"] else ""}


def run_states(stored: DataFrame) -> DataFrame:
    """Stored run states (run, json) as columns; fields of another kind, unknown phases and states are null, and what cannot be read has nulls only."""
    shape = "lastImportStartedAt string, lastImportUpdatedAt string, lastImportCompletedAt string, lastImportDurationMs string, lastImportPhase string, lastImportStatus string, lastImportError string, lastImportFileName string, lastImportSelectedConversations string, lastImportProgressCompleted string, lastImportProgressTotal string"
    s = stored.select("run", F.from_json("json", shape, {"mode": "PERMISSIVE"}).alias("s"))

    def count(name: str):
        return F.expr(f"try_cast(s.{name} AS double)").cast("long")

    phase, state = F.col("s.lastImportPhase"), F.col("s.lastImportStatus")
    return s.select("run", F.col("s.lastImportStartedAt").alias("started_at"), F.col("s.lastImportUpdatedAt").alias("updated_at"), F.col("s.lastImportCompletedAt").alias("completed_at"), count("lastImportDurationMs").alias("duration_ms"), F.when(phase.isin(PHASES), phase).alias("phase"), F.when(state.isin(STATES), state).alias("status"), F.col("s.lastImportError").alias("error"), F.col("s.lastImportFileName").alias("file_name"), count("lastImportSelectedConversations").alias("selected"), count("lastImportProgressCompleted").alias("completed"), count("lastImportProgressTotal").alias("total"))


def source_manifests(stored: DataFrame) -> DataFrame:
    """import_id, source_id, title, path, create_time, update_time from stored checkpoints (json) of two shapes: with a manifest, or with conversations and a graph.

    A checkpoint without a report, or one that cannot be read, gives no rows.
    """
    source = "struct<sourceId:string,title:string,path:string,createTime:string,updateTime:string>"
    shape = f"importId string, report string, sourceManifest array<{source}>, conversations array<{source}>, graph struct<sourcePathsById:map<string,string>>"
    c = stored.select(F.from_json("json", shape, {"mode": "PERMISSIVE"}).alias("c")).where("c.report IS NOT NULL AND c.report LIKE '{%'")
    old = F.transform(F.coalesce("c.conversations", F.array().cast(f"array<{source}>")), lambda s: F.struct(F.coalesce(s["sourceId"], F.lit("")).alias("sourceId"), F.coalesce(F.nullif(s["title"], F.lit("")), F.lit("Untitled conversation")).alias("title"), F.coalesce(F.try_element_at(F.col("c.graph.sourcePathsById"), s["sourceId"]), F.lit("")).alias("path"), s["createTime"].alias("createTime"), s["updateTime"].alias("updateTime")))
    rows = c.select(F.coalesce("c.importId", F.lit("legacy_import")).alias("import_id"), F.explode(F.coalesce("c.sourceManifest", old)).alias("s"))
    return rows.select("import_id", F.col("s.sourceId").alias("source_id"), "s.title", "s.path", F.col("s.createTime").alias("create_time"), F.col("s.updateTime").alias("update_time"))


def read_settings(text: str | None) -> dict[str, Any]:
    """Settings from stored JSON; what is no object counts as nothing stored."""
    try:
        value = json.loads(text or "")
    except ValueError:
        value = None
    return migrated(value if isinstance(value, dict) else None)
