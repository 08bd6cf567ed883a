"""Chat export archives as tables: entries are split into conversations in the tasks, everything after that is Column expressions."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hash_id, trim_all

# The names of the entries that hold conversations, in any folder of the archive.
ENTRY = re.compile(r"(?:^|/)conversations(?:-\d+)?\.json$")
MESSAGE = "struct<id:string,author:struct<role:string,name:string>,create_time:double,update_time:double,content:struct<parts:array<string>,text:string>>"
CONVERSATION = f"struct<title:string,id:string,conversation_id:string,create_time:double,update_time:double,mapping:map<string,struct<message:{MESSAGE}>>>"
RAW = "archive string, entry string, input_ord long, json string"
ROLES = ["user", "assistant", "system", "tool"]


def elements(name: str, text: str) -> Iterator[str]:
    """The elements of a JSON array as they stand in the text, one at a time."""
    decoder, space = json.JSONDecoder(), re.compile(r"\s*")
    at = space.match(text).end()
    if text[at : at + 1] != "[":
        raise ValueError(f"{name}: must contain an array of conversations")
    at = space.match(text, at + 1).end()
    while text[at : at + 1] != "]":
        try:
            end = decoder.raw_decode(text, at)[1]
        except json.JSONDecodeError as e:
            raise ValueError(f"{name}: not valid JSON ({e.msg})") from None
        yield text[at:end]
        at = space.match(text, end).end()
        if text[at : at + 1] == ",":
            at = space.match(text, at + 1).end()
        elif text[at : at + 1] != "]":
            raise ValueError(f"{name}: not valid JSON (array not closed)")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, entry, input_ord, json: one row a conversation, numbered from 0 in its entry. One archive is one row of the scan.

    Fails on an archive without conversation entries and on malformed JSON, naming the entry.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                names = sorted(n for n in z.namelist() if ENTRY.search(n))
                if not names:
                    raise ValueError(f"{archive}: no conversations.json")
                for name in names:
                    part = []
                    for k, one in enumerate(elements(name, z.read(name).decode())):
                        part.append((archive, name, k, one))
                        if len(part) == 256:
                            yield pd.DataFrame(part, columns=["archive", "entry", "input_ord", "json"])
                            part = []
                    yield pd.DataFrame(part, columns=["archive", "entry", "input_ord", "json"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RAW)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The same for bare JSON files, each an array of conversations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text in zip(b["path"], b["value"], strict=True):
                rows = [(name, name.rsplit("/", 1)[-1], k, one) for k, one in enumerate(elements(name, text))]
                yield pd.DataFrame(rows, columns=["archive", "entry", "input_ord", "json"])

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, RAW)


def iso(seconds: Column) -> Column:
    """Unix seconds as an ISO string in UTC, cut to milliseconds; null stays null."""
    at = F.timestamp_millis((seconds * 1000).cast("long"))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def message_text(message: Column) -> Column:
    """Non-empty parts joined by blank lines (objects as their JSON), else the plain text, else empty; trimmed."""
    content = message["content"]
    parts = F.array_join(F.filter(content["parts"], lambda p: p.isNotNull() & (p != "")), "\n\n")
    return trim_all(F.coalesce(parts, content["text"], F.lit("")))


def parsed(raw: DataFrame) -> DataFrame:
    """The rows of ``read_archives`` with source_id, title, create_time, update_time, raw_message_count and entries of the mapping."""
    c = raw.select("archive", "entry", "input_ord", F.from_json("json", CONVERSATION).alias("c"))
    title = F.coalesce(F.nullif(trim_all(F.col("c.title")), F.lit("")), F.concat(F.lit("Untitled ChatGPT Conversation "), F.col("input_ord") + 1))
    c = c.select("archive", "entry", "input_ord", title.alias("title"), iso(F.col("c.create_time")).alias("create_time"), iso(F.col("c.update_time")).alias("update_time"), F.map_entries("c.mapping").alias("nodes"), "c.id", "c.conversation_id")
    made = F.concat(F.lit("chatgpt-"), hash_id(F.concat_ws("-", "title", F.coalesce("create_time", F.lit("")), F.coalesce("update_time", F.lit("")), "input_ord")))
    source = F.coalesce(F.nullif("id", F.lit("")), F.nullif("conversation_id", F.lit("")), made)
    return c.withColumn("source_id", source).withColumn("raw_message_count", F.coalesce(F.array_size("nodes"), F.lit(0))).drop("id", "conversation_id")


def conversations(raw: DataFrame) -> DataFrame:
    """One row a conversation with at least one turn."""
    spoken = F.exists("nodes", lambda n: message_text(n["value"]["message"]) != "")
    return parsed(raw).where(spoken).drop("nodes")


def turns(raw: DataFrame) -> DataFrame:
    """source_id, turn_ord from 1, id, role, author_name, text, create_time, update_time of the turns that have text.

    Timed turns first, by time and then place in the mapping; turns without a time by id.
    """
    rows = parsed(raw).select("archive", "entry", "input_ord", "source_id", F.posexplode("nodes").alias("pos", "node"))
    m = F.col("node.value.message")
    rows = rows.select("archive", "entry", "input_ord", "source_id", "pos", F.coalesce(F.nullif(m["id"], F.lit("")), F.col("node.key")).alias("id"), m["author"]["role"].alias("r"), m["author"]["name"].alias("author_name"), message_text(m).alias("text"), iso(m["create_time"]).alias("create_time"), iso(m["update_time"]).alias("update_time"))
    order = [F.col("create_time").asc_nulls_last(), F.when(F.col("create_time").isNull(), F.col("id")), F.col("pos")]
    place = F.row_number().over(Window.partitionBy("archive", "entry", "input_ord").orderBy(*order))
    role = F.when(F.col("r").isin(ROLES), F.col("r")).otherwise("unknown")
    return rows.where("text <> ''").select("source_id", place.alias("turn_ord"), "id", role.alias("role"), "author_name", "text", "create_time", "update_time")
