"""Notes as files: a writer whose tasks only stage, and which moves all into place once every task is done.

The folder is a mounted path that the driver and all executors share. A task writes its notes and a list of its actions under
a staging folder of the run; a path outside the folder ends the task. The commit moves staged notes over the old ones, deletes stale
ones, then removes folders that this left empty, the deepest first. An abort removes the staging folder, so a failed
task leaves all as it was.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "skein_notes"
WRITES, DELETES = ("create", "update"), "delete"


def guarded_path(path: str | None) -> PurePosixPath:
    """A relative path that stays below the folder; anything else is an error."""
    p = PurePosixPath((path or "").replace("\\", "/"))
    if not path or p.is_absolute() or not p.parts or any(x in ("..", ".") or x.startswith(".skein-stage") or "\0" in x for x in p.parts) or ":" in p.parts[0]:
        raise ValueError(f"not a path inside the output folder: {path!r}")
    return p


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has put the list of its actions."""

    actions: str
    counts: dict[str, int]


class NotesWriter(DataSourceWriter):
    def __init__(self, root: str, at: dict[str, int]) -> None:
        self.root, self.stage, self.at = root, f"{root}/.skein-stage-{uuid4()}", at

    def write(self, rows: Iterator) -> Staged:
        own = Path(self.stage, str(uuid4()))  # an attempt of its own, so a repeated task disturbs none
        own.mkdir(parents=True)
        counts: dict[str, int] = {}
        with (own / "actions.jsonl").open("w", encoding="utf-8") as out:
            for k, r in enumerate(rows):
                action, path = r[self.at["action"]], guarded_path(r[self.at["path"]])
                counts[action] = counts.get(action, 0) + 1
                if action in WRITES:
                    (own / str(k)).write_text(r[self.at["content"]] or "", encoding="utf-8")
                    out.write(json.dumps({"to": str(path), "from": str(own / str(k))}) + "\n")
                elif action == DELETES:
                    out.write(json.dumps({"to": str(path), "from": None}) + "\n")
        return Staged(str(own / "actions.jsonl"), counts)

    def commit(self, messages: list[Staged | None]) -> None:
        emptied: set[Path] = set()
        for m in messages:
            for x in map(json.loads, Path(m.actions).open(encoding="utf-8") if m else ()):
                to = Path(self.root, x["to"])
                if x["from"]:
                    to.parent.mkdir(parents=True, exist_ok=True)
                    os.replace(x["from"], to)
                else:
                    to.unlink(missing_ok=True)
                    emptied.update(p for p in to.parents if Path(self.root) in p.parents)
        for folder in sorted(emptied, key=lambda p: -len(p.parts)):
            if folder.is_dir() and not any(folder.iterdir()):
                folder.rmdir()
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class NotesSource(DataSource):
    """``df.write.format("skein_notes").mode("append").save(folder)``; df: path, content, action (create, update and delete act, others are counted)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> NotesWriter:
        root = self.options.get("path", "")
        if not os.path.isabs(root):
            raise ValueError("the output folder must be an absolute path that all executors share")
        return NotesWriter(root.rstrip("/"), {c: schema.fieldNames().index(c) for c in ("path", "content", "action")})


def write_notes(spark: SparkSession, notes: DataFrame, folder: str) -> None:
    """Applies a plan (path, content, action) to a folder; the paths are the folder's own."""
    spark.dataSource.register(NotesSource)
    notes.select("path", "content", "action").write.format(NAME).mode("append").save(folder)
