"""Paths of notes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.render import TYPES, mapped
from ..functions.text import file_name, hash_id


def joined(*parts: Column | str) -> Column:
    """The parts without slashes at their ends, joined by one; empty ones left out."""
    clean = [F.regexp_replace(F.lit(p) if isinstance(p, str) else p, "^/+|/+$", "") for p in parts]
    return F.array_join(F.filter(F.array(*clean), lambda x: x != ""), "/")


def node_path(kind: Column, label: Column, root: str) -> Column:
    return joined(root, mapped(kind, {k: many for k, (_, many) in TYPES.items()}), F.concat(file_name(label), F.lit(".md")))


def source_path(title: Column, source: Column, root: str, origin: str = "ChatGPT") -> Column:
    return joined(root, "Sources", origin, F.concat(file_name(title), F.lit(" - "), F.substring(hash_id(source), 1, 8), F.lit(".md")))


def review_path(root: str) -> Column:
    return joined(root, "Review Queue.md")


def identity_path(root: str) -> Column:
    return joined(root, "Entities", "_Me.md")


def context_path(root: str, sections: bool = False) -> Column:
    return joined(root, "Agent Context", "README.md") if sections else joined(root, "Agent Context.md")


def normal_path(path: Column) -> Column:
    """Forward slashes only, none doubled, none at the ends."""
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), "^/|/$", "")


def inside(path: Column, root: str) -> Column:
    """Whether a path lies below the folder, and does not climb out of it."""
    p, top = normal_path(path), normal_path(F.lit(root))
    return ((top == "") | p.startswith(F.concat(top, F.lit("/")))) & ~p.rlike(r"(^|/)\.\.?(/|$)")


def stem(path: Column) -> Column:
    """The file's name without its folder and ``.md``."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.md$", "")


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
