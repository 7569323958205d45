"""Column helpers for folder / file names and paths (all native expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names skipped while walking a course tree (levels 1 to 3).
IGNORED_DIRS = [".git", ".hg", ".bzr", ".idea", ".vscode", ".", "assets", "drafts"]

# Block file suffixes and the block type they make (checked in this order).
PROBLEM_SUFFIX = ".prob.md"
HTML_SUFFIX = ".md"
EDITOR_SUFFIX = ".repl.yaml"
PROBLEM_REPL_SUFFIX = ".prob.repl.yaml"

_INT_RE = r"^[+-]?[0-9]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_dir_name(c) -> Column:
    """PRJ-1: ``"02_Intro_x"`` → struct(idx=2, name="Intro_x"); NULL fields when invalid.

    The name is split at the first ``_``; the prefix must be an integer (no spaces).
    """
    parts = F.split(_c(c), "_", 2)
    valid = (F.size(parts) == 2) & parts[0].rlike(_INT_RE)
    return F.struct(
        F.when(valid, parts[0].try_cast("int")).alias("idx"),
        F.when(valid, parts[1]).alias("name"),
    )


def join_dir_name(idx, name) -> Column:
    """PRJ-2: ``%02d_<name>``."""
    return F.format_string("%02d_%s", _c(idx), _c(name))


def classify_block(name) -> Column:
    """PRJ-4: block type from a file name; NULL when the file is not a block."""
    n = _c(name)
    return (F.when(n.endswith(PROBLEM_SUFFIX), F.lit("problem"))
            .when(n.endswith(HTML_SUFFIX), F.lit("html"))
            .when(n.endswith(EDITOR_SUFFIX) & ~n.endswith(PROBLEM_REPL_SUFFIX), F.lit("exleditor")))


def block_display_name(name) -> Column:
    """PRJ-5: text before the first ``.``."""
    return F.substring_index(_c(name), ".", 1)


def fs_path(path) -> Column:
    """PRJ-6: last three folders plus the file name."""
    return F.array_join(F.slice(F.split(_c(path), "/"), -4, 4), "/")


def clean_path(p) -> Column:
    """Lexical path clean-up: drop ``.`` segments, collapse ``//``, strip a trailing ``/``.

    ``..`` segments are kept (they are rejected where it matters)."""
    parts = F.filter(F.split(_c(p), "/"), lambda s: (s != "") & (s != "."))
    cleaned = F.array_join(parts, "/")
    return F.when(cleaned == "", F.lit(".")).otherwise(cleaned)


def resolve_path(p) -> Column:
    """``clean_path`` with ``..`` segments resolved (``a/b/../c`` → ``a/c``); a ``..`` that leads
    above the root stays."""
    up = F.lit("..")
    parts = F.split(clean_path(p), "/")
    out = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(
        (s == up) & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), up) != up),
        F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(out, "/")


def repl_ref(answer) -> Column:
    """PRJ-7: ``#!exl::repl('x')`` → cleaned relative path ``x``; NULL for anything else."""
    a = _c(answer)
    ok = a.startswith("#!exl::repl('") & a.endswith("')")
    inner = F.regexp_replace(F.regexp_replace(a, r"^#!exl::repl\('", ""), r"'\)$", "")
    return F.when(ok, clean_path(inner))


def is_ignored_path(path) -> Column:
    """FLT-1: any of the folders at levels 1..3 is an ignored name."""
    names = "|".join(re.escape(x) for x in IGNORED_DIRS)
    return _c(path).rlike(rf"^(?:[^/]*/){{0,2}}(?:{names})/")


def in_repl_folder(path) -> Column:
    """FLT-2: a folder at levels 1..3 named ``*.repl`` is never a level."""
    return _c(path).rlike(r"^(?:[^/]*/){0,2}[^/]*\.repl/")
