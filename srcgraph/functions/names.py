"""Scalar functions on signatures, paths and ids, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has_dot(sig: Column) -> Column:
    return F.instr(sig, ".") > 0


def last_part(sig: Column) -> Column:
    """What follows the last dot, or all."""
    return F.substring_index(sig, ".", -1)


def parent(sig: Column) -> Column:
    """What precedes the last dot, or ''."""
    return F.when(_has_dot(sig), F.regexp_extract(sig, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))


def owner_module(sig: Column) -> Column:
    """What precedes the last dot, or all."""
    return F.when(_has_dot(sig), parent(sig)).otherwise(sig)


def path_to_dotted(rel: Column, compat: bool = False) -> Column:
    """A project-relative path as a dotted name; ``compat`` drops every '.py' in it, not only the suffix."""
    dotted = F.replace(rel, F.lit("/"), F.lit("."))
    return F.replace(dotted, F.lit(".py"), F.lit("")) if compat else F.regexp_replace(dotted, r"\.py$", "")


def call_site_id(file_key: Column, start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(file_key, F.lit("#"), s(start_line), F.lit(":"), s(start_column), F.lit("-"), s(end_line), F.lit(":"), s(end_column))


def variable_id(owner: Column, name: Column, line: Column) -> Column:
    return F.concat(owner, F.lit("#"), name, F.lit("@"), line.cast("string"))


def attribute_id(class_signature: Column, name: Column) -> Column:
    return F.concat(class_signature, F.lit("."), name)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def is_test_path(rel: Column) -> Column:
    """A component ``test`` or ``tests``, or a file ``test_*`` or ``*_test.py``."""
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(F.lit("test"), F.lit("tests"))) | name.startswith("test_") | name.endswith("_test.py")


#: Folders that level 2 doesn't start from.
ENTRY_SKIP = ("site-packages", ".venv", ".srcgraph", "venv", "env", "node_modules", "__pycache__", ".git", ".tox", "build", "dist", "test", "tests", ".eggs")


def is_entry_point(rel: Column, skip_tests: bool = True) -> Column:
    """Whether level 2 starts from a file: none in a folder of ``ENTRY_SKIP``, no test and no ``conftest.py``."""
    parts = F.split(rel, "/")
    skip = [d for d in ENTRY_SKIP if skip_tests or d not in ("test", "tests")]
    folders = F.slice(parts, 1, F.size(parts) - 1)
    out = ~F.arrays_overlap(folders, F.array(*map(F.lit, skip)))
    return out & ~is_test_path(rel) & (F.element_at(parts, -1) != "conftest.py") if skip_tests else out
