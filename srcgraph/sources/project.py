"""The ``pyproject`` data source: Python files of a source tree as rows.

Spark's own file formats pass over names that begin with '_' or '.', so ``__init__.py`` would be lost; this source lists
folders itself and reads files in its partitions. Options: ``path`` (the project); ``file`` (one file of it); ``skip_tests``
(false); ``skip_dirs`` (comma-separated components, tested against the relative path); ``files_per_partition``. Keys are
relative to the project. A file that can't be read or isn't UTF-8 has a row with ``error``. Filters on ``file_key``
(=, IN, prefix) are pushed down, so that other files aren't opened.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from srcgraph import schemas
from srcgraph.functions import names

SKIP_DIRS = names.ENTRY_SKIP[:3]


def is_test(rel: str) -> bool:
    parts = rel.split("/")
    return "test" in parts or "tests" in parts or parts[-1].startswith("test_") or parts[-1].endswith("_test.py")


def list_files(root: str, skip_dirs: tuple[str, ...] = SKIP_DIRS, skip_tests: bool = False, one: str | None = None) -> list[str]:
    """Relative paths of a project's ``*.py`` files, sorted."""
    if one:
        rel = os.path.relpath(one, root) if os.path.isabs(one) else one
        return [rel.replace(os.sep, "/")]
    out = []
    for at, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip_dirs)
        for f in files:
            rel = os.path.relpath(os.path.join(at, f), root).replace(os.sep, "/")
            if f.endswith(".py") and not (skip_tests and is_test(rel)):
                out.append(rel)
    return sorted(out)


@dataclass
class _Files(InputPartition):
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path") or ""
        if not self.root:
            raise ValueError("the option path is missing")
        self.one = options.get("file")
        self.skip_tests = str(options.get("skip_tests", "false")).lower() == "true"
        self.skip_dirs = tuple(x for x in options.get("skip_dirs", ",".join(SKIP_DIRS)).split(",") if x)
        self.per = int(options.get("files_per_partition", "16"))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and tuple(f.attribute) == ("file_key",):
                self.wanted.append(f)
            else:
                yield f

    def _fits(self, name: str) -> bool:
        return all(name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value) for f in self.wanted)

    def partitions(self) -> list[_Files]:
        found = [n for n in list_files(self.root, self.skip_dirs, self.skip_tests, self.one) if self._fits(n)]
        return [_Files(tuple(found[i : i + self.per])) for i in range(0, len(found), self.per)] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names:
            path = os.path.join(self.root, name)
            try:
                stat = os.stat(path)
                with open(path, "rb") as f:
                    raw = f.read()
                yield name, raw.decode("utf-8"), stat.st_mtime, stat.st_size, hashlib.sha256(raw).hexdigest(), None
            except (OSError, UnicodeDecodeError) as e:
                yield name, None, None, None, None, f"{type(e).__name__}: {e}"


class PyProject(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pyproject"

    def schema(self) -> str:
        return schemas.SOURCE_FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_project(spark: SparkSession, path: str, **options) -> DataFrame:
    """``source_files`` of a project."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PyProject)
    r = spark.read.format("pyproject").option("path", path)
    for k, v in options.items():
        if v is not None:
            r = r.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return r.load()


def project_checksum(root: str) -> str:
    """SHA-256 over the bytes of a project's Python files, in order of their paths."""
    out = hashlib.sha256()
    for path in sorted(Path(root).rglob("*.py")):
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                out.update(piece)
    return out.hexdigest()
