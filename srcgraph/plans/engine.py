"""The engine: options in, a code model of lazily built relations out.

One pass over the source feeds every relation; it is written once to the shared folder (or taken from the cache) because a
dozen relations read it. ``analyze`` gives the model; sinks are in ``sources.sinks`` and ``operators.store``.
"""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions import names as N
from srcgraph.operators import callgraph, pointsto, relations, resolve, shards
from srcgraph.operators.extract import extract
from srcgraph.runtime import cut, remove, sized
from srcgraph.sources import cache
from srcgraph.sources.project import list_files, read_project

log = logging.getLogger("srcgraph")


class AnalysisError(Exception):
    """The input can't be analysed."""


class InputNotFound(AnalysisError):
    """There is no such project or file."""


@dataclass(frozen=True)
class Options:
    input: str
    output: str | None = None
    format: str = "json"
    emit: str = "json"
    app_name: str | None = None
    level: int = 1
    rebuild: bool = False
    skip_tests: bool = True
    file: str | None = None
    cache_dir: str | None = None
    clear_cache: bool = False
    shard: bool | None = None
    shard_budget: int = shards.BUDGET
    shard_strategy: str = "coupling"
    max_iter: int = pointsto.MAX_ITER
    max_facts: int = pointsto.MAX_FACTS
    store: str | None = None
    compat: bool = False
    strict: bool = False
    verbosity: int = 0

    def __post_init__(self) -> None:
        wrong = [
            message
            for bad, message in (
                (self.level not in (1, 2), "level must be 1 or 2"),
                (self.format not in ("json", "lines", "parquet", "binary"), "format must be json, lines, parquet or binary"),
                (self.emit not in ("json", "graph", "schema"), "emit must be json, graph or schema"),
                (self.shard_budget < 1, "shard_budget must be at least 1"),
                (self.shard_strategy not in ("coupling", "package"), "shard_strategy must be coupling or package"),
                (self.max_iter < -1, "max_iter must be at least -1"),
                (self.max_facts < 1, "max_facts must be at least 1"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def name(self) -> str:
        return self.app_name or os.path.basename(os.path.abspath(self.input))


@dataclass
class CodeModel:
    """Relations of one project."""

    spark: SparkSession
    extracted: DataFrame
    options: Options = field(default_factory=lambda: Options("."))

    def _rel(self, name: str) -> DataFrame:
        return relations.relation(self.extracted, name)

    @cached_property
    def modules(self) -> DataFrame:
        return relations.modules(self.extracted)

    @cached_property
    def parse_errors(self) -> DataFrame:
        return relations.parse_errors(self.extracted)

    imports = property(lambda self: self._rel("imports"))
    comments = property(lambda self: self._rel("comments"))
    classes = property(lambda self: self._rel("classes"))
    callables = property(lambda self: self._rel("callables"))
    parameters = property(lambda self: self._rel("parameters"))
    accessed_symbols = property(lambda self: self._rel("accessed_symbols"))
    variables = property(lambda self: self._rel("variables"))
    attributes = property(lambda self: self._rel("attributes"))

    @cached_property
    def references(self) -> DataFrame:
        """What distinct references are; to be broadcast where they are few."""
        return sized(cut(resolve.references(self.extracted)), 256)

    @property
    def call_sites(self) -> DataFrame:
        """Joined where it is used, so that only the columns in use are moved. ``references`` leaves no constructor without a callee to be looked for."""
        return resolve.with_callees(self.open_call_sites, self.references)

    @property
    def open_call_sites(self) -> DataFrame:
        """The call sites with references instead of callees."""
        return self._rel("call_sites")

    @cached_property
    def level_1(self) -> DataFrame:
        return cut(callgraph.typed(resolve.callees(self.open_call_sites, self.references)))

    @cached_property
    def module_graph(self) -> DataFrame:
        return cut(callgraph.module_graph(self.level_1, relations.signature_to_file(self.callables, self.classes)))

    @cached_property
    def shard_assignment(self) -> DataFrame:
        """(shard_id, file_key): by coupling or by package."""
        o = self.options
        files = self.entry_files
        if o.shard_strategy == "package":
            roots = shards.package_roots(files)
            ids = roots.select(F.when(F.col("root") == "", F.col("file_key")).otherwise(F.col("root")).alias("package"), "file_key")
            sizes = cut(ids.groupBy("package").agg(F.count("*").alias("n")))
            over = sizes.filter(F.col("n") > o.shard_budget).count()
            if over:
                log.warning("%d packages have more than %d files and no level-2 edges of their own", over, o.shard_budget)
            return cut(shards.numbered(ids.join(sizes.filter(F.col("n") <= o.shard_budget), "package"), "package"))
        return cut(shards.plan_shards(files, self.module_graph, o.shard_budget))

    @cached_property
    def entry_files(self) -> DataFrame:
        """(file_key) of the files that level 2 looks at."""
        return self.modules.filter(N.is_entry_point(F.col("file_key"), self.options.skip_tests)).select("file_key")

    @cached_property
    def level_2(self) -> DataFrame:
        """Points-to edges: of the whole project up to a size, of shards beyond it; ``shard=False`` leaves larger projects at level 1."""
        o = self.options
        files = self.entry_files
        n = files.count()
        if n <= pointsto.WHOLE_PROJECT_FILES:  # max_facts is for shards, which can be planned again
            return cut(pointsto.points_to_edges(self.extracted, files.withColumn("shard_id", F.lit(0).cast("long")), o.max_iter))
        if o.shard is False:
            log.warning("%d files are over the limit of %d for one level-2 analysis, and sharding is off: level 1 only", n, pointsto.WHOLE_PROJECT_FILES)
            return self.level_1.limit(0)
        graph = self.module_graph
        replan = lambda files, budget: shards.plan_shards(files, graph.join(files.select(F.col("file_key").alias("src_file")), "src_file", "left_semi").join(files.select(F.col("file_key").alias("dst_file")), "dst_file", "left_semi"), budget)
        return cut(pointsto.decomposed_edges(self.extracted, self.shard_assignment, replan, shards.budgets(o.shard_budget), o.max_iter, o.max_facts))

    @cached_property
    def call_edges(self) -> DataFrame:
        if self.options.level < 2:  # a site's caller is a callable of its file, so that each edge has an end in the project
            return self.level_1
        return cut(callgraph.app_edges(callgraph.merge_edges(self.level_1, self.level_2), relations.declared_signatures(self.callables, self.classes)))

    @cached_property
    def external_symbols(self) -> DataFrame:
        return callgraph.external_symbols(self.call_edges, relations.declared_signatures(self.callables, self.classes))

    @cached_property
    def ends(self) -> DataFrame:
        """(signature, kind, name, module) of the call edges' ends."""
        return cut(callgraph.endpoint_kinds(self.call_edges, self.external_symbols, relations.declared_signatures(self.callables, self.classes)))


class Engine:
    """``with Engine(spark, Options(...)) as e: model = e.analyze()``"""

    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.options = spark, options
        self.cache = f"{(options.cache_dir or os.path.abspath(options.input)).rstrip('/')}/.srcgraph"
        self.cache_uri = self.cache if "://" in self.cache or self.cache.startswith("file:") else f"file://{os.path.abspath(self.cache)}"

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        if self.options.clear_cache:
            remove(self.spark, self.cache_uri)

    def analyze(self) -> CodeModel:
        o = self.options
        if not os.path.isdir(o.input):
            raise InputNotFound(f"{o.input} is not a folder")
        if o.file and not list_files(o.input, one=o.file):
            raise InputNotFound(o.file)
        files = read_project(self.spark, o.input, file=o.file, skip_tests=o.skip_tests)
        cached = None if o.rebuild or o.compat else cache.read_cache(self.spark, self.cache_uri)
        extracted = cut(cache.extract_changed(files, cached, o.compat))
        counts = extracted.agg(F.count("*"), F.count("error")).first()
        log.info("%d files, of which %d can't be parsed", *counts)
        if not o.file and not o.compat and not o.clear_cache:
            cache.write_cache(extracted, self.cache_uri)
        model = CodeModel(self.spark, extracted, o)
        if o.strict and (bad := model.parse_errors.first()) is not None:
            raise AnalysisError(f"{bad.file_key}: {bad.error}")
        return model


def analyze_sources(spark: SparkSession, files: DataFrame, options: Options | None = None) -> CodeModel:
    """The model of ``source_files`` that are rows already."""
    o = options or Options(".")
    return CodeModel(spark, cut(extract(files, compat=o.compat)), o)
