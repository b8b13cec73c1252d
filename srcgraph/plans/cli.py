"""Command line: ``python -m srcgraph.plans.cli -i PROJECT``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from srcgraph import VERSION
from srcgraph.operators import propgraph, shards
from srcgraph.operators.pointsto import MAX_FACTS, MAX_ITER
from srcgraph.operators.store import GraphStore
from srcgraph.plans.engine import AnalysisError, Engine, Options
from srcgraph.schemas import GRAPH_VERSION
from srcgraph.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="srcgraph", description="Analyse a Python project: symbol table, call graph, property graph.")
    p.add_argument("--version", action="version", version=f"srcgraph {VERSION}, graph schema {GRAPH_VERSION}")
    p.add_argument("-i", "--input", help="the project's folder")
    p.add_argument("-o", "--output", help="folder for what is written; without it the document goes to standard output")
    p.add_argument("-f", "--format", choices=["json", "lines", "parquet", "binary"], default="json", help="lines: JSON lines in a folder, written by all tasks")
    p.add_argument("--emit", choices=["json", "graph", "schema"], default="json")
    p.add_argument("--app-name", help="name of the application node; the folder's name by default")
    p.add_argument("-a", "--analysis-level", dest="level", type=int, default=1, choices=[1, 2])
    p.add_argument("--eager", dest="rebuild", action=argparse.BooleanOptionalAction, default=False, help="don't use the cache")
    p.add_argument("--skip-tests", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--file-name", dest="file", help="analyse one file of the project")
    p.add_argument("-c", "--cache-dir")
    p.add_argument("--clear-cache", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--shard", action=argparse.BooleanOptionalAction, default=None, help="level 2 by shards where a project is too large for one; on unless refused")
    p.add_argument("--shard-budget", type=int, default=shards.BUDGET)
    p.add_argument("--shard-strategy", choices=["coupling", "package"], default="coupling")
    p.add_argument("--max-iter", type=int, default=MAX_ITER)
    p.add_argument("--max-facts", type=int, default=MAX_FACTS, help="points-to facts after which a shard is planned again, smaller")
    p.add_argument("--store", help="graph store to push to, with --emit graph")
    p.add_argument("--compat", action="store_true", help="observed instead of documented behaviour, see operators.extract")
    p.add_argument("--strict", action="store_true", help="stop at the first file that can't be parsed")
    p.add_argument("-v", "--verbose", dest="verbosity", action="count", default=0)
    return p


def emit(spark: SparkSession, o: Options) -> None:
    with Engine(spark, o) as engine:
        model = engine.analyze()
        if o.emit == "graph":
            if o.store:
                GraphStore(spark, o.store).push(*propgraph.project(model, o.name), o.name, full=o.file is None)
            else:
                print(sinks.write_script(model, o.output or os.getcwd(), o.name))
        elif o.output is None:
            for part in sinks.document_parts(model):
                sys.stdout.write(part)
            sys.stdout.write("\n")
        elif o.format == "lines":
            print(sinks.write_documents(model, f"{o.output.rstrip('/')}/analysis"))
        elif o.format == "parquet":
            for name in ("modules", "imports", "comments", "classes", "callables", "parameters", "call_sites", "accessed_symbols", "variables", "attributes", "call_edges", "external_symbols", "parse_errors"):
                getattr(model, name).write.mode("overwrite").parquet(os.path.join(o.output, name))
        else:
            print((sinks.write_json if o.format == "json" else sinks.write_binary)(model, o.output))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbosity, 2)])
    if a.emit == "schema":
        got = sinks.write_contract(a.output)
        print(got, end="" if a.output is None else "\n")
        return 0
    if not a.input:
        print("--input is missing", file=sys.stderr)
        return 1
    try:
        options = Options(**vars(a))
        spark = SparkSession.builder.appName("srcgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        emit(spark, options)
    except (AnalysisError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
