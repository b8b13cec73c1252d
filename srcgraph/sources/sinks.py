"""Sinks: the nested document as JSON, graph scripts, the catalog's contract, and a compact binary form."""

from __future__ import annotations

import gzip
import io
import json
import logging
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from srcgraph import schemas
from srcgraph.functions import literals as L
from srcgraph.operators import propgraph
from srcgraph.runtime import cut, sized, small_batches, stored

log = logging.getLogger("srcgraph")
BATCH = 500
_SPAN = ["start_line", "end_line", "start_column", "end_column"]


# documents

_NEST = {
    "modules": ["module_name", "content_hash", "last_modified", "file_size"],
    "imports": ["ord", "module", "name", "alias", *_SPAN],
    "comments": ["owner_kind", "owner_id", "ord", "content", *_SPAN, "is_docstring"],
    "classes": ["ord", "signature", "name", "parent_kind", "parent_id", "depth", "base_classes", "code", "start_line", "end_line"],
    "callables": ["ord", "signature", "name", "path", "parent_kind", "parent_id", "depth", "decorators", "return_type", "code", "start_line", "end_line", "code_start_line", "cyclomatic_complexity"],
    "parameters": ["callable_signature", "ord", "name", "type", "default_value", *_SPAN],
    "call_sites": ["caller_signature", "ord", "method_name", "receiver_expr", "receiver_type", "argument_types", "return_type", "callee_signature", "is_constructor_call", "start_line", "start_column", "end_line", "end_column"],
    "accessed_symbols": ["callable_signature", "ord", "name", "scope", "kind", "type", "qualified_name", "is_builtin", "lineno", "col_offset"],
    "variables": ["owner_kind", "owner_id", "ord", "name", "type", "initializer", "scope", *_SPAN],
    "attributes": ["class_signature", "ord", "name", "type", "start_line", "end_line"],
}


def nest(file_key: str, rows: dict[str, list[dict]]) -> dict:
    """One module's document from its flat rows."""
    by: dict[tuple, list[dict]] = defaultdict(list)
    owner = {"parameters": "callable_signature", "call_sites": "caller_signature", "accessed_symbols": "callable_signature", "attributes": "class_signature"}
    for name, part in rows.items():
        for r in sorted(part, key=lambda r: r.get("ord", 0)):
            kind = r.pop("owner_kind", None) or r.get("parent_kind", "")
            key = r.pop(owner[name]) if name in owner else r.pop("owner_id", None) or r.get("parent_id", "")
            by[name, kind, key].append(r)

    def take(name: str, key: str, kind: str = "") -> list[dict]:
        return [{k: v for k, v in r.items() if k not in ("ord", "parent_kind", "parent_id", "depth")} for r in by[name, kind, key]]

    def class_(c: dict) -> dict:
        sig = c["signature"]
        attributes = {a["name"]: {**a, "comments": take("comments", f"{sig}.{a['name']}", "attribute")} for a in take("attributes", sig)}
        return {**c, "comments": take("comments", sig, "class"), "methods": callables("class", sig), "attributes": attributes, "inner_classes": classes("class", sig)}

    def classes(kind: str, key: str) -> dict:
        return {c["signature"]: class_(c) for c in take("classes", key, kind)}

    def callables(kind: str, key: str) -> dict:
        return {c["name"]: callable_(c) for c in take("callables", key, kind)}

    def callable_(c: dict) -> dict:
        sig = c["signature"]
        more = {n: take(n, sig) for n in ("parameters", "accessed_symbols", "call_sites")}
        local = [{**v, "value": None} for v in take("variables", sig, "callable")]
        return {**c, **more, "comments": take("comments", sig, "callable"), "inner_callables": callables("callable", sig), "inner_classes": classes("callable", sig), "local_variables": local}

    head = {k: v for m in rows.get("modules", []) for k, v in m.items()}
    own = {"imports": take("imports", ""), "comments": take("comments", file_key, "module"), "classes": classes("module", file_key), "functions": callables("module", file_key)}
    return {"file_path": file_key, **head, **own, "variables": [{**v, "value": None} for v in take("variables", file_key, "module")]}


def module_documents(model) -> DataFrame:
    """(file_key, document): each module's nested document as JSON, made from its one row; what its references are comes as a list, a row a file."""
    refs = model.open_call_sites.filter("callee_ref IS NOT NULL").select("file_key", "callee_ref", "ref_kind").distinct()
    found = refs.join(model.references, (F.col("callee_ref") == F.col("_ref")) & (F.col("ref_kind") == F.col("_how")))
    found = found.groupBy("file_key").agg(F.collect_list(F.struct("callee_ref", "ref_kind", "callee_signature", "is_constructor_call")).alias("found"))
    names = [n for n in _NEST if n != "modules"]
    files = model.extracted.filter("error IS NULL").select("file_key", *_NEST["modules"], *names).join(sized(cut(found), 1 << 17), "file_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                b = whole.slice(at, 1)
                one = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
                column = lambda name: {f.name: c.to_pylist() for f, c in zip(one(name).type.value_type, one(name).flatten().flatten())}  # noqa: E731, B023
                file_key = one("file_key")[0].as_py()
                f = column("found")
                known = dict(zip(zip(f["callee_ref"], f["ref_kind"]), zip(f["callee_signature"], f["is_constructor_call"])))
                rows = {"modules": [{n: one(n)[0].as_py() for n in _NEST["modules"]}]}
                for name in names:
                    c = column(name)
                    if name == "call_sites":
                        callees = [known.get(k, (None, False)) for k in zip(c["callee_ref"], c["ref_kind"])]
                        c["callee_signature"], c["is_constructor_call"] = [x for x, _ in callees], [x for _, x in callees]
                    rows[name] = [dict(zip(_NEST[name], r)) for r in zip(*(c[n] for n in _NEST[name]))]
                document = json.dumps(nest(file_key, rows), separators=(",", ":"))
                yield pa.RecordBatch.from_arrays([pa.array([file_key]), pa.array([document])], names=["file_key", "document"])

    small_batches(files.sparkSession)
    return files.mapInArrow(run, "file_key string, document string")


def document_parts(model) -> Iterator[str]:
    """The application's document, piece by piece, so that the driver never holds it whole."""
    yield '{"symbol_table":{'
    for i, r in enumerate(module_documents(model).orderBy("file_key").toLocalIterator()):
        yield f"{',' * (i > 0)}{json.dumps(r.file_key)}:{r.document}"
    yield '},"call_graph":['
    for i, r in enumerate(model.call_edges.orderBy("source", "target").toLocalIterator()):
        yield "," * (i > 0) + json.dumps(r.asDict(), separators=(",", ":"))
    yield '],"external_symbols":{'
    for i, r in enumerate(model.external_symbols.orderBy("signature").toLocalIterator()):
        yield f"{',' * (i > 0)}{json.dumps(r.signature)}:{json.dumps({'name': r.name, 'module': r.module}, separators=(',', ':'))}"
    yield "}}"


def _write(path: str, parts: Iterator[bytes]) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temp = f"{path}.part"
    with open(temp, "wb") as f:
        for p in parts:
            f.write(p)
    os.replace(temp, path)
    return path


def write_json(model, folder: str) -> str:
    return _write(os.path.join(folder, "analysis.json"), (p.encode() for p in document_parts(model)))


def write_binary(model, folder: str) -> str:
    """The same document, compressed; how much smaller it is goes to the log."""
    plain = 0

    def parts() -> Iterator[bytes]:
        nonlocal plain
        buffer = io.BytesIO()
        with gzip.GzipFile(fileobj=buffer, mode="wb", mtime=0) as z:
            for p in document_parts(model):
                plain += z.write(p.encode())
                yield buffer.getvalue()
                buffer.seek(0)
                buffer.truncate()
        yield buffer.getvalue()

    path = _write(os.path.join(folder, "analysis.json.gz"), parts())
    log.info("%s: compressed %.1f times", path, compression_ratio(plain, os.path.getsize(path)))
    return path


def compression_ratio(plain_bytes: int, packed_bytes: int) -> float:
    return plain_bytes / packed_bytes if packed_bytes else 1.0


def write_documents(model, folder: str) -> str:
    """The same relations without a single file or process: JSON lines by as many tasks as there are, a module, an edge or a symbol a line."""
    line = lambda kind, key, value: F.to_json(F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value")), {"ignoreNullFields": "false"}).alias("value")
    parts = module_documents(model).select(line("module", F.col("file_key"), F.col("document")))
    parts = parts.union(model.call_edges.select(line("edge", F.col("source"), F.to_json(F.struct("*")))))
    parts = parts.union(model.external_symbols.select(line("external", F.col("signature"), F.to_json(F.struct("name", "module"), {"ignoreNullFields": "false"}))))
    parts.write.mode("overwrite").text(folder)
    return folder


def flatten(file_key: str, doc: dict) -> dict[str, list[dict]]:
    """A module's flat rows from its nested document; the inverse of ``nest``, ord being the place in the document."""
    out: dict[str, list[dict]] = {name: [] for name in _NEST}
    place = count(1)

    def put(name: str, rows: Iterable[dict], **owner) -> None:
        for i, r in enumerate(rows):
            out[name].append({k: r.get(k) for k in _NEST[name]} | owner | {"ord": i if name == "parameters" else next(place)})

    def definitions(kind: str, parent: str, depth: int, classes: dict, callables: dict) -> None:
        at = {"parent_kind": kind, "parent_id": parent, "depth": depth}
        for c in classes.values():
            sig = c["signature"]
            put("classes", [c], **at)
            put("comments", c.get("comments", ()), owner_kind="class", owner_id=sig)
            for a in c.get("attributes", {}).values():
                put("attributes", [a], class_signature=sig)
                put("comments", a.get("comments", ()), owner_kind="attribute", owner_id=f"{sig}.{a['name']}")
            definitions("class", sig, depth + 1, c.get("inner_classes", {}), c.get("methods", {}))
        for c in callables.values():
            sig = c["signature"]
            put("callables", [c], **at)
            put("comments", c.get("comments", ()), owner_kind="callable", owner_id=sig)
            put("parameters", c.get("parameters", ()), callable_signature=sig)
            put("accessed_symbols", c.get("accessed_symbols", ()), callable_signature=sig)
            put("call_sites", c.get("call_sites", ()), caller_signature=sig)
            put("variables", c.get("local_variables", ()), owner_kind="callable", owner_id=sig)
            definitions("callable", sig, depth + 1, c.get("inner_classes", {}), c.get("inner_callables", {}))

    put("imports", doc.get("imports", ()))
    put("comments", doc.get("comments", ()), owner_kind="module", owner_id=file_key)
    put("variables", doc.get("variables", ()), owner_kind="module", owner_id=file_key)
    definitions("module", file_key, 0, doc.get("classes", {}), doc.get("functions", {}))
    out["modules"] = [{k: doc.get(k) for k in _NEST["modules"]}]
    return out


def _fields(name: str) -> str:
    """A relation of a document as DDL."""
    if name == "modules":
        return "module_name string, content_hash string, last_modified double, file_size bigint"
    kinds = dict(f.split(" ", 1) for f in schemas.FIELDS[name].split(", "))
    return ", ".join(f"{k} {kinds.get(k, 'boolean' if k.startswith('is_') else 'string')}" for k in _NEST[name])


def relations_of(lines: DataFrame) -> dict[str, DataFrame]:
    """Every relation of (kind, key, value) lines: those of ``_NEST``, call_edges and external_symbols."""
    names = list(_NEST)
    schema = schemas.struct("file_key string, " + ", ".join(f"{n} array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _fields(n).split(', '))}>>" for n in names))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [flatten(k, json.loads(v)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], arrow.field(n).type) for n in names)], schema=arrow)

    docs = stored(lines.filter("kind = 'module'").select("key", "value").mapInArrow(run, schema))
    out = {n: docs.select("file_key", F.inline(n)) for n in names}
    edge = lines.filter("kind = 'edge'").select(F.from_json("value", schemas.CALL_EDGES).alias("e")).select("e.*")
    symbol = lines.filter("kind = 'external'").select(F.col("key").alias("signature"), F.from_json("value", "name string, module string").alias("x")).select("signature", "x.*")
    return out | {"call_edges": edge, "external_symbols": symbol}


def read_documents(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What ``write_documents`` wrote, as relations."""
    return relations_of(spark.read.text(folder).select(F.from_json("value", "kind string, key string, value string").alias("r")).select("r.*"))


def _taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            doc = json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
            rows = [("module", k, json.dumps(m)) for k, m in doc["symbol_table"].items()]
            rows += [("edge", e["source"], json.dumps(e)) for e in doc["call_graph"]]
            rows += [("external", k, json.dumps(v)) for k, v in doc["external_symbols"].items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["kind", "key", "value"])


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of one document, plain or compressed: a task takes it apart, so that the driver doesn't hold it; larger ones are for ``read_documents``."""
    whole = spark.read.format("binaryFile").load(path if "://" in path else f"file://{os.path.abspath(path)}").select("content")
    return relations_of(cut(whole.mapInArrow(_taken_apart, "kind string, key string, value string")))


# graph scripts


def _pairs(props: Column) -> Column:
    return L.mapping(F.transform(F.map_entries(props), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("literal"))))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_n``: a row's place within its group by ``order``, from 0.

    Rows are range-partitioned, so that a group however large is sorted by many tasks; what a partition has of a group
    is counted, and the counts of partitions before give each row's offset.
    """
    placed = cut(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)).withColumn("_i", F.monotonically_increasing_id())
    placed = placed.withColumn("_p", F.shiftright("_i", 33))
    parts = placed.groupBy(*group, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_lo"))
    before = F.sum("_c").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*group, "_p", "_lo", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(sized(parts, 256), [*group, "_p"]).withColumn("_n", F.col("_before") + F.col("_i") - F.col("_lo")).drop("_i", "_p", "_lo", "_before")


def _statements(rows: DataFrame, group: list[str], order: list[str], line: Column, size: int, more: list[str] = []) -> DataFrame:
    """Groups' batches: (group..., batch, n, rows, first, more...), ``first`` the group's least key."""
    # made once: finding ranges, numbering and the least keys each read them
    rows = stored(rows.withColumn("line", line).select(*{c: None for c in (*group, *more, "line", *order, "key")}))
    b = numbered(rows.drop("key") if "key" not in order else rows, group, order).withColumn("batch", F.floor(F.col("_n") / size).cast("long"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), ",\n")
    s = b.groupBy(*group, "batch").agg(F.count("*").alias("n"), lines.alias("rows"), *[F.first(c).alias(c) for c in more])
    least = rows.groupBy(*group).agg(F.min("key").alias("first"))
    return s.join(sized(least, 256), group)


def node_statements(nodes: DataFrame, size: int = BATCH) -> DataFrame:
    """(first, batch, n, statement), ordered by (first, batch): one statement for each batch of nodes with the same labels and key."""
    g = nodes.withColumn("group", F.concat_ws(":", "labels")).withColumn("key", F.concat_ws(" ", F.col("labels")[0], "value"))
    line = F.concat(F.lit("  {k: "), L.text(F.col("value")), F.lit(", p: "), _pairs(F.col("props")), F.lit("}"))
    s = _statements(g, ["group", "key_prop"], ["key"], line, size, ["labels"])
    extra = F.when(F.size("labels") > 1, F.concat(F.lit(", n:"), F.array_join(F.slice("labels", 2, 100), ":"))).otherwise("")
    text = F.concat(F.lit("UNWIND [\n"), "rows", F.lit("\n] AS row\nMERGE (n:"), F.col("labels")[0], F.lit(" {"), "key_prop", F.lit(": row.k})\nSET n += row.p"), extra, F.lit(";"))
    return s.select("first", "batch", "n", text.alias("statement"))


def edge_statements(edges: DataFrame, size: int = BATCH) -> DataFrame:
    """(first, batch, n, statement): one statement for each batch of edges of the same type between the same labels."""
    g = edges.withColumn("key", F.concat_ws(" ", "type", "from_value", "to_value"))
    line = F.concat(F.lit("  {f: "), L.text(F.col("from_value")), F.lit(", t: "), L.text(F.col("to_value")), F.lit(", p: "), _pairs(F.col("props")), F.lit("}"))
    s = _statements(g, ["type", "from_label", "from_key", "to_label", "to_key"], ["key", "ord"], line, size)
    end = lambda name, side, var: F.concat(F.lit(f"MATCH ({name}:"), f"{side}_label", F.lit(" {"), f"{side}_key", F.lit(f": row.{var}}})\n"))
    text = F.concat(F.lit("UNWIND [\n"), "rows", F.lit("\n] AS row\n"), end("a", "from", "f"), end("b", "to", "t"), F.lit("MERGE (a)-[r:"), "type", F.lit("]->(b)\nSET r += row.p;"))
    return s.select("first", "batch", "n", text.alias("statement"))


def wipe_statement(app_name: str) -> str:
    name = app_name
    for raw, escaped in L.ESCAPES:
        name = name.replace(raw, escaped)
    parts = "|".join(schemas.CONTAINMENT)
    return f"MATCH (a:PyApplication {{name: '{name}'}})\nOPTIONAL MATCH (a)-[:PY_HAS_MODULE]->(m:PyModule)\nOPTIONAL MATCH (m)-[:{parts}*1..]->(x)\nDETACH DELETE x, m, a;"


def script_parts(nodes: DataFrame, edges: DataFrame, app_name: str) -> Iterator[str]:
    """The graph script's lines, statement by statement."""
    yield "// constraints, indexes\n" + "\n".join(f"{s};" for s in [*schemas.constraints(), *schemas.INDEXES])
    yield "\n\n// what an earlier run left of this application; nodes that no module owns stay\n" + wipe_statement(app_name)
    for title, statements in (("nodes", node_statements(nodes)), ("relationships", edge_statements(edges))):
        yield f"\n\n// {title}"
        for r in statements.orderBy("first", "batch").toLocalIterator():
            yield "\n" + r.statement
    yield "\n"


def write_script(model, folder: str, app_name: str) -> str:
    nodes, edges = propgraph.project(model, app_name)
    return _write(os.path.join(folder, "graph.cypher"), (p.encode() for p in script_parts(nodes, edges, app_name)))


def write_contract(folder: str | None = None) -> str:
    """The catalog as JSON: to a file, or returned if there is no folder."""
    text = json.dumps(schemas.catalog_document(), indent=2) + "\n"
    return text if folder is None else _write(os.path.join(folder, "graph-schema.json"), iter([text.encode()]))
