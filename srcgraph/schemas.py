"""Relations of the code model as Spark types, and the catalog of the property graph.

The model is flat: nested definitions are rows with ``parent_kind``, ``parent_id`` and ``depth``. ``ord`` is the place in
the file's pre-order, so anything that depends on order says so. Positions that aren't known are -1, not null.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

SCOPES = tuple("local nonlocal global class module".split())
KINDS = tuple("variable parameter attribute function class module".split())
PROVENANCE = ("jedi", "pycg", "joern")
GRAPH_VERSION = "1.1.0"

_SPAN = "start_line int, end_line int, start_column int, end_column int"

#: Fields of each relation within a file's row, without the file's key.
FIELDS: dict[str, str] = {
    "imports": f"ord int, module string, name string, alias string, {_SPAN}",
    "comments": f"owner_kind string, owner_id string, ord int, content string, {_SPAN}, is_docstring boolean",
    "classes": "ord int, signature string, name string, parent_kind string, parent_id string, depth int, base_classes array<string>, base_refs array<string>, code string, start_line int, end_line int",
    "callables": "ord int, signature string, name string, path string, parent_kind string, parent_id string, depth int, decorators array<string>, return_type string, code string, start_line int, end_line int, code_start_line int, cyclomatic_complexity int",
    "parameters": f"callable_signature string, ord int, name string, type string, default_value string, {_SPAN}",
    "call_sites": "caller_signature string, ord int, method_name string, receiver_expr string, receiver_type string, argument_types array<string>, return_type string, callee_ref string, ref_kind string, start_line int, start_column int, end_line int, end_column int",
    "accessed_symbols": "callable_signature string, ord int, name string, scope string, kind string, type string, qualified_name string, is_builtin boolean, lineno int, col_offset int",
    "variables": f"owner_kind string, owner_id string, ord int, name string, type string, initializer string, scope string, {_SPAN}",
    "attributes": "class_signature string, ord int, name string, type string, start_line int, end_line int",
    "bindings": "dotted string, target string",
    "flows": "kind string, a string, b string, c string, n int",
}

SOURCE_FILES = "file_key string, source string, last_modified double, file_size bigint, content_hash string, error string"
MODULE = "file_key string, module_name string, dotted string, content_hash string, last_modified double, file_size bigint, error string"


def column(name: str) -> str:
    """A relation as a column of its file's row."""
    return f"{name} array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FIELDS[name].split(', '))}>>"


EXTRACTED = ", ".join([MODULE, *map(column, FIELDS)])
CALL_EDGES = "source string, target string, type string, weight bigint, provenance array<string>"
EXTERNALS = "signature string, name string, module string"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class NodeLabel:
    """A label of the graph, the label and property it is merged on, and its properties' types."""

    label: str
    merge_label: str
    key: str
    properties: dict[str, str]


@dataclass(frozen=True)
class RelationType:
    """A relationship type, the labels it may join, and its properties' types."""

    type: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    properties: dict[str, str] = field(default_factory=dict)


def _props(text: str) -> dict[str, str]:
    """'a b:integer' -> {'a': 'string', 'b': 'integer'}"""
    return {k: t or "string" for k, _, t in (x.partition(":") for x in text.split())}


_LINES = "start_line:integer end_line:integer"
NODE_LABELS = tuple(
    NodeLabel(label, merge, key, _props(props))
    for label, merge, key, props in (
        ("PyApplication", "PyApplication", "name", "name schema_version"),
        ("PyModule", "PyModule", "file_key", "file_key module_name content_hash last_modified:float file_size:integer _module"),
        ("PyClass", "PySymbol", "signature", f"signature name code base_classes:string[] docstring {_LINES} _module"),
        ("PyCallable", "PySymbol", "signature", f"signature name path return_type cyclomatic_complexity:integer code code_start_line:integer {_LINES} docstring decorators:string[] parameters_json accessed_symbols_json _module"),
        ("PyExternal", "PySymbol", "signature", "signature name module"),
        ("PyPackage", "PyPackage", "name", "name"),
        ("PyDecorator", "PyDecorator", "name", "name"),
        ("PyCallSite", "PyCallSite", "id", "id method_name receiver_expr receiver_type argument_types:string[] return_type callee_signature is_constructor_call:boolean start_line:integer start_column:integer end_line:integer end_column:integer _module"),
        ("PyAttribute", "PyAttribute", "id", f"id name type docstring {_LINES} _module"),
        ("PyVariable", "PyVariable", "id", f"id name type initializer scope {_LINES} _module"),
    )
)
_CALLS = ("PyCallable", "PyExternal")
RELATION_TYPES = (
    RelationType("PY_HAS_MODULE", ("PyApplication",), ("PyModule",)),
    RelationType("PY_DECLARES", ("PyModule", "PyClass", "PyCallable"), ("PyClass", "PyCallable")),
    RelationType("PY_HAS_METHOD", ("PyClass",), ("PyCallable",)),
    RelationType("PY_HAS_ATTRIBUTE", ("PyClass",), ("PyAttribute",)),
    RelationType("PY_DECLARES_VAR", ("PyModule", "PyCallable"), ("PyVariable",)),
    RelationType("PY_HAS_CALLSITE", ("PyCallable",), ("PyCallSite",)),
    RelationType("PY_RESOLVES_TO", ("PyCallSite",), _CALLS),
    RelationType("PY_CALLS", _CALLS, _CALLS, _props("weight:integer provenance:string[]")),
    RelationType("PY_EXTENDS", ("PyClass",), ("PyClass",)),
    RelationType("PY_IMPORTS", ("PyModule",), ("PyPackage",), _props("imported_names:string[] aliases:string[]")),
    RelationType("PY_DECORATED_BY", ("PyCallable",), ("PyDecorator",)),
)
#: Relationships that hold a module's own parts together.
CONTAINMENT = ("PY_DECLARES", "PY_HAS_METHOD", "PY_HAS_ATTRIBUTE", "PY_DECLARES_VAR", "PY_HAS_CALLSITE")


def constraints() -> list[str]:
    """A uniqueness constraint for each merge label and key, in the catalog's order."""
    return [f"CREATE CONSTRAINT {label.lower()}_{key} IF NOT EXISTS FOR (x:{label}) REQUIRE x.{key} IS UNIQUE" for label, key in dict.fromkeys((n.merge_label, n.key) for n in NODE_LABELS)]


INDEXES = [f"CREATE INDEX py_{what.lower()}_name IF NOT EXISTS FOR (c:Py{what}) ON (c.name)" for what in ("Callable", "Class")]
_TEXT = ", ".join(f"c.{p}" for p in ("code", "docstring"))
INDEXES.append(f"CREATE FULLTEXT INDEX {'py_code_fts'} IF NOT EXISTS FOR (c:PyCallable) ON EACH [{_TEXT}]")


def catalog_document(generator: str = "srcgraph") -> dict:
    """The contract as one JSON-ready document."""
    head = {"schema_version": GRAPH_VERSION, "generator": generator, "marker_labels": []}
    named = {"sources": "from", "targets": "to"}
    listed = lambda v: list(v) if isinstance(v, tuple) else v
    return head | {
        "node_labels": [asdict(n) for n in NODE_LABELS],
        "relationship_types": [{named.get(k, k): listed(v) for k, v in asdict(r).items()} for r in RELATION_TYPES],
        "constraints": constraints(),
        "indexes": list(INDEXES),
    }
