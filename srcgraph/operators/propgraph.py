"""Projection of the code model into a labelled property graph.

Nodes: (labels, key_prop, value, props, ord); edges: (type, from_label, from_key, from_value, to_label, to_key, to_value,
props, ord). ``labels[0]`` is the label that a node is merged on. ``props`` is a map from property to script literal, which keeps
every value of the catalog's types; null properties are left out, empty lists are not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgraph import schemas
from srcgraph.functions import literals as L
from srcgraph.functions import names as N
from srcgraph.runtime import cut, sized

_CATALOG = {n.label: n for n in schemas.NODE_LABELS}
_RELATIONS = {r.type: r for r in schemas.RELATION_TYPES}


def _props(kinds: dict[str, str], values: dict[str, Column]) -> Column:
    """A map of those values that aren't null, in the given order."""
    pairs = [F.struct(F.lit(k).alias("key"), F.when(v.isNotNull(), L.literal(v, kinds[k])).alias("value")) for k, v in values.items()]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def node(df: DataFrame, label: str, value: Column, order: Column, **values: Column) -> DataFrame:
    n = _CATALOG[label]
    labels = [n.merge_label] + ([label] if label != n.merge_label else [])
    return df.select(F.array(*map(F.lit, labels)).alias("labels"), F.lit(n.key).alias("key_prop"), value.alias("value"), _props(n.properties, values).alias("props"), order.alias("ord"))


def edge(df: DataFrame, kind: str, source: tuple[str, Column], target: tuple[str, Column], order: Column, **values: Column) -> DataFrame:
    """``source`` and ``target``: (merge label, value)."""
    key = {n.merge_label: n.key for n in schemas.NODE_LABELS}
    ends = [c for side, (label, v) in (("from", source), ("to", target)) for c in (F.lit(label).alias(f"{side}_label"), F.lit(key[label]).alias(f"{side}_key"), v.alias(f"{side}_value"))]
    return df.select(F.lit(kind).alias("type"), *ends, _props(_RELATIONS[kind].properties, values).alias("props"), order.alias("ord"))


def docstrings(comments: DataFrame) -> DataFrame:
    """(owner_kind, owner_id, file_key, docstring): an owner's docstrings, a line each."""
    d = comments.filter("is_docstring").groupBy("owner_kind", "owner_id", "file_key").agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("d"))
    return d.select("owner_kind", "owner_id", "file_key", F.array_join(F.transform("d", lambda x: x["content"]), "\n").alias("docstring"))


def import_aggregate(imports: DataFrame) -> DataFrame:
    """(file_key, module, imported_names, aliases): sorted distinct names by imported module, null where there are none. No module, no row."""
    g = imports.filter("module <> ''").groupBy("file_key", "module")
    some = lambda c: F.when(F.size(c) > 0, c)
    names, aliases = F.array_sort(F.collect_set(F.nullif("name", F.lit("")))), F.array_sort(F.collect_set(F.nullif("alias", F.lit(""))))
    return g.agg(names.alias("n"), aliases.alias("a")).select("file_key", "module", some(F.col("n")).alias("imported_names"), some(F.col("a")).alias("aliases"))


def json_lists(rows: DataFrame, owner: str, fields: list[str], name: str) -> DataFrame:
    """(owner, name): each owner's rows by ord as JSON with sorted keys and nulls."""
    one = F.struct("ord", F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("row"))
    g = rows.groupBy("file_key", owner).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return g.select("file_key", owner, F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]")).alias(name))


def nodes(model, app_name: str, props: bool = True, only: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Nodes of a model by label, not yet merged; relations modules, classes, callables, parameters, call_sites, accessed_symbols, variables, attributes, imports, comments and ends. Without ``props`` these are empty, and comments, parameters, accessed symbols and callees aren't looked at; ``only``: labels that are wanted, and no other relation than theirs is needed."""
    c = F.col
    mods = model.modules
    classes, calls, attributes = lambda: model.classes, lambda: model.callables, lambda: model.attributes
    file = c("file_key")
    site_id, var_id, attr_id = _site_id(), _variable_id(), _attribute_id()
    sites = lambda: model.call_sites if props else model.open_call_sites
    if props:
        docs = docstrings(model.comments)
        doc = lambda kind, left: docs.filter(c("owner_kind") == kind).select(c("owner_id").alias(left), "file_key", "docstring")
        params = json_lists(model.parameters, "callable_signature", ["name", "type", "default_value", "start_line", "end_line", "start_column", "end_column"], "parameters_json").withColumnRenamed("callable_signature", "signature")
        syms = json_lists(model.accessed_symbols, "callable_signature", ["name", "scope", "kind", "type", "qualified_name", "is_builtin", "lineno", "col_offset"], "accessed_symbols_json").withColumnRenamed("callable_signature", "signature")
        classes = lambda: model.classes.join(doc("class", "signature"), ["signature", "file_key"], "left")
        calls = lambda: model.callables.join(doc("callable", "signature"), ["signature", "file_key"], "left").join(params, ["signature", "file_key"], "left").join(syms, ["signature", "file_key"], "left")
        attributes = lambda: model.attributes.withColumn("_id", attr_id).join(doc("attribute", "_id"), ["_id", "file_key"], "left")
    as_is = lambda *names: {n: c(n) for n in names}
    one = mods.sparkSession.range(1)
    # hot nodes that no module owns: one row each, aggregated before the shuffle
    once = lambda rows, name: rows.groupBy(name).agg(F.min(F.struct("file_key", "ord")).alias("_at")).select(name, "_at.*")
    packages = lambda: model.imports.filter("module <> ''").withColumn("ord", F.lit(0))
    put = lambda df, label, value, order, **values: node(df, label, value, order, **(values if props else {}))
    every = {
        "PyApplication": lambda: put(one, "PyApplication", F.lit(app_name), F.struct(F.lit(0).alias("_0"), F.lit("").alias("_1"), F.lit(0).cast("long").alias("_2")), schema_version=F.lit(schemas.GRAPH_VERSION)),
        "PyModule": lambda: put(mods, "PyModule", file, _order(1, file, F.lit(0)), **as_is("module_name", "content_hash", "last_modified", "file_size"), _module=file),
        "PyClass": lambda: put(classes(), "PyClass", c("signature"), _order(2, file, c("ord")), **as_is("name", "code", "base_classes", "docstring", "start_line", "end_line"), _module=file),
        "PyCallable": lambda: put(calls(), "PyCallable", c("signature"), _order(2, file, c("ord")), **as_is("name", "path", "return_type", "cyclomatic_complexity", "code", "code_start_line", "start_line", "end_line", "docstring", "decorators", "parameters_json", "accessed_symbols_json"), _module=file),
        "PyDecorator": lambda: put(once(_decorators(model), "decorator"), "PyDecorator", c("decorator"), _order(2, file, c("ord")), name=c("decorator")),
        "PyCallSite": lambda: put(sites(), "PyCallSite", site_id, _order(2, file, c("ord")), id=site_id, **as_is("method_name", "receiver_expr", "receiver_type", "argument_types", "return_type", "callee_signature", "is_constructor_call", "start_line", "start_column", "end_line", "end_column"), _module=file),
        "PyAttribute": lambda: put(attributes(), "PyAttribute", attr_id, _order(2, file, c("ord")), id=attr_id, **as_is("name", "type", "docstring", "start_line", "end_line"), _module=file),
        "PyVariable": lambda: put(model.variables, "PyVariable", var_id, _order(2, file, c("ord")), id=var_id, **as_is("name", "type", "initializer", "scope", "start_line", "end_line"), _module=file),
        "PyPackage": lambda: put(once(packages(), "module"), "PyPackage", c("module"), _order(2, file, F.lit(0))),
        "PyExternal": lambda: put(model.ends.filter("kind <> 'declared'"), "PyExternal", c("signature"), _order(3, c("signature"), F.lit(0)), **as_is("name", "module")),
    }
    return {label: part() for label, part in every.items() if only is None or label in set(only)}


def edges(model, app_name: str, only: Iterable[str] | None = None) -> DataFrame:
    """Edges of a model, gated by keys: of what nodes hold nothing is looked at. ``only``: types that are wanted, and no other relation than theirs is needed."""
    c = F.col
    wanted = {*_RELATIONS} if only is None else set(only)
    file = c("file_key")
    site_id, var_id, attr_id = _site_id(), _variable_id(), _attribute_id()
    as_is = lambda *names: {n: c(n) for n in names}
    sym = "PySymbol"
    rel = {"module": "PY_DECLARES", "class": "PY_HAS_METHOD", "callable": "PY_DECLARES"}
    owner = lambda kind: ("PyModule", file) if kind == "module" else (sym, c("parent_id"))
    out: list[DataFrame] = []
    if "PY_HAS_MODULE" in wanted:
        out.append(edge(model.modules, "PY_HAS_MODULE", ("PyApplication", F.lit(app_name)), ("PyModule", file), _order(1, file, F.lit(0))))
    for kind, name in rel.items():
        if name in wanted:
            out.append(edge(model.callables.filter(c("parent_kind") == kind), name, owner(kind), (sym, c("signature")), _order(2, file, c("ord"))))
        if "PY_DECLARES" in wanted:
            out.append(edge(model.classes.filter(c("parent_kind") == kind), "PY_DECLARES", owner(kind), (sym, c("signature")), _order(2, file, c("ord"))))
    if "PY_DECORATED_BY" in wanted:
        out.append(edge(_decorators(model), "PY_DECORATED_BY", (sym, c("signature")), ("PyDecorator", c("decorator")), _order(2, file, c("ord"))))
    if "PY_HAS_CALLSITE" in wanted:
        out.append(edge(model.open_call_sites, "PY_HAS_CALLSITE", (sym, c("caller_signature")), ("PyCallSite", site_id), _order(2, file, c("ord"))))
    if "PY_HAS_ATTRIBUTE" in wanted:
        out.append(edge(model.attributes, "PY_HAS_ATTRIBUTE", (sym, c("class_signature")), ("PyAttribute", attr_id), _order(2, file, c("ord"))))
    if "PY_DECLARES_VAR" in wanted:
        out.append(edge(model.variables.filter("owner_kind = 'module'"), "PY_DECLARES_VAR", ("PyModule", file), ("PyVariable", var_id), _order(2, file, c("ord"))))
        out.append(edge(model.variables.filter("owner_kind = 'callable'"), "PY_DECLARES_VAR", (sym, c("owner_id")), ("PyVariable", var_id), _order(2, file, c("ord"))))
    if "PY_IMPORTS" in wanted:
        out.append(edge(import_aggregate(model.imports), "PY_IMPORTS", ("PyModule", file), ("PyPackage", c("module")), _order(2, file, F.lit(0)), **as_is("imported_names", "aliases")))
    if "PY_CALLS" in wanted:
        out.append(edge(model.call_edges, "PY_CALLS", (sym, c("source")), (sym, c("target")), _order(3, c("source"), F.lit(0)), **as_is("weight", "provenance")))
    if "PY_EXTENDS" in wanted:
        extends = edge(model.classes.select("*", F.explode("base_classes").alias("base")), "PY_EXTENDS", (sym, c("signature")), (sym, c("base")), _order(4, file, c("ord")))
        out.append(gate(extends, symbols(model)))
    if "PY_RESOLVES_TO" in wanted:
        # whether a reference leads to a node is looked up once a reference, and a site finds it with its callee
        known = model.references.filter("callee_signature <> ''").join(symbols(model).select(c("value").alias("callee_signature")), "callee_signature", "left_semi").select("_ref", "_how", "callee_signature")
        resolved = model.open_call_sites.join(sized(cut(known), 256), (c("callee_ref") == c("_ref")) & (c("ref_kind") == c("_how")))
        out.append(edge(resolved, "PY_RESOLVES_TO", ("PyCallSite", site_id), (sym, c("callee_signature")), _order(4, file, c("ord"))))
    return _union(out)


def symbols(model) -> DataFrame:
    """(labels, value) of the symbols that become nodes: classes, callables and external ends. Deferred edges lead to no others."""
    labels = F.array(F.lit("PySymbol")).alias("labels")
    declared = model.classes.select(labels, F.col("signature").alias("value")).union(model.callables.select(labels, F.col("signature")))
    return declared.union(model.ends.filter("kind <> 'declared'").select(labels, F.col("signature")))


def project(model, app_name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a model; merged and gated."""
    return merge_nodes(_union([*nodes(model, app_name).values()])), edges(model, app_name)


def keys(parts: dict[str, DataFrame]) -> DataFrame:
    """(labels, value) of ``nodes``, merged or not."""
    return _union([n.select("labels", "value") for n in parts.values()])


def merged_labels(parts: dict[str, DataFrame]) -> DataFrame:
    """(labels, value) of ``nodes`` as ``merge_nodes`` gives them; of the rest nothing is looked at."""
    shared = [n for label, n in parts.items() if _CATALOG[label].merge_label != label]
    plain = [n.select("labels", "value").distinct() for label, n in parts.items() if _CATALOG[label].merge_label == label]
    first = _union(shared).groupBy(F.col("labels")[0].alias("_l"), "value", "labels").agg(F.min("ord").alias("ord"))
    g = first.groupBy("_l", "value").agg(F.array_sort(F.collect_list(F.struct("ord", "labels"))).alias("f"))
    return _union([*plain, g.select(F.array_distinct(F.flatten(F.transform("f", lambda x: x["labels"]))).alias("labels"), "value")])


def _site_id() -> Column:
    return N.call_site_id(*map(F.col, ("file_key", "start_line", "start_column", "end_line", "end_column")))


def _variable_id() -> Column:
    return N.variable_id(*map(F.col, ("owner_id", "name", "start_line")))


def _attribute_id() -> Column:
    return N.attribute_id(*map(F.col, ("class_signature", "name")))


def _decorators(model) -> DataFrame:
    return model.callables.select("file_key", "signature", "ord", F.explode("decorators").alias("decorator"))


def _order(phase: int, file: Column, place: Column) -> Column:
    return F.struct(F.lit(phase).alias("_0"), file.cast("string").alias("_1"), place.cast("long").alias("_2"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target was emitted; of ``nodes`` labels and value are looked at."""
    there = nodes.select(F.col("labels")[0].alias("to_label"), F.col("value").alias("to_value"))
    return edges.join(there, ["to_label", "to_value"], "left_semi").select(*edges.columns)


def merge_nodes(nodes: DataFrame, keys: Iterable[str] = (), last: Iterable[str] = ()) -> DataFrame:
    """Nodes by (labels[0], value) and ``keys``: of each property, and of each column of ``last``, the latest value by ``ord``, labels in the order they first came.

    Rows of one node with the same labels and properties are folded first, and partly before the shuffle, as the latest of them
    says all that the others do: of a node with a million rows a few are left to be merged.
    """
    keys, last = list(keys), list(last)
    own = nodes.select(*keys, *last, F.col("labels")[0].alias("_l"), "labels", "key_prop", "value", F.array_sort(F.map_keys("props")).alias("_k"), F.map_entries("props").alias("p"), "ord")
    g = own.groupBy("_l", "value", *keys, "labels", "_k").agg(F.min("ord").alias("ord"), F.max("ord").alias("_last"), *[F.max_by(c, "ord").alias(c) for c in ("key_prop", "p", *last)])
    g = g.groupBy("_l", "value", *keys).agg(F.array_sort(F.collect_list(F.struct("ord", "labels", "key_prop"))).alias("f"), F.array_sort(F.collect_list(F.struct("_last", "p", *last))).alias("r"))
    r, f = F.col("r"), F.col("f")

    def put(acc: Column, row: Column) -> Column:
        names = F.transform(row["p"], lambda e: e["key"])
        return F.concat(F.filter(acc, lambda e: ~F.array_contains(names, e["key"])), row["p"])

    props = F.when(F.size(r) == 1, r[0]["p"]).otherwise(F.aggregate(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), r[0]["p"], put))
    labels = F.when(F.size(f) == 1, f[0]["labels"]).otherwise(F.array_distinct(F.flatten(F.transform(f, lambda x: x["labels"]))))
    return g.select(*keys, labels.alias("labels"), f[0]["key_prop"].alias("key_prop"), "value", F.map_from_entries(props).alias("props"), f[0]["ord"].alias("ord"), *[F.element_at(r, -1)[c].alias(c) for c in last])


def sorted_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.concat_ws(" ", F.col("labels")[0], "value"))


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.concat_ws(" ", "type", "from_value", "to_value"), "ord")
