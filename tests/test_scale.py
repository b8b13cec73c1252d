"""What must not grow: plans that are made once, keys that don't meet in one task."""

from pyspark.sql import functions as F

from srcgraph.operators import callgraph as G
from srcgraph.plans import fact_queries, testdata, update_queries


def test_module_graph_is_written_once(spark, sf, monkeypatch):
    plan = fact_queries.module_graph(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    asked, plain = [], testdata.call_sites
    monkeypatch.setattr(testdata, "call_sites", lambda *a: asked.append(1) or plain(*a))
    assert update_queries.coupling_plan_metrics(spark, sf).count() == 1 and asked == [1]


def test_constructors_meet_classes_by_name_and_prefix(spark):
    sites = spark.createDataFrame([("r.n12.f", "S", None, True), ("q.f", "S", None, True), ("r.n1.S", "T", "t", False)], "caller_signature string, method_name string, callee_signature string, is_constructor_call boolean")
    classes = spark.createDataFrame([("S", "r.n1.S", "a", 1), ("S", "r.S", "b", 1), ("S", "S", "c", 1), ("S", "S", "a", 2)], "name string, signature string, file_key string, ord int")
    out = G.resolve_constructors(sites, classes)
    assert {(r.caller_signature, r.callee_signature) for r in out.collect()} == {("r.n12.f", "r.n1.S.__init__"), ("q.f", "S.__init__"), ("r.n1.S", "t")}
    assert "StartsWith" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert G.resolve_constructors(sites, classes.filter(F.lit(False))).filter("callee_signature IS NOT NULL").count() == 1


def test_sites_are_joined_to_what_they_call_once(spark):
    from srcgraph.operators import resolve
    from srcgraph.operators.extract import extract

    df = spark.createDataFrame([("m.py", "def f(): pass\ndef g():\n    f()\n    unknown()\n")], "file_key string, source string").selectExpr("file_key", "source", "0D AS last_modified", "1L AS file_size", "'h' AS content_hash", "CAST(NULL AS STRING) AS error")
    out = resolve.resolve_calls(extract(df))
    assert {(r.method_name, r.callee_signature, r.is_constructor_call) for r in out.collect()} == {("f", "m.f", False), ("unknown", None, False)}
    assert "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()


def test_edges_and_labels_look_at_no_properties(spark, sf):
    """The graph's keys come from a model that has neither comments, parameters, accessed symbols nor code; sites are not in the gate of symbols."""
    from srcgraph.operators import propgraph
    from srcgraph.plans import source_queries as Q

    m, whole = Q.model(spark, sf, *Q.KEYS), Q.model(spark, sf)
    assert not {"comments", "parameters", "accessed_symbols"} & set(m.extracted.columns)
    row = lambda df, *names: sorted(map(tuple, df.select(*names).collect()), key=str)
    nodes, edges = propgraph.project(whole, "app")
    labels = propgraph.merged_labels(propgraph.nodes(m, "app", props=False))
    assert row(labels, "labels", "value") == row(nodes, "labels", "value")
    names = [c for c in edges.columns if c not in ("props", "ord")]
    assert row(propgraph.edges(m, "app"), *names) == row(edges, *names)
    assert propgraph.gate(edges.filter("type = 'PY_CALLS'"), nodes).count() == edges.filter("type = 'PY_CALLS'").count() > 0


def test_merged_labels_keep_the_order_in_which_labels_came(spark):
    from srcgraph.operators import propgraph

    part = lambda label, *rows: spark.createDataFrame([(["PySymbol", label], v, "signature", o) for v, o in rows], "labels array<string>, value string, key_prop string, ord int").withColumn("props", F.create_map().cast("map<string,string>"))
    parts = {"PyClass": part("PyClass", ("a", 2), ("b", 1), ("b", 5)), "PyCallable": part("PyCallable", ("a", 1), ("c", 1)), "PyExternal": part("PyExternal", ("b", 0))}
    got = {r.value: r.labels for r in propgraph.merged_labels(parts).collect()}
    want = {r.value: r.labels for r in propgraph.merge_nodes(parts["PyClass"].union(parts["PyCallable"]).union(parts["PyExternal"])).collect()}
    assert got == want and got["a"] == ["PySymbol", "PyCallable", "PyClass"]


def test_edges_are_counted_by_reference_before_they_are_joined(spark, sf):
    from srcgraph.operators import resolve
    from srcgraph.plans import source_queries as Q

    m = Q.model(spark, sf, *Q.NAMES)
    want = {(r.source, r.target, r.weight) for r in G.call_edges(resolve.resolve_calls(m.extracted)).collect()}
    assert {(r.source, r.target, r.weight) for r in m.call_edges.collect()} == want and want
    assert m.references.filter("is_constructor_call AND coalesce(callee_signature, '') = ''").isEmpty()


def _model(spark, **sources):
    from srcgraph.operators.extract import extract
    from srcgraph.plans.engine import CodeModel

    df = spark.createDataFrame([(f"{k}.py", v) for k, v in sources.items()], "file_key string, source string").selectExpr("file_key", "source", "0D AS last_modified", "1L AS file_size", "'h' AS content_hash", "CAST(NULL AS STRING) AS error")
    return CodeModel(spark, extract(df))


def test_documents_are_made_of_a_files_row(spark):
    import json

    from srcgraph.sources import sinks

    m = _model(spark, a="from b import f, C\nX = 'é'  # note\ndef g(p=1):\n    f(p)\n    C()\n    nobody()\n", b="class C: pass\ndef f(x): return x\n", empty="", bad="def (")
    df = sinks.module_documents(m)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "to_json" not in plan and "structstojson" not in plan.lower()
    docs = {r.file_key: json.loads(r.document) for r in df.collect()}
    assert set(docs) == {"a.py", "b.py", "empty.py"} and docs["empty.py"]["functions"] == {}
    sites = docs["a.py"]["functions"]["g"]["call_sites"]
    assert [(s["method_name"], s["callee_signature"], s["is_constructor_call"]) for s in sites] == [("f", "b.f", False), ("C", "b.C.__init__", True), ("nobody", None, False)]
    assert docs["a.py"]["variables"][0]["initializer"] == "'é'" and docs["a.py"]["comments"][0]["content"] == "note"


def test_statements_make_their_rows_once(spark):
    from srcgraph.operators import propgraph
    from srcgraph.sources import sinks

    nodes, _ = propgraph.project(_model(spark, a="def f(): pass\ndef g(): f()\n"), "app")
    plan = sinks.node_statements(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and sum(r.n for r in sinks.node_statements(nodes, 2).collect()) == nodes.count() > 4
