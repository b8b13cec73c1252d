"""Long ways through re-exports and inheritance, what the graph makes of them, and a store of two applications; on nations and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcgraph.functions import names as N
from srcgraph.operators import callgraph, propgraph, resolve
from srcgraph.operators.extract import extract
from srcgraph.operators.store import GraphStore
from srcgraph.plans import testdata as T
from srcgraph.plans.engine import CodeModel, Options
from srcgraph.runtime import cut, scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def chain_files(spark, d):
    """Nation n's module takes f from nation n - 1's and its class extends the one there; each supplier's calls both."""
    s = F.col("n").cast("string")
    before = (F.col("n") - 1).cast("string")
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    first = F.lit("def f(): pass\n\n\nclass C0:\n    def go(self): pass\n")
    later = F.concat(F.lit("import x0\nfrom x"), before, F.lit(" import f, C"), before, F.lit("\n\n\nclass C"), s, F.lit("(C"), before, F.lit("): pass\n\n\nclass E"), s, F.lit("(x0.C0): pass\n"))
    nations = n.select(F.concat(F.lit("x"), s, F.lit(".py")).alias("file_key"), F.when(F.col("n") == 0, first).otherwise(later).alias("source"))
    k, at = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    own = F.concat(F.lit("from x"), at, F.lit(" import f, C"), at, F.lit("\n\n\ndef run():\n    f()\n    c = C"), at, F.lit("()\n    c.go()\n"))
    suppliers = T.table(spark, d, "supplier").select(F.concat(F.lit("s"), k, F.lit(".py")).alias("file_key"), own.alias("source"))
    src = nations.unionByName(suppliers).repartition(2 * spark.sparkContext.defaultParallelism, "file_key")
    return src.select("file_key", "source", F.lit(0.0).alias("last_modified"), F.octet_length("source").cast("long").alias("file_size"), N.sha256(F.col("source")).alias("content_hash"), F.lit(None).cast("string").alias("error"))


@query("""SELECT 's' || s_suppkey || '.run' AS source, t AS target, n AS weight FROM (
 SELECT s_suppkey, 'x0.f' AS t, 1 AS n FROM supplier UNION ALL SELECT s_suppkey, 'x' || s_nationkey || '.C' || s_nationkey || '.__init__', 1 FROM supplier UNION ALL SELECT s_suppkey, 'x0.C0.go', 1 FROM supplier)""")
def resolved_long_chains(spark, d):
    """Up to 24 re-exports and 24 levels of inheritance."""
    x = cut(extract(chain_files(spark, d), only=("classes", "callables", "call_sites", "bindings"), code=False))
    return callgraph.call_edges(resolve.resolve_calls(x)).select("source", "target", F.col("weight").cast("int").alias("weight"))


@query("SELECT 'x' || n_nationkey || '.E' || n_nationkey AS from_value, 'x0.C0' AS to_value FROM nation WHERE n_nationkey > 0")
def graph_extends(spark, d):
    """Bases that are nodes of the graph; those written by their short name (class C) are not, and their edges are dropped."""
    model = CodeModel(spark, cut(extract(chain_files(spark, d).filter("file_key LIKE 'x%'"))), Options("/proj", app_name="app"))
    return propgraph.project(model, "app")[1].filter("type = 'PY_EXTENDS'").select("from_value", "to_value")


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
rows AS (
 SELECT 'b' AS app, 'PyModule' AS label, 'n' || n_nationkey AS value, 'b' AS v FROM nation
 UNION ALL SELECT 'b', 'PySymbol', 'c' || k, 'b' FROM c
 UNION ALL SELECT 'a', 'PyModule', 'n' || n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'a2' ELSE 'a' END FROM nation WHERE n_nationkey % 3 < 2
 UNION ALL SELECT 'a', 'PySymbol', 'c' || k, 'a' FROM c WHERE n % 3 = 0
 UNION ALL SELECT 'a', 'PySymbol', 'c' || k, 'a2' FROM c WHERE n % 3 = 1 AND k % 2 = 0),
edges AS (SELECT r.app, 'PY_DECLARES' AS label, value AS value, v FROM rows r WHERE label = 'PySymbol')
SELECT * FROM rows UNION ALL SELECT * FROM edges UNION ALL SELECT '', 'PyPackage', 'os', 'a'""")
def store_applications(spark, d):
    """Two applications whose modules have the same names; the first is then pushed again with some modules gone and some changed."""
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    c = T.table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("c"), F.col("c_custkey").alias("k"))
    quote = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    module = F.concat(F.lit("n"), F.col("n").cast("string"))

    def push(app: str, v, keep_module, keep_symbol=F.lit(True)) -> None:
        props = lambda *more: F.create_map(F.lit("v"), quote(v), F.lit("_module"), quote(module), *more)
        mods, syms = n.filter(keep_module), c.filter(keep_module & keep_symbol)
        node = lambda df, label, key, value, p: df.select(F.array(F.lit(label)).alias("labels"), F.lit(key).alias("key_prop"), value.alias("value"), p.alias("props"))
        nodes = node(mods, "PyModule", "file_key", module, props(F.lit("content_hash"), quote(v))).unionByName(node(syms, "PySymbol", "signature", F.col("c"), props()))
        nodes = nodes.unionByName(node(spark.range(1), "PyPackage", "name", F.lit("os"), F.create_map(F.lit("v"), quote(F.lit(app)))))
        ends = [F.lit(x).alias(f"{side}_{what}") for side, label, key in (("from", "PyModule", "file_key"), ("to", "PySymbol", "signature")) for what, x in (("label", label), ("key", key))]
        edges = syms.select(F.lit("PY_DECLARES").alias("type"), *ends, module.alias("from_value"), F.col("c").alias("to_value"), F.create_map(F.lit("v"), quote(v)).alias("props"))
        store.push(nodes, edges, app)

    store = GraphStore(spark, scratch(spark, "store"))
    every, third = F.lit(True), F.col("n") % 3
    push("a", F.lit("a"), every)
    push("b", F.lit("b"), every)
    push("a", F.when(third == 1, "a2").otherwise("a"), third < 2, (third == 0) | (F.col("k") % 2 == 0))
    nodes, edges = store.read()
    text = F.expr("substring(props['v'], 2, length(props['v']) - 2)").alias("v")
    app = F.when(F.col("module").isNull(), F.lit("")).otherwise(F.col("app")).alias("app")
    return nodes.select(app, F.col("labels")[0].alias("label"), "value", text).unionByName(edges.select("app", F.col("type").alias("label"), F.col("to_value").alias("value"), text))
