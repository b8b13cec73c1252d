"""Relational operators on the tables read as facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcgraph.functions import literals as L
from srcgraph.functions import names as N
from srcgraph.operators import callgraph as G
from srcgraph import runtime as R
from srcgraph.operators import graph, relations
from srcgraph.plans import testdata as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def facts(sql: str, recursive: bool = False):
    return query(T.with_facts(sql, recursive))


def edges(spark, d):
    return G.call_edges(T.call_sites(spark, d))


def merged(spark, d):
    return G.merge_edges(edges(spark, d), T.second_edges(spark, d))


def flat(e):
    """Edges with provenance as text."""
    return e.withColumn("provenance", F.array_join("provenance", "|"))


@facts(" SELECT file_key, module_name, dotted FROM modules")
def scan_modules(spark, d):
    return T.modules(spark, d).select("file_key", "module_name", "dotted")


@facts(", u AS (SELECT file_key, 1 AS a, 0 AS b FROM callables UNION ALL SELECT file_key, 0, 1 FROM classes) SELECT file_key, CAST(sum(a) AS BIGINT) AS n_callables, CAST(sum(b) AS BIGINT) AS n_classes FROM u GROUP BY ALL")
def module_inventory(spark, d):
    return relations.module_inventory(T.callables(spark, d), T.classes(spark, d))


@facts(" SELECT signature, name, file_key, ord FROM callables")
def callables_flat(spark, d):
    return T.callables(spark, d)


@facts(" SELECT signature, name, file_key, ord FROM classes")
def classes_flat(spark, d):
    return T.classes(spark, d)


@facts(" SELECT signature, file_key FROM sig_file")
def signature_to_file(spark, d):
    return relations.signature_to_file(T.callables(spark, d), T.classes(spark, d))


@facts(" SELECT signature FROM declared")
def declared_signatures(spark, d):
    return relations.declared_signatures(T.callables(spark, d), T.classes(spark, d))


@facts(" SELECT source, target, 'CALL_DEP' AS type, weight, 'jedi' AS provenance FROM edges")
def call_edges(spark, d):
    return flat(edges(spark, d))


@facts(" SELECT source, target, 'CALL_DEP' AS type, weight, provenance FROM merged")
def merge_edges(spark, d):
    return flat(merged(spark, d))


@facts(", u AS (SELECT *, 0 AS shard, 'jedi' AS provenance FROM edges UNION ALL SELECT *, 1, 'pycg' FROM second) SELECT source, target, 'CALL_DEP' AS type, CAST(sum(weight) AS BIGINT) AS weight, arg_min(provenance, shard) AS provenance FROM u GROUP BY source, target")
def coalesce_shard_edges(spark, d):
    both = edges(spark, d).withColumn("shard", F.lit(0)).union(T.second_edges(spark, d).withColumn("shard", F.lit(1)))
    return flat(G.coalesce_edges(both, "shard"))


@facts(" SELECT source, target, 'CALL_DEP' AS type, weight, provenance FROM merged WHERE source IN (SELECT signature FROM declared) OR target IN (SELECT signature FROM declared)")
def app_edges(spark, d):
    return flat(G.app_edges(merged(spark, d), declared_signatures(spark, d)))


_ENDS = "ends AS (SELECT source AS signature FROM {0} UNION SELECT target FROM {0})"
_SPLIT = "CASE WHEN contains(signature, '.') THEN regexp_replace(signature, '\\.[^.]*$', '') ELSE signature END"


@facts(f", {_ENDS.format('merged')} SELECT signature, regexp_extract(signature, '[^.]*$') AS name, {_SPLIT} AS module FROM ends WHERE signature NOT IN (SELECT signature FROM declared)")
def external_symbols(spark, d):
    return G.external_symbols(merged(spark, d), declared_signatures(spark, d))


_CTOR = """, pairs AS (SELECT DISTINCT caller_signature, short_name FROM call_sites WHERE callee_signature IS NULL AND is_constructor_call),
cand AS (SELECT caller_signature, short_name, h.signature, h.file_key, h.ord, regexp_replace(h.signature, '\\.[^.]*$', '') AS parent FROM pairs JOIN homonyms h ON short_name = h.name),
best AS (SELECT *, row_number() OVER (PARTITION BY caller_signature, short_name ORDER BY length(parent) DESC, file_key, ord) AS r FROM cand WHERE starts_with(caller_signature, parent)),
done AS (SELECT c.caller_signature, c.short_name, c.is_constructor_call, CASE WHEN c.callee_signature IS NULL AND c.is_constructor_call THEN b.signature || '.__init__' ELSE c.callee_signature END AS callee_signature, c.callee_signature AS before
         FROM call_sites c LEFT JOIN best b ON c.caller_signature = b.caller_signature AND c.short_name = b.short_name AND r = 1)
"""


@facts(_CTOR + " SELECT caller_signature, short_name AS method_name, is_constructor_call, coalesce(callee_signature, '') AS callee_signature, count(*) AS n FROM done GROUP BY ALL")
def ctor_resolution(spark, d):
    out = G.resolve_constructors(T.call_sites(spark, d, True), T.homonyms(spark, d))
    return out.groupBy("caller_signature", "method_name", "is_constructor_call", F.coalesce("callee_signature", F.lit("")).alias("callee_signature")).agg(F.count("*").alias("n"))


@facts(_CTOR + " SELECT CAST(count(callee_signature) - count(before) AS BIGINT) AS n_resolved FROM done")
def ctor_resolved_count(spark, d):
    sites = T.call_sites(spark, d, True)
    return G.constructor_count(sites, G.resolve_constructors(sites, T.homonyms(spark, d)))


@facts(" SELECT src_file, dst_file, weight FROM module_graph")
def module_graph(spark, d):
    """Written once: it has a row for each pair of coupled files, and what stands on it reads it several times."""
    return R.cut(G.module_graph(edges(spark, d), signature_to_file(spark, d)))


@facts(" SELECT least(src_file, dst_file) AS a, greatest(src_file, dst_file) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM module_graph GROUP BY ALL")
def module_graph_undirected(spark, d):
    return G.undirected(module_graph(spark, d))


def heavy(spark, d):
    """Module edges of more than the mean weight: a graph of several components at any scale."""
    g = module_graph(spark, d)
    mean = g.agg((F.avg("weight") * 1.35).alias("w"))
    return g.join(F.broadcast(mean), F.col("weight") >= F.col("w")).select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"))


_HEAVY = ", heavy AS (SELECT src_file AS src, dst_file AS dst FROM module_graph WHERE weight >= (SELECT avg(weight) * 1.35 FROM module_graph))"


@facts(_HEAVY + """, nodes AS (SELECT src AS node FROM heavy UNION SELECT dst FROM heavy),
reach(a, b) AS (SELECT src, dst FROM heavy UNION SELECT reach.a, heavy.dst FROM reach JOIN heavy ON reach.b = heavy.src)
SELECT n.node, least(n.node, coalesce(min(r.b), n.node)) AS scc FROM nodes n LEFT JOIN reach r ON r.a = n.node AND EXISTS (SELECT 1 FROM reach q WHERE q.a = r.b AND q.b = r.a) GROUP BY n.node""", True)
def scc_assignment(spark, d):
    return graph.strong_components(heavy(spark, d))


@facts(_HEAVY + """, root AS (SELECT min(src) AS node FROM heavy),
reach(node) AS (SELECT node FROM root UNION SELECT heavy.dst FROM reach JOIN heavy ON reach.node = heavy.src) SELECT node FROM reach""", True)
def reachable_from(spark, d):
    e = heavy(spark, d)
    return graph.reachable(e, e.agg(F.min("src").alias("node")).filter("node IS NOT NULL")).select("node")


@facts("""SELECT CAST(count(DISTINCT f) AS DOUBLE) AS modules, CAST(any_value(e) AS DOUBLE) AS module_edges, CAST(any_value(t) AS DOUBLE) AS total_edge_weight, CAST(any_value(c) AS DOUBLE) AS cut_weight,
  CAST(any_value(c) AS DOUBLE) / any_value(t) AS cut_ratio FROM (SELECT file_key AS f FROM modules), (SELECT count(*) AS e, sum(weight) AS t,
  sum(weight) FILTER (WHERE split_part(src_file, '/', 3) <> split_part(dst_file, '/', 3)) AS c FROM module_graph)""".replace("SELECT CAST(count", " SELECT CAST(count", 1))
def cut_metrics(spark, d):
    from srcgraph.operators import shards

    files = T.modules(spark, d).select("file_key", F.split_part("file_key", F.lit("/"), F.lit(3)).alias("shard_id"))
    return shards.metrics(files, module_graph(spark, d), budget=100).select("modules", "module_edges", "total_edge_weight", "cut_weight", "cut_ratio")


@facts(" SELECT split_part(file_key, '/', 3) AS package, count(*) AS n_files, string_agg(file_key, '|' ORDER BY file_key) AS files, count(*) > 4 AS skipped FROM modules GROUP BY ALL")
def package_shards(spark, d):
    from srcgraph.operators import shards

    return shards.package_shards(T.modules(spark, d).withColumn("package", F.split_part("file_key", F.lit("/"), F.lit(3))), ceiling=4)


@facts(f", {_ENDS.format('merged')}, known AS (SELECT DISTINCT signature FROM callables) SELECT coalesce(e.signature, k.signature) AS signature, k.signature IS NULL AS ghost FROM ends e FULL JOIN known k ON e.signature = k.signature")
def ghost_nodes(spark, d):
    return G.graph_nodes(merged(spark, d), T.callables(spark, d))


_TOP = "(SELECT min(target) FROM edges)"


@facts(f" SELECT source, target, weight FROM edges WHERE target = {_TOP}")
def callers_of(spark, d):
    e = edges(spark, d)
    top = e.agg(F.min("target").alias("target"))
    return e.join(F.broadcast(top), "target").select("source", "target", "weight")


@facts(" SELECT source, target, weight FROM edges WHERE source = (SELECT min(source) FROM edges)")
def callees_of(spark, d):
    e = edges(spark, d)
    return e.join(F.broadcast(e.agg(F.min("source").alias("source"))), "source").select("source", "target", "weight")


@facts(f""", {_ENDS.format('merged')}, ext AS (SELECT signature, regexp_extract(signature, '[^.]*$') AS name, {_SPLIT} AS module FROM ends WHERE signature NOT IN (SELECT signature FROM declared) AND signature NOT LIKE '%.core')
SELECT e.signature, CASE WHEN x.signature IS NOT NULL THEN 'external' WHEN e.signature IN (SELECT signature FROM declared) THEN 'declared' ELSE 'fallback' END AS kind,
  coalesce(x.name, CASE WHEN e.signature NOT IN (SELECT signature FROM declared) THEN regexp_extract(e.signature, '[^.]*$') END) AS name, x.module FROM ends e LEFT JOIN ext x ON e.signature = x.signature""")
def call_endpoint_kind(spark, d):
    e = merged(spark, d)
    ext = G.external_symbols(e, declared_signatures(spark, d)).filter("signature NOT LIKE '%.core'")
    return G.endpoint_kinds(e, ext, declared_signatures(spark, d))


@query("SELECT c_name || '#' || (l_linenumber) || ':' || 4 || '-' || (l_linenumber + 1) || ':' || l_suppkey AS id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def callsite_ids(spark, d):
    x = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(N.call_site_id(F.col("c_name"), F.col("l_linenumber"), F.lit(4), F.col("l_linenumber") + 1, F.col("l_suppkey")).alias("id")).agg(F.count("*").alias("n"))


@query("SELECT p_name || '#' || p_brand || '@' || p_size AS id FROM part")
def variable_ids(spark, d):
    return T.table(spark, d, "part").select(N.variable_id(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("id"))


@query("SELECT s_name || '.' || s_nationkey AS id FROM supplier")
def attribute_ids(spark, d):
    return T.table(spark, d, "supplier").select(N.attribute_id(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("id"))


_QUOTED = "'''' || " + "replace(replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '''', chr(92) || ''''), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')" + " || ''''"


@query(f"SELECT doc_id, sha256({_QUOTED.format('text')}) AS text_hash, coalesce({_QUOTED.format('lang')}, 'null') AS lang, CAST(n_chars AS VARCHAR) AS n_chars, CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END AS long FROM documents")
def script_literals(spark, d):
    t = T.table(spark, d, "documents")
    return t.select("doc_id", N.sha256(L.literal(F.col("text"), "string")).alias("text_hash"), L.literal(F.col("lang"), "string").alias("lang"), L.literal(F.col("n_chars"), "integer").alias("n_chars"), L.literal(F.col("n_chars") > 1000, "boolean").alias("long"))


_PATHS = "CASE c_custkey % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src.py/test/' WHEN 2 THEN 'src/pycg/' ELSE 'lib/' END || CASE c_nationkey % 4 WHEN 0 THEN 'test_' ELSE 'm' END || c_custkey || CASE c_nationkey % 5 WHEN 0 THEN '_test.py' WHEN 1 THEN '/__init__.py' ELSE '.py' END"


def paths(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    head = F.when(k % 6 == 0, "tests/").when(k % 6 == 1, "src.py/test/").when(k % 6 == 2, "src/pycg/").otherwise("lib/")
    stem = F.when(n % 4 == 0, "test_").otherwise("m")
    tail = F.when(n % 5 == 0, "_test.py").when(n % 5 == 1, "/__init__.py").otherwise(".py")
    return T.table(spark, d, "customer").select(F.concat(head, stem, k.cast("string"), tail).alias("rel"))


@query(f"SELECT rel, regexp_replace(replace(rel, '/', '.'), '\\.py$', '') AS dotted, replace(replace(rel, '/', '.'), '.py', '') AS compat FROM (SELECT {_PATHS} AS rel FROM customer)")
def path_to_signature(spark, d):
    return paths(spark, d).select("rel", N.path_to_dotted(F.col("rel")).alias("dotted"), N.path_to_dotted(F.col("rel"), True).alias("compat"))


@query(f"SELECT rel FROM (SELECT {_PATHS} AS rel FROM customer) WHERE NOT (rel LIKE 'tests/%' OR rel LIKE '%/test/%' OR regexp_matches(rel, '(^|/)test_[^/]*$') OR rel LIKE '%\\_test.py' ESCAPE '\\')")
def skip_tests_filter(spark, d):
    return paths(spark, d).filter(~N.is_test_path(F.col("rel")))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def last_definition_wins(spark, d):
    o = T.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return relations.last_definition(o, ["o_custkey"], ["o_orderkey"])


@query("SELECT l_suppkey, string_agg(DISTINCT 'p' || l_partkey, '|' ORDER BY 'p' || l_partkey) AS imported_names, string_agg(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_shipmode END, '|' ORDER BY CASE WHEN l_returnflag = 'A' THEN l_shipmode END) AS aliases FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem WHERE l_linenumber <> 2) GROUP BY l_suppkey")
def import_aggregate(spark, d):
    from srcgraph.operators import propgraph

    li = T.table(spark, d, "lineitem")
    module = F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("l_suppkey").cast("string"))
    rows = li.select(F.lit("f").alias("file_key"), module.alias("module"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")).alias("alias"))
    agg = propgraph.import_aggregate(rows)
    return agg.select(F.col("module").cast("long").alias("l_suppkey"), F.array_join("imported_names", "|").alias("imported_names"), F.array_join("aliases", "|").alias("aliases"))
