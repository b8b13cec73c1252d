"""Incremental semantics, node merging and the contract, on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcgraph import schemas
from srcgraph.operators import propgraph, shards, store
from srcgraph.operators.extract import extract
from srcgraph.plans import testdata as T
from srcgraph.plans.fact_queries import module_graph
from srcgraph.runtime import stored, wide
from srcgraph.sources import cache

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LATE = "l_quantity > 49 AND l_discount > 0.095"


def _version(spark, d, new: bool):
    """Suppliers as files whose content is what they shipped: all of it, or without the largest shipments at the best price."""
    li = T.table(spark, d, "lineitem").filter(F.lit(True) if new else ~F.expr(_LATE))
    return li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file_key")).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.max("l_shipdate").cast("date").cast("string")).cast("binary"), 256).alias("content_hash"))


_VERSIONS = f"""WITH v AS (SELECT 's' || l_suppkey AS file_key, sha256(count(*) || '|' || CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR)) AS h FROM lineitem GROUP BY ALL),
o AS (SELECT 's' || l_suppkey AS file_key, sha256(count(*) || '|' || CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR)) AS h FROM lineitem WHERE NOT ({_LATE}) GROUP BY ALL)"""


@query(_VERSIONS + " SELECT v.file_key FROM v LEFT JOIN o USING (file_key) WHERE o.h IS NULL OR o.h <> v.h")
def changed_modules(spark, d):
    return store.changed_modules(_version(spark, d, False), _version(spark, d, True))


@query(_VERSIONS + " SELECT v.file_key FROM v LEFT JOIN o USING (file_key) WHERE o.h = v.h")
def unchanged_files(spark, d):
    meta = lambda df: df.withColumn("last_modified", F.lit(None).cast("double")).withColumn("file_size", F.lit(None).cast("long"))
    return cache.unchanged(meta(_version(spark, d, True)), meta(_version(spark, d, False)).withColumn("error", F.lit(None).cast("string")))


@query("SELECT file_key FROM (SELECT 's' || l_suppkey AS file_key FROM lineitem EXCEPT SELECT 's' || l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R') ")
def vanished_modules(spark, d):
    li = T.table(spark, d, "lineitem")
    f = lambda df: df.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file_key")).distinct()
    return store.vanished_modules(f(li), f(li.filter("l_quantity > 49 AND l_returnflag = 'R'")))


@query("SELECT o_custkey AS from_value, o_orderkey AS to_value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR c_nationkey % 3 = 0")
def owned_edges(spark, d):
    o, c = T.table(spark, d, "orders"), T.table(spark, d, "customer")
    edges = o.select(F.lit("C").alias("from_label"), F.col("o_custkey").alias("from_value"), F.col("o_orderkey").alias("to_value"))
    owners = c.filter("c_mktsegment <> 'BUILDING'").select(F.lit("C").alias("label"), F.col("c_custkey").alias("value"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("module"))
    changed = T.table(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file_key"))
    return store.owned_edges(edges, owners, changed).select("from_value", "to_value")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS value, string_agg(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'Even' ELSE 'Odd' END, '|' ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN 'Even' ELSE 'Odd' END) AS labels,
 arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS last, coalesce(arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '') AS closed FROM orders GROUP BY o_custkey""")
def node_upsert_merge(spark, d):
    o = T.table(spark, d, "orders")
    side = F.when(F.col("o_orderkey") % 2 == 0, "Even").otherwise("Odd")
    own = F.create_map(F.lit("last"), F.col("o_orderkey").cast("string"))
    props = F.when(F.col("o_orderstatus") == "F", F.map_concat(own, F.create_map(F.lit("closed"), F.col("o_orderpriority")))).otherwise(own)
    n = o.select(F.array(F.lit("N"), side).alias("labels"), F.lit("k").alias("key_prop"), F.col("o_custkey").cast("string").alias("value"), props.alias("props"), F.col("o_orderkey").alias("ord"))
    m = propgraph.merge_nodes(n)
    return m.select("value", F.array_join(F.array_sort(F.slice("labels", 2, 10)), "|").alias("labels"), F.col("props")["last"].alias("last"), F.coalesce(F.col("props")["closed"], F.lit("")).alias("closed"))


@query(T.with_source(" SELECT file_key, dotted || '.c' || k AS signature FROM fns UNION ALL SELECT file_key, dotted || '.G' || g || f FROM files, (VALUES ('.__init__'), ('.grow')) t(f)"))
def incremental_equals_full(spark, d):
    """Half the files from a cache, the others extracted: the same relations as a full extraction."""
    from srcgraph.operators.relations import relation

    files = stored(T.source_files(spark, d))
    cached = stored(extract(files.filter("crc32(CAST(file_key AS BINARY)) % 2 = 0").repartition(wide(spark), "file_key"), only=["callables"]))
    return relation(cache.extract_changed(files, cached, only=["callables"]), "callables").select("file_key", "signature")


@query()
def coupling_plan(spark, d):
    """(shard_id, file_key) of a plan with a budget of 6 files; its invariants are tested."""
    return shards.plan_shards(T.modules(spark, d), module_graph(spark, d), budget=6)


@query()
def coupling_plan_metrics(spark, d):
    graph = module_graph(spark, d)
    return shards.metrics(shards.plan_shards(T.modules(spark, d), graph, budget=6), graph, budget=6)


def _values(rows) -> str:
    q = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


_NODES = [(n.label, n.merge_label, n.key, "|".join(f"{k}:{t}" for k, t in sorted(n.properties.items()))) for n in schemas.NODE_LABELS]
_RELS = [(r.type, "|".join(r.sources), "|".join(r.targets), "|".join(f"{k}:{t}" for k, t in r.properties.items())) for r in schemas.RELATION_TYPES]


@query(f"SELECT * FROM (VALUES {_values(_NODES)}) t(label, merge_label, key, properties)")
def schema_contract_nodes(spark, d):
    rows = [(n["label"], n["merge_label"], n["key"], "|".join(f"{k}:{t}" for k, t in sorted(n["properties"].items()))) for n in schemas.catalog_document()["node_labels"]]
    return spark.createDataFrame(rows, "label string, merge_label string, key string, properties string")


@query(f"SELECT * FROM (VALUES {_values(_RELS)}) t(type, sources, targets, properties)")
def schema_contract_rels(spark, d):
    rows = [(r["type"], "|".join(r["from"]), "|".join(r["to"]), "|".join(f"{k}:{t}" for k, t in r["properties"].items())) for r in schemas.catalog_document()["relationship_types"]]
    return spark.createDataFrame(rows, "type string, sources string, targets string, properties string")
