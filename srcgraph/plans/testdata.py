"""The driver's tables read as a code base.

Facts: nations are modules, suppliers classes, customers callables, parts external symbols, and line items call sites.
Source: customers, in groups of ``GROUP`` keys a nation, are rendered as Python files that call each other, so that parsing
and resolving can be compared with plain SQL on the tables. Each Spark function has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.functions import names as N
from srcgraph.runtime import sized, wide

GROUP = 1600


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") if isinstance(p, str) else p for p in parts])


# facts


def modules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("nationkey"),
        _s("/proj/r", "$n_regionkey", "/n", "$n_nationkey", ".py").alias("file_key"),
        _s("n", "$n_nationkey").alias("module_name"),
        _s("r", "$n_regionkey", ".n", "$n_nationkey").alias("dotted"),
    )


def classes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(modules(spark, d), F.col("s_nationkey") == F.col("nationkey"))
    return s.select(_s("$dotted", ".S", "$s_suppkey").alias("signature"), _s("S", "$s_suppkey").alias("name"), "file_key", F.col("s_suppkey").alias("ord"))


def homonyms(spark: SparkSession, d: str) -> DataFrame:
    """Classes of ten names only, so that choosing between them matters."""
    s = table(spark, d, "supplier").join(modules(spark, d), F.col("s_nationkey") == F.col("nationkey"))
    k = (F.col("s_suppkey") % 10).cast("string")
    return s.select(F.concat("dotted", F.lit(".S"), k).alias("signature"), F.concat(F.lit("S"), k).alias("name"), "file_key", k.cast("int").alias("ord")).distinct()


def callables(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(modules(spark, d), F.col("c_nationkey") == F.col("nationkey"))
    own = c.select(_s("$dotted", ".c", "$c_custkey").alias("signature"), _s("c", "$c_custkey").alias("name"), "file_key", F.col("c_custkey").alias("ord"))
    init = classes(spark, d).select(_s("$signature", ".__init__").alias("signature"), F.lit("__init__").alias("name"), "file_key", "ord")
    return own.unionByName(init)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their caller, class and library symbol."""
    m = modules(spark, d).select("nationkey", "dotted")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    # keys travel, names are made after the last shuffle; orders meet their customers before their lines
    j = li.join(sized(s, 32), F.col("l_suppkey") == F.col("s_suppkey")).join(sized(p, 32), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(o.join(sized(c, 32), F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    of = lambda name: F.broadcast(m.select(F.col("nationkey").alias(f"_{name}"), F.col("dotted").alias(name)))
    j = j.join(of("_mc"), F.col("c_nationkey") == F.col("__mc")).join(of("_ms"), F.col("s_nationkey") == F.col("__ms"))
    return j.select("*", _s("$_mc", ".c", "$c_custkey").alias("caller"), _s("$_ms", ".S", "$s_suppkey").alias("class_sig"), _s("lib", "$p_size", ".p", "$p_partkey").alias("lib"))


def call_sites(spark: SparkSession, d: str, same_names: bool = False) -> DataFrame:
    ctor = F.col("l_linenumber") % 2 == 1
    callee = F.when(F.col("l_returnflag") == "R", F.lit(None)).when(ctor, F.concat("class_sig", F.lit(".__init__"))).otherwise(F.col("lib"))
    key = F.col("l_suppkey") % 10 if same_names else F.col("l_suppkey")
    return _lines(spark, d).select(F.col("caller").alias("caller_signature"), F.concat(F.lit("S"), key.cast("string")).alias("method_name"), ctor.alias("is_constructor_call"), callee.alias("callee_signature"), "l_orderkey", "l_linenumber")


def second_edges(spark: SparkSession, d: str) -> DataFrame:
    """A second edge list, with pairs of the first one and edges between libraries."""
    x = _lines(spark, d).filter("l_linenumber <= 2")
    core = F.concat(F.lit("lib"), (F.col("p_size") % 10).cast("string"), F.lit(".core"))
    source = F.when(F.col("l_linenumber") == 1, F.col("caller")).otherwise(F.col("lib"))
    target = F.when(F.col("l_returnflag") == "A", F.concat("class_sig", F.lit(".__init__"))).otherwise(core)
    g = x.groupBy(source.alias("source"), target.alias("target")).agg(F.count("*").alias("weight"))
    return g.select("source", "target", F.lit("CALL_DEP").alias("type"), "weight", F.array(F.lit("pycg")).alias("provenance"))


FACTS_SQL = """
modules AS (SELECT n_nationkey AS nationkey, '/proj/r' || n_regionkey || '/n' || n_nationkey || '.py' AS file_key, 'n' || n_nationkey AS module_name,
            'r' || n_regionkey || '.n' || n_nationkey AS dotted FROM nation),
classes AS (SELECT dotted || '.S' || s_suppkey AS signature, 'S' || s_suppkey AS name, file_key, s_suppkey AS ord FROM supplier JOIN modules ON s_nationkey = nationkey),
homonyms AS (SELECT DISTINCT dotted || '.S' || (s_suppkey % 10) AS signature, 'S' || (s_suppkey % 10) AS name, file_key, s_suppkey % 10 AS ord FROM supplier JOIN modules ON s_nationkey = nationkey),
callables AS (SELECT dotted || '.c' || c_custkey AS signature, 'c' || c_custkey AS name, file_key, c_custkey AS ord FROM customer JOIN modules ON c_nationkey = nationkey
              UNION ALL SELECT signature || '.__init__', '__init__', file_key, ord FROM classes),
lines AS (SELECT l.*, mc.dotted || '.c' || c_custkey AS caller, ms.dotted || '.S' || s_suppkey AS class_sig, p_size, 'lib' || p_size || '.p' || p_partkey AS lib
          FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN modules mc ON c_nationkey = mc.nationkey
          JOIN supplier ON l_suppkey = s_suppkey JOIN modules ms ON s_nationkey = ms.nationkey JOIN part ON l_partkey = p_partkey),
call_sites AS (SELECT caller AS caller_signature, 'S' || l_suppkey AS method_name, 'S' || (l_suppkey % 10) AS short_name, l_linenumber % 2 = 1 AS is_constructor_call,
               CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linenumber % 2 = 1 THEN class_sig || '.__init__' ELSE lib END AS callee_signature FROM lines),
edges AS (SELECT caller_signature AS source, callee_signature AS target, count(*) AS weight FROM call_sites WHERE callee_signature <> '' GROUP BY ALL),
second AS (SELECT CASE WHEN l_linenumber = 1 THEN caller ELSE lib END AS source,
                  CASE WHEN l_returnflag = 'A' THEN class_sig || '.__init__' ELSE 'lib' || (p_size % 10) || '.core' END AS target, count(*) AS weight
           FROM lines WHERE l_linenumber <= 2 GROUP BY ALL),
merged AS (SELECT source, target, CAST(sum(weight) AS BIGINT) AS weight, string_agg(p, '|' ORDER BY p) AS provenance
           FROM (SELECT *, 'jedi' AS p FROM edges UNION ALL SELECT *, 'pycg' FROM second) GROUP BY ALL),
declared AS (SELECT signature FROM callables UNION SELECT signature FROM classes),
sig_file AS (SELECT signature, max(file_key) AS file_key FROM (SELECT signature, file_key FROM callables UNION ALL SELECT signature, file_key FROM classes) GROUP BY ALL),
module_graph AS (SELECT a.file_key AS src_file, b.file_key AS dst_file, CAST(sum(weight) AS BIGINT) AS weight
                 FROM edges JOIN sig_file a ON source = a.signature JOIN sig_file b ON target = b.signature WHERE a.file_key <> b.file_key GROUP BY ALL)
"""


def with_facts(sql: str, recursive: bool = False) -> str:
    """SQL that begins with more CTEs (and a SELECT), after the facts."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{FACTS_SQL}{sql}"


# source


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their file: (k, name, nation, r, g, least group of the nation, file_key, dotted)."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r"), F.col("n_name").alias("nation"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("c_name"), "c_nationkey", F.floor(F.col("c_custkey") / GROUP).cast("long").alias("g"))
    least = c.groupBy("c_nationkey").agg(F.min("g").alias("m"))
    c = c.join(least, "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.withColumn("file_key", _s("r", "$r", "/n", "$c_nationkey", "/g", "$g", ".py")).withColumn("dotted", _s("r", "$r", ".n", "$c_nationkey", ".g", "$g"))


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Rendered Python, one file for each nation and group of customers, as ``source_files``."""
    c = _customers(spark, d)
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    x = x.withColumn("k", F.col("o_custkey")).withColumn("g", F.floor(F.col("k") / GROUP).cast("long"))  # whose customer is missing goes at the join below
    call = (
        F.when(F.col("l_returnflag") == "R", _s("    mystery", "$p_size", "(a)"))
        .when(F.col("l_linenumber") == 4, F.lit("    Root(1).grow(2)"))
        .when(F.col("l_linenumber") % 2 == 1, _s("    G", "$g", "(a)"))
        .when(F.col("l_linenumber") == 2, _s("    c", "$k", "(b)"))
        .otherwise(_s("    lib", "$p_size", ".p", "$l_partkey", "(a)"))
    )
    body = x.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(call)), "\n").alias("body"))
    fn = c.join(body, "k", "left").select(
        "file_key", "k", "nation", "g", "m",
        _s("def c", "$k", "(a, b=", (F.col("k") % 7).cast("string"), ', *rest, k=1, **kw):\n    """', "$c_name", '"""\n    total = a\n',
           F.when(F.col("k") % 2 == 1, F.lit("    if a and b:\n        total = b\n")).otherwise(F.lit("")),
           F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), "    return total\n").alias("text"),
    )
    libs = ", ".join(f"lib{i}" for i in range(1, 51))
    head = _s('"""', "$nation", " ", "$g", f'"""\nimport {libs}\nfrom .g', "$m", " import G", "$m", " as Root\nfrom tools import saw, hammer as h\nLIMIT = ", "$g", "\n\n\nclass G", "$g",
              '(Base):\n    """', "$nation", '"""\n    size: int = ', "$g", '\n    kind = "x"\n\n    def __init__(self, x):\n        self.x = x\n\n    def grow(self, by, times=2):\n        return self.x * by if times and by else self.x\n\n\n')
    files = fn.groupBy("file_key", "nation", "g", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]), "\n\n").alias("defs")).repartition(wide(spark), "file_key")
    src = files.select("file_key", F.concat(head, F.col("defs")).alias("source"))
    return src.select("file_key", "source", F.lit(0.0).alias("last_modified"), F.octet_length("source").cast("long").alias("file_size"), N.sha256(F.col("source")).alias("content_hash"), F.lit(None).cast("string").alias("error"))


SOURCE_SQL = f"""
cust AS (SELECT c_custkey AS k, c_name, n_name AS nation, n_regionkey AS r, c_nationkey AS n, c_custkey // {GROUP} AS g, min(c_custkey // {GROUP}) OVER (PARTITION BY c_nationkey) AS m
         FROM customer JOIN nation ON c_nationkey = n_nationkey),
fns AS (SELECT *, 'r' || r || '/n' || n || '/g' || g || '.py' AS file_key, 'r' || r || '.n' || n || '.g' || g AS dotted, 'r' || r || '.n' || n || '.g' || m AS root FROM cust),
files AS (SELECT DISTINCT file_key, dotted, root, nation, g, m FROM fns),
calls AS (SELECT f.*, p_size, l_partkey, l_linenumber, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN fns f ON o_custkey = f.k)
"""


def with_source(sql: str) -> str:
    return f"WITH {SOURCE_SQL}{sql}"
