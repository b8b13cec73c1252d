"""The call graph as relations: edges from call sites, merging, filtering, externals, and views of it as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import names as N
from srcgraph.runtime import sized

LEVEL_1, LEVEL_2 = "jedi", "pycg"


def resolved(call_sites: DataFrame) -> DataFrame:
    """Sites with a callee; null and '' are none."""
    return call_sites.filter("callee_signature <> ''")


def call_edges(call_sites: DataFrame, provenance: str = LEVEL_1) -> DataFrame:
    """One edge for each (caller, callee), its weight the number of sites."""
    e = resolved(call_sites).select(F.col("caller_signature").alias("source"), F.col("callee_signature").alias("target"))
    return typed(e.groupBy("source", "target").agg(F.count("*").alias("weight")), provenance)


def typed(edges: DataFrame, provenance: str = LEVEL_1) -> DataFrame:
    """Edges of (source, target, weight)."""
    return edges.select("source", "target", F.lit("CALL_DEP").alias("type"), "weight", F.array(F.lit(provenance)).alias("provenance"))


def merge_edges(*lists: DataFrame) -> DataFrame:
    """Edges of all lists by (source, target): weights added, the first one's type; provenance is a sorted union where several meet, and else as it was."""
    every = None
    for i, e in enumerate(lists):
        part = e.select("source", "target", "type", "weight", "provenance", F.lit(i).alias("_list"))
        every = part if every is None else every.union(part)
    g = every.groupBy("source", "target").agg(
        F.min_by("type", "_list").alias("type"),
        F.sum("weight").cast("long").alias("weight"),
        F.count("*").alias("_n"),
        F.min_by("provenance", "_list").alias("_own"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("provenance")))).alias("_union"),
    )
    return g.select("source", "target", "type", "weight", F.when(F.col("_n") == 1, F.col("_own")).otherwise(F.col("_union")).alias("provenance"))


def coalesce_edges(edges: DataFrame, order: str) -> DataFrame:
    """Edges of several shards by (source, target): weights added, the first one's provenance and type by ``order``."""
    return edges.groupBy("source", "target").agg(F.min_by("type", order).alias("type"), F.sum("weight").cast("long").alias("weight"), F.min_by("provenance", order).alias("provenance"))


def app_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with an end among ``symbols`` (signature). Two equi-joins, as an OR of keys would plan a nested loop."""
    s = symbols.select("signature").distinct()
    e = edges.join(s.select(F.col("signature").alias("source"), F.lit(True).alias("_s")), "source", "left")
    e = e.join(s.select(F.col("signature").alias("target"), F.lit(True).alias("_t")), "target", "left")
    return e.filter("_s OR _t").select(*edges.columns)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("signature")).union(edges.select(F.col("target").alias("signature"))).distinct()


def external_symbols(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """(signature, name, module) of ends that the project doesn't declare."""
    sig = F.col("signature")
    return endpoints(edges).join(declared.select("signature"), "signature", "left_anti").select("signature", N.last_part(sig).alias("name"), N.owner_module(sig).alias("module"))


def graph_nodes(edges: DataFrame, callables: DataFrame) -> DataFrame:
    """All declared callables and all ends; ``ghost`` where an end isn't one."""
    known = callables.select("signature").distinct().withColumn("_known", F.lit(True))
    return endpoints(edges).join(known, "signature", "full").select("signature", F.col("_known").isNull().alias("ghost"))


def callees(edges: DataFrame, signature: str) -> DataFrame:
    return edges.filter(F.col("source") == signature)


def callers(edges: DataFrame, signature: str) -> DataFrame:
    return edges.filter(F.col("target") == signature)


def from_graph(edges: DataFrame) -> DataFrame:
    """Edges of a bare graph (source, target and perhaps more) with what is missing filled in."""
    have = set(edges.columns)
    col = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    return edges.select("source", "target", col("type", F.lit("CALL_DEP")).alias("type"), col("weight", F.lit(1)).cast("long").alias("weight"), col("provenance", F.array().cast("array<string>")).alias("provenance"))


def endpoint_kinds(edges: DataFrame, externals: DataFrame, declared: DataFrame) -> DataFrame:
    """(signature, kind, name, module): an end is external if listed, else declared if it is, else external by its own name."""
    e = endpoints(edges)
    e = e.join(externals.select("signature", F.col("name").alias("_name"), F.col("module").alias("_module"), F.lit(True).alias("_ext")), "signature", "left")
    e = e.join(declared.select("signature").distinct().withColumn("_decl", F.lit(True)), "signature", "left")
    kind = F.when(F.col("_ext"), "external").when(F.col("_decl"), "declared").otherwise("fallback")
    name = F.when(kind == "external", F.col("_name")).when(kind == "fallback", N.last_part(F.col("signature")))
    return e.select("signature", kind.alias("kind"), name.alias("name"), F.col("_module").alias("module"))


def resolve_constructors(call_sites: DataFrame, classes: DataFrame) -> DataFrame:
    """Unresolved constructor calls get the class of their name whose parent is the longest raw prefix of the caller.

    A class without a parent scores 0; ties go to the first class by (file_key, ord). The choice depends on (caller, name)
    only, so it is made once for each such pair and joined back.
    """
    open_ = (F.coalesce(F.col("callee_signature"), F.lit("")) == "") & F.col("is_constructor_call")
    c = classes.select(F.col("name").alias("method_name"), F.col("signature").alias("_class"), N.parent(F.col("signature")).alias("_parent"), F.struct("file_key", "ord").alias("_at"))
    # by name and prefix, as of a name there may be as many classes as modules; no more lengths than the longest parent has characters
    lengths = sorted(r.n for r in c.select(F.length("_parent").alias("n")).distinct().collect())
    pairs = call_sites.filter(open_).select("caller_signature", "method_name").distinct()
    prefixes = F.explode(F.array(*[F.when(F.length("caller_signature") >= n, F.expr(f"substring(caller_signature, 1, {n})")) for n in lengths] or [F.lit(None).cast("string")]))
    scored = pairs.select("caller_signature", "method_name", prefixes.alias("_parent")).join(sized(c, 256), ["method_name", "_parent"])
    best = scored.groupBy("caller_signature", "method_name").agg(F.min(F.struct((-F.length("_parent")).alias("s"), F.col("_at").alias("at"), F.col("_class").alias("c"))).alias("_b"))
    found = best.select("caller_signature", "method_name", F.concat("_b.c", F.lit(".__init__")).alias("_found"))
    out = call_sites.join(found, ["caller_signature", "method_name"], "left")
    return out.withColumn("callee_signature", F.when(open_, F.coalesce("_found", "callee_signature")).otherwise(F.col("callee_signature"))).select(*call_sites.columns)


def constructor_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many sites became resolved, as one row."""
    n = lambda df: df.agg(F.count(F.when(F.col("callee_signature") != "", 1)).alias("n"))
    return n(after).withColumnRenamed("n", "a").crossJoin(n(before).withColumnRenamed("n", "b")).select((F.col("a") - F.col("b")).alias("n_resolved"))


def module_graph(edges: DataFrame, sig_to_file: DataFrame) -> DataFrame:
    """(src_file, dst_file, weight) between different files of the project."""
    f = sig_to_file
    e = edges.join(f.select(F.col("signature").alias("source"), F.col("file_key").alias("src_file")), "source")
    e = e.join(f.select(F.col("signature").alias("target"), F.col("file_key").alias("dst_file")), "target")
    return e.filter("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.sum("weight").cast("long").alias("weight"))


def undirected(graph: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b and both directions added."""
    return graph.groupBy(F.least("src_file", "dst_file").alias("a"), F.greatest("src_file", "dst_file").alias("b")).agg(F.sum("weight").cast("long").alias("weight"))
