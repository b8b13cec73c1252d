"""Resolving dotted references across files.

References come from extraction as dotted names. Here they meet the names that files define (under the path their signature
begins with and under the path that imports use), import bindings (so that a package may re-export), and the
classes' ancestors (so that a method is found where it is inherited from). Each distinct reference is resolved once.
What leads out of the project keeps its dotted name; what isn't known stays null.
"""

from __future__ import annotations

import builtins
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph import runtime as R
from srcgraph.functions import names as N
from srcgraph.operators.relations import modules, relation

BUILTIN_CLASSES = tuple(sorted(f"builtins.{n}" for n, v in vars(builtins).items() if isinstance(v, type)))


def defined_names(extracted: DataFrame) -> DataFrame:
    """(dotted, signature, kind) of all definitions, by signature and by the name that imports use."""
    m = modules(extracted).select("file_key", F.col("dotted").alias("_import"))
    defs = relation(extracted, "classes").select("file_key", "signature", F.lit("class").alias("kind")).union(relation(extracted, "callables").select("file_key", "signature", F.lit("callable")))
    # only a package's __init__ has a path that differs from its import name
    by_import = defs.join(m, "file_key").filter("signature LIKE '%.\\_\\_init\\_\\_.%' AND file_key LIKE '%\\_\\_init\\_\\_.py'")
    tail = F.regexp_extract(F.expr("substring(signature, length(_import) + 1)"), r"^\.?__init__(\..*)$", 1)
    other = by_import.select(F.when(F.col("_import") == "", F.expr("substring(signature, 10)")).otherwise(F.concat("_import", tail)).alias("dotted"), "signature", "kind")
    return defs.select(F.col("signature").alias("dotted"), "signature", "kind").union(other).groupBy("dotted").agg(F.max("signature").alias("signature"), F.min("kind").alias("kind"))


def resolve_names(refs: DataFrame, names: DataFrame, bindings: DataFrame) -> DataFrame:
    """(ref, at, signature, kind): ``at`` is where re-exports lead; signature and kind are null where nothing is defined there.

    All re-exports are followed, but none twice on one way (``via``), as names in a circle may grow for ever.
    """
    now = refs.select("ref", F.col("ref").alias("at"), F.lit(0).alias("star"), F.expr("CAST(array() AS array<string>)").alias("via"), F.lit(0).alias("hop")).distinct()
    b = bindings.filter("dotted <> target").groupBy("dotted").agg(F.max("target").alias("target"))
    plain, star = b.filter("dotted NOT LIKE '%.*'"), b.filter("dotted LIKE '%.*'").select(F.expr("substring(dotted, 1, length(dotted) - 2)").alias("dotted"), F.expr("substring(target, 1, length(target) - 2)").alias("target"))
    every = now
    for hop in count(1):
        parts = now.select("ref", "at", "via", F.posexplode(F.split("at", "\\.")).alias("i", "_p"))
        cuts = parts.select("ref", "at", "via", F.expr("array_join(slice(split(at, '\\\\.'), 1, i + 1), '.')").alias("_front"), F.col("i"))
        rest = F.expr("substring(at, length(_front) + 1)")
        best = F.max_by(F.struct(F.concat("target", rest).alias("to"), "via", "dotted"), "i").alias("best")
        to = cuts.join(plain, F.col("_front") == F.col("dotted")).groupBy("ref", "at").agg(best).select("ref", F.col("best.to").alias("at"), F.lit(0).alias("star"), "best.via", "best.dotted")
        by_star = cuts.join(star, F.col("_front") == F.col("dotted")).filter(F.length(rest) > 0).select("ref", F.concat("target", rest).alias("at"), F.lit(1).alias("star"), "via", F.concat("dotted", F.lit(".*")).alias("dotted"))
        new = to.union(by_star).filter(~F.array_contains("via", F.col("dotted"))).withColumn("via", F.array_append("via", F.col("dotted")))
        new = new.groupBy("ref", "at", "star").agg(F.min("via").alias("via")).withColumn("hop", F.lit(hop))
        now = R.cut(new.join(every.select("ref", "at").distinct(), ["ref", "at"], "left_anti"))
        if now.isEmpty():
            break
        every = R.cut(every.union(now))
    hit = every.join(names.select(F.col("dotted").alias("at"), "signature", "kind"), "at", "left")
    best = F.struct(F.col("signature").isNotNull().cast("int").alias("hit"), (-F.col("star")).alias("s"), F.col("at"), F.col("signature"), F.col("kind"))
    # of the places that a name leads to: one that defines it, else the one furthest along plain imports
    b = hit.groupBy("ref").agg(F.max(best).alias("b"))
    last = every.filter("star = 0 AND at <> ref").groupBy("ref").agg(F.max_by("at", F.struct("hop", "at")).alias("last"))
    return b.join(last, "ref", "left").select("ref", F.when(F.col("b.hit") == 1, F.col("b.at")).otherwise(F.coalesce("last", "ref")).alias("at"), F.col("b.signature").alias("signature"), F.col("b.kind").alias("kind"))


def ancestors(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(signature, ancestor, rank): a class's ancestors that the project defines, nearest first, bases in order; rank: levels, then each level's base."""
    base = classes.select("signature", F.posexplode("base_refs").alias("i", "ref")).join(found.filter("kind = 'class'").select("ref", F.col("signature").alias("ancestor")), "ref").select("signature", "ancestor", F.array(F.lit(1), "i").alias("rank"))
    base = R.cut(base.filter("signature <> ancestor"))
    every, front = base, base
    while True:
        step = base.select(F.col("signature").alias("ancestor"), F.col("ancestor").alias("next"), F.element_at("rank", 2).alias("r"))
        front = R.cut(front.join(step, "ancestor").select("signature", F.col("next").alias("ancestor"), F.concat(F.array(F.element_at("rank", 1) + 1), F.expr("slice(rank, 2, size(rank))"), F.array("r")).alias("rank")).filter("signature <> ancestor").join(every, ["signature", "ancestor"], "left_anti").groupBy("signature", "ancestor").agg(F.min("rank").alias("rank")))
        if front.isEmpty():
            break
        every = R.cut(every.union(front))
    return every.groupBy("signature", "ancestor").agg(F.min("rank").alias("rank"))


def references(extracted: DataFrame) -> DataFrame:
    """(_ref, _how, callee_signature, is_constructor_call): what each distinct (callee_ref, ref_kind) of the call sites is; of constructor calls, none is without a callee."""
    classes = relation(extracted, "classes")
    asked = R.cut(relation(extracted, "call_sites").filter("callee_ref IS NOT NULL").select("callee_ref", "ref_kind").distinct())
    names, bindings = R.cut(defined_names(extracted)), relation(extracted, "bindings").select("dotted", "target")
    own = asked.select(F.col("callee_ref").alias("ref")).distinct()
    heads = own.select(N.parent(F.col("ref")).alias("ref")).filter("ref <> ''")
    refs = own.union(heads).union(classes.select(F.explode("base_refs")).filter("col IS NOT NULL")).distinct()
    found = R.cut(resolve_names(refs, names, bindings))
    up = ancestors(classes, found)
    # a method that the class itself doesn't define, or that super() asks the ancestors for
    head = found.filter("kind = 'class'").select(F.col("ref").alias("_head"), F.col("signature").alias("_class"))
    member = asked.withColumn("_head", N.parent(F.col("callee_ref"))).withColumn("_attr", N.last_part(F.col("callee_ref"))).join(head, "_head")
    inherited = member.join(up, F.col("_class") == F.col("signature")).select("callee_ref", "ref_kind", F.concat("ancestor", F.lit("."), "_attr").alias("dotted"), "rank")
    inherited = inherited.join(names.filter("kind = 'callable'").select("dotted", F.col("signature").alias("_up")), "dotted").groupBy("callee_ref", "ref_kind").agg(F.min_by("_up", "rank").alias("_up"))
    # each reference is looked up once, and sites take what it is by one join
    s = asked.join(found.select(F.col("ref").alias("callee_ref"), F.col("at").alias("_at"), F.col("signature").alias("_sig"), F.col("kind").alias("_kind")), "callee_ref", "left")
    s = s.join(inherited, ["callee_ref", "ref_kind"], "left")
    s = s.join(head.select(F.col("_head").alias("_h"), F.lit(True).alias("_in")), N.parent(F.col("callee_ref")) == F.col("_h"), "left")
    outside = F.col("ref_kind").isin("import", "builtin", "instance") | (F.col("ref_kind") == "member") & F.col("_in").isNull()
    target = (
        F.when(F.col("ref_kind") == "super", F.col("_up"))
        .when(F.col("_kind") == "class", F.concat("_sig", F.lit(".__init__")))
        .when(F.col("_sig").isNotNull(), F.col("_sig"))
        .when(F.col("_up").isNotNull(), F.col("_up"))
        .when(F.col("callee_ref").isin(*BUILTIN_CLASSES), F.concat("callee_ref", F.lit(".__init__")))
        .when(outside, F.col("_at"))
    )
    ctor = (F.col("ref_kind") != "super") & ((F.col("_kind") == "class") | F.col("callee_ref").isin(*BUILTIN_CLASSES))
    return s.select(F.col("callee_ref").alias("_ref"), F.col("ref_kind").alias("_how"), target.alias("callee_signature"), F.coalesce(ctor, F.lit(False)).alias("is_constructor_call"))


def with_callees(sites: DataFrame, known: DataFrame) -> DataFrame:
    """Call sites with what their ``references`` are."""
    # sites without a reference are spread: they match nothing, and would else all go to one task
    key = F.coalesce("callee_ref", F.concat(F.lit(" "), F.pmod(F.xxhash64("caller_signature", "ord"), F.lit(1 << 20)).cast("string")))
    out = sites.withColumn("_key", key).join(known, (F.col("_key") == F.col("_ref")) & (F.col("ref_kind") == F.col("_how")), "left")
    return out.select(*[c for c in sites.columns if c not in ("callee_ref", "ref_kind")], "callee_signature", F.coalesce("is_constructor_call", F.lit(False)).alias("is_constructor_call"))


def callees(sites: DataFrame, known: DataFrame) -> DataFrame:
    """(source, target, weight) of the sites that have a callee, counted by reference before they are joined."""
    n = sites.filter("callee_ref IS NOT NULL").groupBy("caller_signature", "callee_ref", "ref_kind").agg(F.count("*").alias("n"))
    e = n.join(known.filter("callee_signature <> ''"), (F.col("callee_ref") == F.col("_ref")) & (F.col("ref_kind") == F.col("_how")))
    return e.groupBy(F.col("caller_signature").alias("source"), F.col("callee_signature").alias("target")).agg(F.sum("n").alias("weight"))


def resolve_calls(extracted: DataFrame) -> DataFrame:
    """The call sites with ``callee_signature`` and ``is_constructor_call``."""
    return with_callees(relation(extracted, "call_sites"), references(extracted))
