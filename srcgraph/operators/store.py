"""A property graph kept as Parquet, updated incrementally.

Applications share a store. What a module owns belongs to its application: such a node is one of (application, label, value),
so two applications with files of the same name don't meet; nodes that no module owns (packages, decorators, symbols outside)
are one for all, are merged and never dropped. An edge belongs to the application that pushed it; its ends are that
application's own nodes or shared ones.

A push compares its application's modules by content hash. Of changed modules it drops what they own (declarations that are
gone, outgoing edges) and takes the new rows; a full push also drops this application's modules that no longer exist, with
all they own. Rows lie in buckets by (application, module); a push writes the buckets that it touches and a manifest that
names the others' versions, and then publishes it with one appended row, so a failed push leaves the store as it was. The
version before the current one stays for its readers; older ones, and buckets that neither names, are removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.operators import propgraph
from srcgraph.runtime import current, cut, published, publish, remove

BUCKETS, SHARED = 64, -1
_NODE = "labels array<string>, key_prop string, value string, props map<string,string>, app string, module string"
_EDGE = "type string, from_label string, from_key string, from_value string, to_label string, to_key string, to_value string, props map<string,string>, app string, module string"
_MANIFEST = "kind string, bucket int, version string"
_KEYS = ["type", "from_label", "from_key", "from_value", "to_label", "to_key", "to_value", "app"]


def changed_modules(old: DataFrame, new: DataFrame) -> DataFrame:
    """File keys whose hash is new, missing or different; both have (file_key, content_hash)."""
    j = new.select("file_key", "content_hash").join(old.select("file_key", F.col("content_hash").alias("_h"), F.lit(True).alias("_there")), "file_key", "left")
    return j.filter("_there IS NULL OR content_hash IS NULL OR _h IS NULL OR content_hash <> _h").select("file_key")


def vanished_modules(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("file_key"), "file_key", "left_anti").select("file_key")


def owned_edges(edges: DataFrame, owners: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges whose source no module owns, or one that changed. ``owners``: (label, value, module)."""
    o = owners.select(F.col("label").alias("from_label"), F.col("value").alias("from_value"), "module")
    e = edges.join(o, ["from_label", "from_value"], "left").join(changed.select(F.col("file_key").alias("module"), F.lit(True).alias("_c")), "module", "left")
    return e.filter("module IS NULL OR _c").select(*edges.columns)


def _scope() -> Column:
    """The application of what a module owns; '' for the rest."""
    return F.when(F.col("module").isNotNull(), F.col("app")).otherwise(F.lit(""))


def _bucket() -> Column:
    return F.when(F.col("module").isNull(), F.lit(SHARED)).otherwise(F.pmod(F.xxhash64("app", "module"), F.lit(BUCKETS)).cast("int"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by (application of what a module owns, labels[0], value): new properties over old ones, labels added. Columns of ``old``."""
    rows = old.withColumn("ord", F.lit(0)).unionByName(new.select(*old.columns).withColumn("ord", F.lit(1))).withColumn("scope", _scope())
    merged = propgraph.merge_nodes(rows, ["scope"], ["app", "module"])
    return merged.select(*old.columns)


def _unquoted(literal: Column) -> Column:
    """A script literal's text."""
    inner = F.expr("substring(_q, 2, length(_q) - 2)")
    for raw, escaped in (("'", "\\'"), ("\\", "\\\\")):
        inner = F.replace(inner, F.lit(escaped), F.lit(raw))
    return inner


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, version: str | None) -> list[tuple[str, int, str]]:
        """(kind, bucket, version) of a version: two rows a bucket at most."""
        return [tuple(r) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/{version}/manifest").collect()] if version else []

    def _rows(self, manifest: list[tuple[str, int, str]], kind: str, only: set[int] | None = None) -> DataFrame:
        ddl = _NODE if kind == "nodes" else _EDGE
        paths = [f"{self.path}/{v}/{k}/bucket={b}" for k, b, v in manifest if k == kind and (only is None or b in only)]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def read(self) -> tuple[DataFrame, DataFrame]:
        m = self._manifest(current(self.spark, self.path))
        return self._rows(m, "nodes"), self._rows(m, "edges")

    def modules(self) -> DataFrame:
        """(file_key, content_hash, app)"""
        return self._modules(self.read()[0]).select("file_key", "content_hash", "app")

    def _modules(self, nodes: DataFrame) -> DataFrame:
        own = nodes.filter("array_contains(labels, 'PyModule')").withColumn("_q", F.col("props")["content_hash"])
        return own.select(F.col("value").alias("file_key"), _unquoted(F.col("_q")).alias("content_hash"), "app")

    def push(self, nodes: DataFrame, edges: DataFrame, app: str, full: bool = True) -> None:
        """Bring the store up to a projection of ``app``."""
        before = self._manifest(current(self.spark, self.path))
        quoted = nodes.withColumn("_q", F.col("props")["_module"])
        new = cut(quoted.withColumn("module", _unquoted(F.col("_q"))).withColumn("app", F.lit(app)).select("labels", "key_prop", "value", "props", "app", "module"))
        key = [F.col("labels")[0].alias("label"), "value", "module"]
        owners = new.filter("module IS NOT NULL").select(*key)
        own = self._rows(before, "nodes").filter((F.col("app") == app) & F.col("module").isNotNull())
        now = self._modules(new)
        stored = self._modules(own)
        changed = cut(changed_modules(stored, now).select(F.col("file_key").alias("module")))
        gone = vanished_modules(stored, now) if full else stored.select("file_key").limit(0)
        out = cut(changed.union(gone.select("file_key")))
        fresh = new.join(changed, "module", "left_semi").select(*new.columns).unionByName(new.filter("module IS NULL"))
        # what goes: nodes of modules that changed or vanished, unless they are pushed again; a node that moves leaves its bucket
        leaving = own.join(out, "module", "left_semi").select(*key)
        removed = cut(leaving.join(owners.join(changed, "module", "left_semi"), ["label", "value"], "left_anti").select("label", "value").distinct())
        moved = own.select(*key).join(owners.join(changed, "module", "left_semi").select("label", "value", F.col("module").alias("_to")), ["label", "value"]).filter("module <> _to")
        mine = F.col("app") == app
        loose = self._rows(before, "edges").filter(mine).join(removed.select(F.col("label").alias("to_label"), F.col("value").alias("to_value")), ["to_label", "to_value"], "left_semi")
        at = lambda df: df.select("module").withColumn("app", F.lit(app)).select(_bucket().alias("b"))
        touched = {r.b for r in at(out).union(at(moved)).union(at(loose)).distinct().collect()} | {SHARED}
        old_nodes, old_edges = self._rows(before, "nodes", touched), self._rows(before, "edges", touched)
        leaves = out.withColumn("app", F.lit(app))
        after = cut(upsert(old_nodes.join(leaves, ["app", "module"], "left_anti").select(*old_nodes.columns), fresh).withColumn("bucket", _bucket()).filter(F.col("bucket").isin(*touched)))
        source = owners.select(F.col("label").alias("from_label"), F.col("value").alias("from_value"), "module")
        add = edges.withColumn("app", F.lit(app)).join(source, ["from_label", "from_value"], "left")
        add = add.join(changed.withColumn("_c", F.lit(True)), "module", "left").filter("module IS NULL OR _c").select(*old_edges.columns)
        kept = old_edges.join(leaves, ["app", "module"], "left_anti").select(*old_edges.columns)
        both = kept.withColumn("_o", F.lit(0)).unionByName(add.withColumn("_o", F.lit(1)))
        merged = both.groupBy(*_KEYS).agg(F.max_by("props", "_o").alias("props"), F.max_by("module", F.struct("_o", "module")).alias("module"))
        # an edge needs both its ends: the application's own node or a shared one
        rest = [r for r in before if r[1] not in touched]
        there = self._rows(rest, "nodes").select("labels", "value", "app", "module").unionByName(after.select("labels", "value", "app", "module"))
        there = cut(there.select(_scope().alias("_s"), F.col("labels")[0].alias("_l"), F.col("value").alias("_v")).distinct())
        for side in ("from", "to"):
            ends = there.select(F.col("_l").alias(f"{side}_label"), F.col("_v").alias(f"{side}_value"), "_s")
            k = [f"{side}_label", f"{side}_value"]
            found = merged.join(ends.filter("_s <> ''").withColumnRenamed("_s", "app").withColumn("_own", F.lit(True)), [*k, "app"], "left")
            found = found.join(ends.filter("_s = ''").drop("_s").withColumn("_any", F.lit(True)), k, "left")
            merged = found.filter("_own OR _any").select(*old_edges.columns)
        merged = cut(merged.withColumn("bucket", _bucket()).filter(F.col("bucket").isin(*touched)))
        version = f"v-{uuid.uuid4().hex}"
        now_there = []
        for kind, rows in (("nodes", after), ("edges", merged)):
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}/{kind}")
            now_there += [(kind, r.bucket, version) for r in rows.select("bucket").distinct().collect()]
        manifest = rest + now_there
        self.spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/{version}/manifest")
        publish(self.spark, self.path, version)
        self._clean(before, manifest)

    def _clean(self, before: list[tuple[str, int, str]], manifest: list[tuple[str, int, str]]) -> None:
        """Remove versions that neither the current manifest nor the one before it needs."""
        versions = published(self.spark, self.path)
        needed = {v for *_, v in [*before, *manifest]} | set(versions[:2])
        for v in versions:
            if v not in needed:
                remove(self.spark, f"{self.path}/{v}")
