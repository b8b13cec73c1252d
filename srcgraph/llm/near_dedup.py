"""MinHash near-dedup by fast similarity sketching (Dahlgaard, Knudsen, Thorup, FOCS 2017).

A document's set is its shingles of ``SHINGLE`` words of lower-case text. In round ``i`` each shingle is hashed to a
value and, for the first ``SLOTS`` rounds, to one of ``SLOTS`` coordinates; from then on round ``SLOTS + j`` puts every
shingle into coordinate ``j``. A coordinate keeps its least (round, value). A document stops at the end of the
round in which all its coordinates are filled, so long texts need one or two hashes a shingle, and every coordinate
fills after ``2 * SLOTS`` rounds. Coordinates agree with probability equal to the Jaccard similarity and are
concentrated like independent MinHashes.

Then: ``BANDS`` bands of ``ROWS`` coordinates give buckets; pairs within a bucket are verified exactly on their shingle
sets (similarity of at least ``THRESHOLD``); classes are the connected components of verified pairs. Texts equal in
every byte are one node of that graph, so thousands of copies cost one node. Candidates come in rounds that
together miss no link of a bucket, without a cap: first every member against the bucket's least node; then, for buckets
whose members aren't all connected yet, pairs of members from different components (pairs within a component can't
change the components). In buckets of up to ``SMALL`` members those are all such pairs. The members of larger ones, which
mostly share a passage and nothing else, are joined exactly by prefixes of their sets (Xiao et al., PPJoin, WWW 2008):
shingles are ordered from rare to common, and of two sets as similar as the threshold the shorter one's first third
and the longer one's first half share a shingle, at places that leave room for the overlap needed. A passage that many
share is last in that order, so documents that have only it in common never meet.

Results are rows, not lists: no task holds a class, and hot keys are only ever aggregated or joined.

Defined results: a null text has no copies and is in no class; an empty text, or one without words, is in a class
with texts equal in every byte only; one with fewer than ``SHINGLE`` words has one shingle of all its words; a null
``doc_id`` is in no class and never dropped; classes whose least ``doc_id`` is the same, as it is repeated, share their id; rows equal in ``doc_id`` and text are copies, of which one stays; ties go to
the least ``doc_id``; empty tables give empty results; columns besides ``doc_id`` and ``text`` are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.llm import common as C

SHINGLE, SLOTS, ROWS, BANDS, THRESHOLD = 3, 160, 4, 40, 0.5
SMALL = 32  # members of a bucket whose pairs are all verified
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_M = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each shingle of lower-case texts, by row; repeated shingles repeat."""
    s, e, n = C.word_spans(data, offsets)
    h = C.span_hashes(data, s, e)
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    pos = np.arange(len(h)) - first[row] if len(h) else np.zeros(0, np.int64)
    left = n[row] - pos  # words from here to the end of the row
    x = h * _M[0]
    for j in range(1, k):
        there = left > j
        at = np.flatnonzero(there)
        x[at] += h[at + j] * (_M[j % 5] + np.uint64(2 * (j // 5)))
    keep = (left >= k) | (pos == 0)
    return C.mix(x[keep]), row[keep]


def sketch(h: np.ndarray, row: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """[rows, slots] of coordinates; a row without shingles has ``_EMPTY`` in all."""
    out = np.full((rows, slots), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    todo = np.bincount(row, minlength=rows) > 0
    for i in range(2 * slots):
        if not len(h):
            break
        x = C.mix(h ^ np.uint64((i * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
        value = (x & np.uint64((1 << 54) - 1)) | np.uint64(i << 54)
        bin_ = ((x >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64) if i < slots else i - slots
        np.minimum.at(flat, row * slots + bin_, value)
        full = (out != _EMPTY).all(1)
        if (full & todo).any():
            todo &= ~full
            keep = todo[row]
            h, row = h[keep], row[keep]
    return out


def band_keys(sk: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = np.zeros((len(sk), bands), np.uint64)
    for j in range(rows):
        x = x * _M[1] + sk[:, j : bands * rows : rows] * _M[(j + 2) % 5]
        C.mix(x)
    x += np.arange(bands, dtype=np.uint64) * _M[0]
    return C.mix(x).view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = []
        for lo, hi, data, offsets, null in C.chunks(b.column(2)):
            h, row = shingles(data, offsets)
            has = np.bincount(row, minlength=hi - lo) > 0
            keys = band_keys(sketch(h, row, hi - lo))[has]
            at = np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1))))
        if parts:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.concat_arrays(parts)], names=["_sg_id", "_sg_key", "_sg_bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = []
        for lo, hi, data, offsets, null in C.chunks(b.column(2)):
            h, row = shingles(data, offsets)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo)))).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64))))
        if parts:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.concat_arrays(parts)], names=["node", "n", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the least node of the component.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014) until nothing changes; each step's edges
    are written to the shared folder. Least neighbours are grouped minima, joined back, so a star's hub is no task's burden.
    """
    e = C.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each greater neighbour of a goes to the least of a and its neighbours
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = C.cut(e.join(least, "a").select(F.least("a", "m").alias("a"), "b").filter("a <> b").distinct())
        # small star: the lesser neighbours of b and b itself go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        e = C.cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(e.select(F.col("a").alias("node"), F.col("a").alias("comp"))).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """Each whole row with its doc_id and the key of its text; a null text has a null key."""
    return docs.select(F.struct("*").alias("_sg_row"), F.col("doc_id").alias("_sg_id"), F.when(F.col("text").isNotNull(), C.text_key(F.col("text"))).alias("_sg_key"))


def _sized(small: DataFrame, width: int) -> DataFrame:
    """``small``, which is written already, to be broadcast if its rows of ``width`` bytes take at most ``common.BROADCAST_BYTES``."""
    return F.broadcast(small) if small.count() * width <= C.BROADCAST_BYTES else small


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (node, shingles) are similar enough."""
    p = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    p = p.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return p.filter(both >= THRESHOLD * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def small_bucket_pairs(open_: DataFrame) -> DataFrame:
    """Pairs of different components of (k, node, comp): fewer than ``SMALL`` for a member."""
    x, y = open_.alias("x"), open_.alias("y")
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components of (node, comp), among them all that are similar enough."""
    t = C.cut(sets.join(nodes, "node").select("node", "comp", F.size("shingles").alias("len"), F.explode("shingles").alias("x")))
    df = t.groupBy("x").agg(F.count("*").alias("df"), (F.min("comp") != F.max("comp")).alias("open"))
    ranked = t.join(df, "x").groupBy("node", "comp", "len").agg(F.array_sort(F.collect_list(F.struct("df", "x", "open"))).alias("r"))
    need = lambda share: F.ceil(F.col("len") * F.lit(share) - F.lit(1e-9)).cast("int")
    half = F.col("len") - need(THRESHOLD) + 1
    at = ranked.select("node", "comp", "len", F.posexplode(F.slice("r", 1, half)).alias("i", "e")).filter("e.open").select("node", "comp", "len", "i", "e.x")
    at = C.cut(at)
    share = THRESHOLD / (1 + THRESHOLD)
    s, r = at.filter(F.col("i") < F.col("len") - need(2 * share) + 1).alias("s"), at.alias("r")
    c = F.col
    shorter = (c("s.len") < c("r.len")) | (c("s.len") == c("r.len")) & (c("s.node") < c("r.node"))
    room = F.least(c("s.len") - c("s.i"), c("r.len") - c("r.i")) >= (c("s.len") + c("r.len")) * F.lit(share) - F.lit(1e-9)
    fits = (c("s.x") == c("r.x")) & (c("s.comp") != c("r.comp")) & shorter & (c("s.len") >= c("r.len") * F.lit(THRESHOLD)) & room
    return s.join(r, fits).select(F.least("s.node", "r.node").alias("a"), F.greatest("s.node", "r.node").alias("b")).distinct()


class Classes:
    """The classes of one table, and what they were found by; every part is written to the shared folder."""

    def __init__(self, docs: DataFrame):
        base = _keyed(docs.select("doc_id", "text")).filter("_sg_id IS NOT NULL AND _sg_key IS NOT NULL")
        base = base.select("_sg_id", "_sg_key", F.col("_sg_row.text").alias("_sg_text"))
        self.rows = base.select("_sg_id", "_sg_key")
        schema = T.StructType([T.StructField("_sg_id", base.schema["_sg_id"].dataType), T.StructField("_sg_key", T.StringType()), T.StructField("_sg_bands", T.ArrayType(T.LongType()))])
        lower = F.lower("_sg_text").alias("_sg_text")
        rows = base.select("_sg_id", "_sg_key", lower).mapInArrow(C.trimmed(_bands), schema)
        # one node for each text; numbered as it is written, so that bands, pairs and edges carry 8 bytes a node
        nodes = rows.groupBy("_sg_key").agg(F.min("_sg_id").alias("_sg_id"), F.count("*").alias("n"), F.first("_sg_bands").alias("bands"))
        self.nodes = C.cut(nodes.withColumn("node", F.monotonically_increasing_id()))
        every = self.nodes.select("node", F.explode("bands").alias("k"))
        least = every.groupBy("k").agg(F.count("*").alias("size"), F.min("node").alias("m")).filter("size > 1")
        members = C.cut(every.join(least, "k"))
        first = C.cut(members.filter("node <> m").select(F.col("m").alias("a"), F.col("node").alias("b")).distinct())
        # the text of each node that is in a bucket, once
        wanted = C.cut(self.nodes.select("node", "n", "_sg_id", "_sg_key").join(members.select("node").distinct(), "node", "left_semi"))
        texts = base.join(_sized(wanted, 128), ["_sg_id", "_sg_key"]).select("node", "n", lower)
        sets = C.cut(texts.mapInArrow(C.trimmed(_sets), "node long, n long, shingles array<long>"))
        self.sets = sets.filter("n = 1").unionByName(sets.filter("n > 1").dropDuplicates(["node"])).select("node", "shingles")
        found = C.cut(verified(first, self.sets))
        near = members.select("k", "node", "size").join(components(found), "node", "left").select("k", "node", "size", F.coalesce("comp", "node").alias("comp"))
        near = C.cut(near)
        split = near.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("k")
        open_ = C.cut(near.join(split, "k", "left_semi"))
        pairs = small_bucket_pairs(open_.filter(F.col("size") <= SMALL)).union(prefix_pairs(open_.filter(F.col("size") > SMALL).select("node", "comp").distinct(), self.sets)).distinct()
        self.pairs = C.cut(pairs.join(first, ["a", "b"], "left_anti"))
        self.links = C.cut(found.union(verified(self.pairs, self.sets)))
        self.first = first

    def of_texts(self) -> DataFrame:
        """(_sg_key, n, links, _sg_group, _sg_group_key) of texts in classes of two rows or more: rows of the text, its verified links to other texts, and the least (doc_id, key) of the class, whose row stays."""
        comp = components(self.links)
        ends = self.links.select(F.col("a").alias("node")).union(self.links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
        t = self.nodes.select("node", "_sg_key", "_sg_id", "n").join(comp, "node", "left").join(ends, "node", "left")
        t = C.cut(t.select("_sg_key", "_sg_id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("comp")))
        c = t.groupBy("comp").agg(F.sum("n").alias("total"), F.min(F.struct(F.col("_sg_id").alias("id"), F.col("_sg_key").alias("key"))).alias("least")).filter("total > 1")
        return t.join(c, "comp").select("_sg_key", "n", "links", F.col("least.id").alias("_sg_group"), F.col("least.key").alias("_sg_group_key"))


def groups(docs: DataFrame) -> DataFrame:
    """(_sg_id, _sg_key, n, links, _sg_group, _sg_group_key) of every row with a ``doc_id`` and a text that is in a class of two rows or more. Repeated rows repeat."""
    c = Classes(docs)
    return c.rows.join(_sized(C.cut(c.of_texts()), 128), "_sg_key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row in a class of two or more: ``doc_id``, ``class_id`` (the class's least doc_id) and ``n_links``: its copies, and other texts that were verified to be near it (what was connected already isn't verified again)."""
    return groups(docs).select(F.col("_sg_id").alias("doc_id"), F.col("_sg_group").alias("class_id"), (F.col("n") - 1 + F.col("links")).alias("n_links"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each class: the row of least doc_id (and, among equal ids, of the class's own text) stays."""
    g = C.cut(groups(docs))
    gone = C.cut(g.filter("_sg_id <> _sg_group OR _sg_key <> _sg_group_key").select("_sg_id", "_sg_key").distinct())
    kept = _keyed(docs).join(_sized(gone, 96), ["_sg_id", "_sg_key"], "left_anti")
    twice = g.filter("_sg_id = _sg_group AND _sg_key = _sg_group_key").groupBy("_sg_id", "_sg_key").count().filter("count > 1").select("_sg_id", "_sg_key")
    twice = C.cut(twice)
    if twice.isEmpty():
        return kept.select("_sg_row.*")
    twice = _sized(twice, 96)
    again = kept.join(twice, ["_sg_id", "_sg_key"], "left_semi").dropDuplicates(["_sg_id", "_sg_key"])
    return kept.join(twice, ["_sg_id", "_sg_key"], "left_anti").unionByName(again).select("_sg_row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
