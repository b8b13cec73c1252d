"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a row's language are multiplied: the text's likelihood under hashed byte trigrams (counted
over all documents of known language), the language that the markup declares, the address suffix, and the host's prior.
How far declarations and suffixes can be trusted is counted over all rows, as is each host's mix of languages; hosts are
smoothed towards their domain (the last two labels) and domains towards the whole, with each row left out of its own
counts. Counts use the language that a row's text alone gives. A trigram counts as ``EVIDENCE`` of one, as each byte is in
three of them; the whole text counts, however long.

Rows are ``pages`` (html, without its markup) and ``documents`` (their source is the host; nothing is declared).

Defined results: null and empty texts give no text evidence; a null or unknown declaration, suffix or host gives none of
its kind; rows without any evidence get the commonest language; documents of null language aren't trained on; without
any known language the result's language is null; equal probabilities go to the lesser name; repeated rows are each
judged; null ids stay null; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.llm import common as C
from srcgraph.llm import urls as U

BUCKETS, EVIDENCE, SMOOTH_COUNT, SMOOTH_HOST = 1 << 15, 1 / 3, 0.5, 10.0
LANGUAGES = C.BROADCAST_BYTES // (BUCKETS * 4)  # whose tables are made and sent together; more take several passes
_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte but the last two."""
    d = _LOWER[data].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64)
    h = d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64)


def plain(html: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(html, _MARKUP, " ")


def _count(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(names) * BUCKETS, np.int64)
        for b in batches:
            which = np.array([at[x] for x in b.column(0).to_pylist()], np.int64)
            for lo, hi, data, offsets, _ in C.chunks(b.column(1)):
                h = trigrams(data)
                size = np.maximum(np.diff(offsets), 0)
                row = np.repeat(which[lo:hi], size)[: len(h)]
                inside = np.ones(len(h) + 2, bool)
                for back in (1, 2):  # a row's last two bytes begin no trigram
                    p = offsets[1:] - back
                    inside[p[(p >= offsets[:-1]) & (p >= 0)]] = False
                inside = inside[: len(h)]
                counts += np.bincount(row[inside] * BUCKETS + h[inside], minlength=len(counts))
        for i, n in enumerate(names):
            c = counts[i * BUCKETS : (i + 1) * BUCKETS]
            if c.any():
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([c.astype("<i8").tobytes()], pa.binary())], names=["lang", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = np.frombuffer(c, "<i8")
            total[n] = total[n] + c if n in total else c
    for n, c in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([c.tobytes()], pa.binary())], names=["lang", "counts"])


def train(docs: DataFrame) -> tuple[list[str], list[Broadcast]]:
    """(languages, [bucket, language] tables of log-likelihoods), counted over all documents of known language; a table has ``LANGUAGES`` languages at most, so that neither a task nor the driver holds all counts at once."""
    known = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    names = sorted(r.lang for r in known.select("lang").distinct().collect())
    tables = []
    for lo in range(0, len(names), LANGUAGES):
        part = names[lo : lo + LANGUAGES]
        counts = np.zeros((len(part), BUCKETS))
        theirs = known.filter(F.col("lang").between(part[0], part[-1]))
        per_task = theirs.mapInArrow(_count(part), "lang string, counts binary")
        for r in per_task.repartition(len(part), "lang").mapInArrow(_add, "lang string, counts binary").collect():
            counts[part.index(r.lang)] = np.frombuffer(r.counts, "<i8")
        smooth = counts + SMOOTH_COUNT
        tables.append(docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32))))
    return names, tables


def likelihoods(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """[rows, languages]: log-likelihood of each text."""
    h = trigrams(data)
    n = np.maximum(np.diff(offsets) - 2, 0)
    start = np.minimum(offsets[:-1], len(h))
    out = np.empty((len(n), sum(t.shape[1] for t in tables)))
    at = 0
    for table in tables:
        for j in range(table.shape[1]):
            c = np.concatenate(([0.0], np.cumsum(table[:, j][h], dtype=np.float64)))
            out[:, at] = c[start + n] - c[start]
            at += 1
    return out * EVIDENCE


def _read(shared: list[Broadcast], markup: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b.value for b in shared]
        kind = pa.list_(pa.float64())
        for b in batches:
            for lo, hi, *_ in C.chunks(b.column(b.num_columns - 1)):
                part = b.slice(lo, hi - lo)
                text = part.column(part.num_columns - 1)
                for _, _, data, offsets, _ in C.chunks(plain(text) if markup else text, 1 << 62):
                    ll = likelihoods(data, offsets, tables)
                    ll[np.diff(offsets) < 3] = 0
                    top = pa.array(ll.argmax(1).astype(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * ll.shape[1]), pa.array(ll.reshape(-1))).cast(kind)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pc.if_else(pa.array(np.diff(offsets) >= 3), top, None)], names=[*part.schema.names[:-1], "ll", "top"])

    return run


def _fuse(names: list[str], total: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(names)
    everywhere = (np.array(total, float) + 1) / (sum(total) + k)

    def matrix(column: pa.Array) -> np.ndarray:
        """Counts by language from maps, zeros for null."""
        out = np.zeros((len(column), k))
        maps = column.cast(pa.map_(pa.int32(), pa.int64()))
        row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(maps.cast(pa.list_(pa.struct([("key", pa.int32()), ("value", pa.int64())])))), 0).to_numpy(zero_copy_only=False))
        entries = maps.cast(pa.list_(pa.struct([("key", pa.int32()), ("value", pa.int64())]))).flatten()
        out[row, entries.field(0).to_numpy(zero_copy_only=False)] = entries.field(1).to_numpy(zero_copy_only=False)
        return out

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (4 << 20) // k)  # rows whose matrices are held at once
        for b in batches:
            yield from (b.slice(i, step) for i in range(0, max(b.num_rows, 1), step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n = b.num_rows
            col = {x: b.column(i) for i, x in enumerate(b.schema.names)}
            ll = col["ll"].flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            top = col["top"].fill_null(-1).to_numpy(zero_copy_only=False)
            own = np.zeros((n, k))
            has = np.flatnonzero(top >= 0)
            own[has, top[has]] = 1
            left = lambda c: np.maximum(matrix(col[c]) - own, 0)
            prior = np.tile(everywhere, (n, 1))
            for level in ("n_domain", "n_host"):
                c = left(level)
                prior = (c + SMOOTH_HOST * prior) / (c.sum(1, keepdims=True) + SMOOTH_HOST)
            score = ll + np.log(prior)
            for kind in ("n_declared", "n_suffix"):
                c = left(kind)
                rest = np.maximum(np.array(total) - own, 0)
                share = c.sum(1, keepdims=True) / np.maximum(rest.sum(1, keepdims=True), 1)
                p = (c + SMOOTH_HOST * share) / (rest + SMOOTH_HOST)
                seen = c.sum(1) > 0
                score[seen] += np.log(p[seen])
            score -= score.max(1, keepdims=True) if n else 0
            p = np.exp(score)
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            text = pa.array([names[t] if t >= 0 else None for t in top], pa.string())
            yield pa.RecordBatch.from_arrays([col["doc_id"], col["page_id"], pa.array([names[i] for i in best], pa.string()), pa.array(p[np.arange(n), best]), text], names=["doc_id", "page_id", "lang", "probability", "text_lang"])

    return run


def declared(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, lang, probability, text_lang) for every row of both; a document has no page_id and a page no doc_id."""
    spark = docs.sparkSession
    names, tables = train(docs)
    ids = (docs.schema["doc_id"].dataType, pages.schema["page_id"].dataType)
    out = T.StructType([T.StructField("doc_id", ids[0]), T.StructField("page_id", ids[1]), T.StructField("lang", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("text_lang", T.StringType())])
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    if not names:
        d = docs.select("doc_id", null(ids[1], "page_id"))
        both = d.unionByName(pages.select(null(ids[0], "doc_id"), "page_id"))
        return both.select("*", null("string", "lang"), null("double", "probability"), null("string", "text_lang"))
    facts = T.StructType([*out.fields[:2], *(T.StructField(x, T.StringType()) for x in ("host", "domain", "suffix", "declared")), T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("top", T.IntegerType())])
    h = F.nullif(F.regexp_replace(U.host(F.col("url")), r":\d*$", ""), F.lit(""))
    p = pages.select(null(ids[0], "doc_id"), "page_id", h.alias("host"), F.nullif(F.regexp_extract(h, r"([^.]+\.[^.]+)\.?$", 1), F.lit("")).alias("domain"), F.nullif(U.suffix(F.col("url")), F.lit("")).alias("suffix"), declared(F.col("html")).alias("declared"), "html")
    d = docs.select("doc_id", null(ids[1], "page_id"), F.concat(F.lit("source:"), "source").alias("host"), null("string", "domain"), null("string", "suffix"), null("string", "declared"), "text")
    rows = C.cut(d.mapInArrow(_read(tables, False), facts).unionByName(p.mapInArrow(_read(tables, True), facts)))
    total = [0] * len(names)
    for r in rows.filter("top IS NOT NULL").groupBy("top").count().collect():
        total[r["top"]] = r["count"]
    for key in ("host", "domain", "suffix", "declared"):
        rows = _with_counts(rows, key)
    return rows.select("doc_id", "page_id", "ll", "top", "n_host", "n_domain", "n_suffix", "n_declared").mapInArrow(_fuse(names, total), out)


def _with_counts(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with n_<key>: a map from language to how many rows of the same key have it.

    Where there are too many keys to broadcast, those with a thousandth of all rows or more, a thousand at most, still
    are: no task gets all rows of a hot host.
    """
    one = rows.filter(f"{key} IS NOT NULL AND top IS NOT NULL").groupBy(key, "top").agg(F.count("*").alias("n"))
    by = C.cut(one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("top", "n"))).alias(f"n_{key}"), F.sum("n").alias("_n"), F.count("*").alias("_k")))
    keys, entries, every = by.agg(F.count("*"), F.coalesce(F.sum("_k"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if keys * 64 + entries * 16 <= C.BROADCAST_BYTES // 4:
        return rows.join(F.broadcast(by.drop("_n", "_k")), key, "left")
    hot = by.filter(F.col("_n") * 1000 >= every).select(key, f"n_{key}", F.lit(True).alias("_hot"))
    some = rows.join(F.broadcast(hot), key, "left")
    cold = some.filter("_hot IS NULL").drop(f"n_{key}", "_hot").join(by.filter(F.col("_n") * 1000 < every).drop("_n", "_k"), key, "left")
    return some.filter("_hot").drop("_hot").unionByName(cold)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "pages"))
