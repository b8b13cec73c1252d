"""URL filter: gradient-boosted trees on lexical features, trained from labelled URLs.

Features come from the address alone (lengths, path depth, digit ratios, entropies, parameter counts, ...) and from
statistics of its suffix, the last label of its host (the last two where a country's registry sells names under a second one,
as in ``co.uk``; ``ip`` for a number): how many addresses and hosts it has over all rows, and the
smoothed share of bad ones among the labelled, each labelled row left out of its own. All string work is done by
Arrow kernels and numpy over whole batches.

``train`` takes any (url, bad) rows. The tables at hand have no labelled addresses, so the query labels them from
``SEED_WORDS``, words that give a bad host away; the features don't look at words, so the trees learn what such
addresses look like. At most ``MAX_LABELLED`` labelled rows are fitted (those of least hash; a parameter); statistics
cover all rows.

Defined results: a null or empty url has no host and scores 0; what isn't a URL is treated as a host and path; null
labels don't count; of rows that tie for the sample's last place those of lesser url go first; repeated rows are each scored; a null ``page_id`` stays null; without labels, or with one class, the
score is that class's smoothed share; empty tables give empty results; columns besides ``page_id`` and ``url`` are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.llm import boosting
from srcgraph.llm import common as C

MAX_LABELLED, BLOCK_AT, SMOOTH = 20_000, 0.5, 20.0
SEED_WORDS = ("spam", "pills", "casino", "bets", "adult", "ads-", "porn", "viagra")
_PARTS = r"(?s)^(?:(?P<scheme>[A-Za-z][A-Za-z0-9+.\-]*)://)?(?P<host>[^/?#]*)(?P<path>[^?#]*)(?P<query>\?[^#]*)?(?P<fragment>#.*)?$"
FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "digit_share", "host_digit_share", "parameters", "fragment", "https", "entropy", "host_entropy", "path_entropy", "escapes", "longest_label", "upper_share", "suffix_rate", "suffix_urls", "suffix_hosts")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)", 1))


def suffix(url: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(host(url), r"^.*@", ""), r":\d*$", "")
    plain = F.regexp_extract(h, r"(?:^|[^.]*\.)((?:co|com|org|net|gov|edu|ac)\.[a-z]{2}|[^.]*)\.?$", 1)
    return F.when(h.rlike(r"^(?:\d+\.){3}\d+$|^\["), F.lit("ip")).otherwise(plain)


def _entropy(column: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for lo, hi, data, offsets, _ in C.chunks(column):
        n = hi - lo
        hist = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 256 + data, minlength=n * 256).reshape(n, 256)
        p = hist / np.maximum(hist.sum(1), 1)[:, None]
        out.append(-(p * np.log2(np.where(p > 0, p, 1))).sum(1))
    return np.concatenate(out)


def lexical(urls: pa.Array) -> np.ndarray:
    """[rows, all features but the suffix's]"""
    urls = pc.fill_null(urls, "")
    got = pc.extract_regex(urls, _PARTS)
    scheme, host_, path, query, fragment = (pc.fill_null(pc.struct_field(got, k), "") for k in ("scheme", "host", "path", "query", "fragment"))
    num = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float32)
    size = lambda a: num(pc.binary_length(a))
    some = lambda a: np.maximum(size(a), 1)
    labels = pc.split_pattern(host_, ".")
    widths = num(pc.binary_length(labels.flatten()))
    at = labels.offsets.to_numpy()[:-1] - labels.offsets.to_numpy()[0] if len(labels) else np.zeros(0, int)
    longest = np.maximum.reduceat(widths, at) if len(at) else np.zeros(0, np.float32)
    return np.stack(
        [
            size(urls), size(host_), size(path), size(query), num(pc.count_substring_regex(path, "/[^/]")), num(pc.count_substring(host_, ".")) + (size(host_) > 0), num(pc.count_substring(host_, "-")),
            num(pc.count_substring_regex(urls, "[0-9]")) / some(urls), num(pc.count_substring_regex(host_, "[0-9]")) / some(host_), num(pc.count_substring_regex(query, "[?&][^&]")), size(fragment) > 0, num(pc.equal(pc.utf8_lower(scheme), "https")),
            _entropy(urls), _entropy(host_), _entropy(path), num(pc.count_substring(urls, "%")), longest, num(pc.count_substring_regex(urls, "[A-Z]")) / some(urls),
        ],
        1,
    ).astype(np.float32)


def _suffix_features(rate: pa.Array, urls: pa.Array, hosts: pa.Array) -> np.ndarray:
    num = lambda a, x: pc.fill_null(a.cast(pa.float64()), x).to_numpy(zero_copy_only=False)
    return np.stack([num(rate, 0.5), np.log1p(num(urls, 0.0)), np.log1p(num(hosts, 0.0))], 1).astype(np.float32)


class Filter:
    """A trained filter: trees and the suffixes' statistics."""

    def __init__(self, pages: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED):
        spark = pages.sparkSession
        own = pages.select("url", suffix(F.col("url")).alias("_sg_suffix"), host(F.col("url")).alias("_sg_host"))
        hosts = own.groupBy("_sg_suffix", "_sg_host").agg(F.count("*").alias("n"))
        stats = hosts.groupBy("_sg_suffix").agg(F.sum("n").alias("_sg_urls"), F.count("*").alias("_sg_hosts"))
        y = labelled.filter("bad IS NOT NULL AND url IS NOT NULL").select("url", F.col("bad").cast("int").alias("_sg_bad"), suffix(F.col("url")).alias("_sg_suffix"))
        rates = y.groupBy("_sg_suffix").agg(F.count("*").alias("_sg_n"), F.sum("_sg_bad").alias("_sg_b"))
        total = rates.agg(F.coalesce(F.sum("_sg_n"), F.lit(0)), F.coalesce(F.sum("_sg_b"), F.lit(0))).first()
        self.prior = (total[1] + 1) / (total[0] + 2)
        self.stats = C.cut(stats.join(rates, "_sg_suffix", "full").fillna(0))
        sample = y.orderBy(F.xxhash64("url"), "url", "_sg_bad").limit(max_labelled)
        rows = sample.join(self.stats, "_sg_suffix")
        left_out = (F.col("_sg_b") - F.col("_sg_bad") + F.lit(SMOOTH * self.prior)) / (F.col("_sg_n") - 1 + F.lit(SMOOTH))
        got = rows.select("url", "_sg_bad", left_out.alias("rate"), "_sg_urls", "_sg_hosts").toArrow()
        col = lambda k: got.column(k).combine_chunks()
        if got.num_rows:
            x = np.concatenate([lexical(col("url")), _suffix_features(col("rate"), col("_sg_urls"), col("_sg_hosts"))], 1)
        else:
            x = np.zeros((0, len(FEATURES)), np.float32)
        t = got.column("_sg_bad").to_numpy().astype(float)
        order = np.lexsort((t, *x.T[::-1]))
        self.model = boosting.fit(x[order], t[order])
        self.shared = spark.sparkContext.broadcast(self.model)

    def score(self, pages: DataFrame) -> DataFrame:
        """(page_id, url, score, blocked) for every row."""
        stats = F.broadcast(self.stats) if self.stats.count() * 64 <= C.BROADCAST_BYTES else self.stats
        rate = (F.col("_sg_b") + F.lit(SMOOTH * self.prior)) / (F.col("_sg_n") + F.lit(SMOOTH))
        rows = pages.select("page_id", "url", suffix(F.col("url")).alias("_sg_suffix")).join(stats, "_sg_suffix", "left").select("page_id", "url", rate.alias("rate"), "_sg_urls", "_sg_hosts")
        schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("blocked", T.BooleanType())])
        return rows.mapInArrow(_scorer(self.shared), schema)


def _scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([lexical(b.column(1)), _suffix_features(b.column(2), b.column(3), b.column(4))], 1)
            p = boosting.predict(model.value, x)
            p[x[:, 0] == 0] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array(p >= BLOCK_AT)], names=["page_id", "url", "score", "blocked"])

    return run


def seed_labels(pages: DataFrame) -> DataFrame:
    """(url, bad): whether the host holds one of ``SEED_WORDS``."""
    return pages.select("url", host(F.col("url")).rlike("|".join(SEED_WORDS)).cast("int").alias("bad"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return Filter(pages, seed_labels(pages)).score(pages)
