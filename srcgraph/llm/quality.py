"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are computed in numpy over chunks of bytes. The trees are fitted on a sample of
labelled documents of at most ``MAX_LABELLED`` rows (those of least hash of ``doc_id``, one row an id; the bound is a
parameter), and every document is scored.

Defined results: a null text, or one without a word, scores 0 and is rejected; null labels don't count; several labels
of a document are averaged and count as 1 from 0.5 on; without labels, or with one class only, the score is that
class's smoothed share, the same for all texts; repeated rows are each scored, and of those that share a labelled
``doc_id`` the one of least statistics is fitted; a null ``doc_id`` is scored like any;
empty tables give empty results; columns besides ``doc_id`` and ``text`` pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.llm import boosting
from srcgraph.llm import common as C

MAX_LABELLED, KEEP_AT = 20_000, 0.5
FEATURES = ("log_bytes", "log_words", "mean_word", "upper", "digit", "space", "symbol", "high", "symbols_per_word", "repeated_words", "short_words", "long_words", "entropy", "mean_line", "repeated_lines", "symbol_entropy")
_UPPER, _LOWER, _DIGIT, _SPACE, _SYMBOL, _HIGH = range(6)


def _classes() -> np.ndarray:
    c = np.full(256, _SYMBOL, np.uint8)
    c[128:], c[65:91], c[97:123], c[48:58] = _HIGH, _UPPER, _LOWER, _DIGIT
    c[[9, 10, 11, 12, 13, 32]] = _SPACE
    c[:9] = c[14:32] = _SYMBOL
    return c


_CLASS = _classes()


def _repeats(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many of a row's hashes it has had before."""
    if not len(h):
        return np.zeros(rows)
    # rows fit in the low bits: a collision across them would need equal upper bits as well
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=rows)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[rows, len(FEATURES)] for texts in ``data``; a row without words is all NaN."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(rows), size)
    hist = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256)
    by = np.stack([hist[:, _CLASS == k].sum(1) for k in range(6)], 1)
    s, e, words = C.word_spans(data, offsets)
    length = e - s
    wrow = np.repeat(np.arange(rows), words)
    repeated = _repeats(C.span_hashes(data, s, e), wrow, rows)
    breaks = np.flatnonzero(data == 10)
    ls, le = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    lrow = np.searchsorted(offsets[1:], ls, "right")
    real = (le > ls) & (lrow < rows)
    ls, le, lrow = ls[real], le[real], lrow[real]
    lines = np.bincount(lrow, minlength=rows)
    relines = _repeats(C.span_hashes(data, ls, le), lrow, rows)

    def entropy(counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(1), 1)[:, None]
        p = counts / total
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    n, w, letters = np.maximum(size, 1), np.maximum(words, 1), np.maximum(by[:, _UPPER] + by[:, _LOWER], 1)
    out = np.stack(
        [
            np.log1p(size), np.log1p(words), length_sum(length, wrow, rows) / w, by[:, _UPPER] / letters, by[:, _DIGIT] / n, by[:, _SPACE] / n, by[:, _SYMBOL] / n, by[:, _HIGH] / n,
            by[:, _SYMBOL] / w, repeated / w, np.bincount(wrow, length <= 3, rows) / w, np.bincount(wrow, length > 12, rows) / w, entropy(hist), size / np.maximum(lines, 1), relines / np.maximum(lines, 1), entropy(hist[:, _CLASS == _SYMBOL]),
        ],
        1,
    ).astype(np.float32)
    out[words == 0] = np.nan
    return out


def length_sum(length: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, length, rows)


def score_column(model: boosting.Trees, column: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for _, _, data, offsets, null in C.chunks(column):
        x = features(data, offsets)
        p = boosting.predict(model, x)
        p[np.isnan(x[:, 0]) | null] = 0
        out.append(p)
    return np.concatenate(out)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offsets, _ in C.chunks(b.column(2)):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float32()))], names=["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> boosting.Trees:
    """Trees fitted on at most ``max_labelled`` labelled documents."""
    y = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_sg_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_sg_y"))
    y = y.orderBy(F.xxhash64("_sg_id"), "_sg_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").alias("_sg_id"), "text").filter("text IS NOT NULL").join(F.broadcast(y), "_sg_id").select("_sg_id", "_sg_y", "text")
    schema = T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType()))])
    got = rows.mapInArrow(C.trimmed(_sampled), schema).groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).select("y", "x").toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    t = got.column("y").to_numpy().astype(float)
    ok = ~np.isnan(x[:, 0])
    x, t = x[ok], t[ok]
    order = np.lexsort((t, *x.T[::-1]))
    return boosting.fit(x[order], t[order])


def _scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = score_column(model.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= KEEP_AT)], names=["doc_id", "score", "keep"])

    return run


def _filter(model, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score_column(model.value, b.column(at)) >= KEEP_AT))

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, keep) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(C.trimmed(_scorer(model)), schema)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rows that score below ``KEEP_AT``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(C.trimmed(_filter(model, docs.columns.index("text"))), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
