"""What the operators of this package share: shared-folder access, cut lineage, and byte-level numpy passes over Arrow text columns.

Text passes work on Arrow buffers: a batch is cut into chunks of whole rows of about ``CHUNK_BYTES`` (a longer
text is a chunk of its own), and every step runs on the chunk's bytes at once. Nulls arrive as empty texts plus
a mask. Internal columns begin with ``_sg_`` so that they don't clash with columns of the input.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_BYTES = 2 << 20
#: Bytes that a broadcast of collected values may take; operators that would send more take another way.
BROADCAST_BYTES = 64 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode, where that is unset, one of our own that goes with the process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="srcgraph-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(at or own)
    return at or sc.getCheckpointDir()


def placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, written to the shared folder, with ``_sg_n``: a row's place among those of equal ``keys``, from 0.

    Places are counted by partition and added up, so that rows of one key, however many, stay where they are.
    """
    own = cut(df).withColumn("_sg_i", F.monotonically_increasing_id()).withColumn("_sg_p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_sg_p", *keys).orderBy("_sg_i")) - 1
    parts = own.groupBy(*keys, "_sg_p").agg(F.count("*").alias("_sg_c"))
    before = F.coalesce(F.sum("_sg_c").over(Window.partitionBy(*keys).orderBy("_sg_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "_sg_p", before.alias("_sg_before"))
    return own.withColumn("_sg_w", within).join(parts, [*keys, "_sg_p"]).withColumn("_sg_n", F.col("_sg_w") + F.col("_sg_before")).drop("_sg_i", "_sg_p", "_sg_w", "_sg_before")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def batches(spark: SparkSession, rows: int, size: int) -> None:
    """How many rows, and about how many bytes of them, go to Python at once from here on: what a task holds beside its own work."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; equal texts have equal keys."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant mod 2^64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for key, base in (("up", _ODD), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[key] = p
    return _powers["up"][:n], _powers["down"][:n]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is-null) of a string or binary array, without copying its bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary())
    n = len(column)
    null = column.is_null().to_numpy(zero_copy_only=False)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = int(offsets[0])
    return raw[lo : int(offsets[-1])], offsets - lo, null


def chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets, is-null) for chunks of whole rows."""
    data, offsets, null = binary_parts(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + target, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[end])
        yield at, end, data[lo:hi], offsets[at : end + 1] - lo, null[at:end]
        at = end


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the system after each batch: Python workers live on between stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        for b in run(batches):
            yield b
            del b
            pa.default_memory_pool().release_unused()
            if trim is not None:
                trim(0)

    return wrapped


def _word_bytes() -> np.ndarray:
    is_word = np.zeros(256, bool)
    is_word[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        is_word[a:b] = True
    return is_word


WORD = _word_bytes()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of ASCII letters, digits and bytes over 127), and how many each row has; none crosses rows."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    w = WORD[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edges = offsets[:-1][(offsets[:-1] < n)]
    first[edges] = w[edges]
    last = w.copy()
    last[:-1] &= ~w[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = w[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.diff(np.searchsorted(s, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of the bytes, equal for equal contents wherever they stand."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.multiply(up[:n], data.astype(np.uint64) + np.uint64(1), out=c[1:])
    np.add.accumulate(c, out=c)
    h = (c[ends] - c[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64)
    return mix(h)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row, for rows that may be empty."""
    c = np.empty(len(values) + 1, np.int64)
    c[0] = 0
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]
