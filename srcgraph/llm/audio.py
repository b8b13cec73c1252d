"""Media columns: telephony audio to resampled PCM.

A payload is a binary column with a codec (``mulaw``, ``alaw``, ``ima_adpcm``) and a sample rate. mu-law and A-law (ITU-T
G.711) are expanded by 256-entry tables. IMA ADPCM comes in blocks of ``BLOCK_BYTES`` bytes (predictor, index, nibbles, low
one first): a block is decoded sample by sample, but all blocks of a chunk of rows at once, with tables for step and
index. PCM is resampled by windowed sinc, polyphase, and stored as little-endian 16-bit samples.

The tables at hand have no audio, so the query takes the bytes of each document's whole text as a payload at 8 kHz, its codec
by ``doc_id`` mod 3: any byte string is a valid payload of all three.

Defined results: a null payload, an unknown or null codec, or a rate that is null or not positive gives null PCM and 0
samples; an empty payload gives empty PCM; an ADPCM block cut short decodes as far as it goes, and one without a whole
header (4 bytes) has no samples; indices past 88 count as 88; samples beyond 16 bits are clipped; repeated rows are each
decoded; a null ``doc_id`` stays null (and is mu-law in the query); empty tables give empty results; other columns, whatever
their names, pass by untouched in the input and are not in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.llm import common as C

CODECS = ("mulaw", "alaw", "ima_adpcm")
BLOCK_BYTES, RATE, TARGET, ZEROS = 256, 8000, 16000, 8


def _mulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    e, m = (u >> 4 & 7).astype(int), (u & 15).astype(int)
    x = ((m << 3) + 132 << e) - 132
    return np.where(u & 128, -x, x).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    e, m = (a >> 4 & 7).astype(int), (a & 15).astype(int)
    x = np.where(e == 0, (m << 4) + 8, (m << 4) + 264 << np.maximum(e - 1, 0))
    return np.where(a & 128, x, -x).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()
# the standard's 89 step sizes: each about a tenth above the one before
STEPS = np.array(
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
    np.int32,
)
_N = np.arange(16)
DIFF = (STEPS[:, None] >> 3) + (STEPS[:, None] * (_N >> 2 & 1)) + ((STEPS[:, None] >> 1) * (_N >> 1 & 1)) + ((STEPS[:, None] >> 2) * (_N & 1))
DIFF = np.where(_N & 8, -DIFF, DIFF).astype(np.int32).reshape(-1)
NEXT = (np.clip(np.arange(89)[:, None] + np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2), 0, 88) * 16).astype(np.int32).reshape(-1)


def decode_adpcm(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(samples of all rows, samples of each row)"""
    size = np.diff(offsets)
    per = -(-size // block)
    row = np.repeat(np.arange(len(size)), per)
    first = offsets[:-1][row] + (np.arange(len(row)) - (np.cumsum(per) - per)[row]) * block
    length = np.minimum(block, offsets[1:][row] - first)
    ok = length >= 4
    row, first, length = row[ok], first[ok], length[ok]
    count = 1 + 2 * (length - 4)
    counts = np.bincount(row, count, len(size)).astype(np.int64)
    out = np.zeros(int(count.sum()), np.int16)
    if not len(out):
        return out, counts
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    first, count, begin = first[order], count[order], begin[order]
    lo, hi = data[first].astype(np.uint16), data[first + 1].astype(np.uint16)
    value = (lo | hi << np.uint16(8)).view(np.int16).astype(np.int32)
    index = np.minimum(data[first + 2], 88).astype(np.int32) * 16
    out[begin] = value
    for i in range(1, int(count[0])):
        n = int(np.searchsorted(-count, -i, "left"))
        if n < len(value):
            value, index, first, begin, count = value[:n], index[:n], first[:n], begin[:n], count[:n]
        byte = data[first + (4 + (i - 1 >> 1))]
        key = index + (byte & 15 if i & 1 else byte >> 4)
        value = np.clip(value + DIFF[key], -32768, 32767)
        index = NEXT[key]
        out[begin + i] = value
    return out, counts


def filters(up: int, down: int) -> tuple[np.ndarray, int]:
    """([up, taps] by phase, taps before the sample)"""
    cutoff = min(1.0, up / down)
    half = int(np.ceil(ZEROS / cutoff))
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = cutoff * np.sinc(cutoff * t) * np.cos(np.pi * t / (2 * half + 2)) ** 2
    h /= h.sum(1, keepdims=True)
    return h.astype(np.float32), half - 1


def resample(samples: np.ndarray, counts: np.ndarray, rate: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 16-bit samples from one rate to another; a row of n samples has ceil(n * target / rate) then."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    new = -(-counts * up // down)
    if up == down or not len(samples):
        return samples, new
    h, before = filters(up, down)
    taps = h.shape[1]
    # rows apart by enough zeros for the filter
    at = np.cumsum(counts + taps) - counts
    x = np.zeros(int(counts.sum() + (len(counts) + 1) * taps), np.float32)
    start = np.cumsum(counts) - counts
    x[np.arange(len(samples)) + np.repeat(at - start, counts)] = samples
    out = np.empty(int(new.sum()), np.float32)
    row_out = np.cumsum(new) - new
    if up <= 4 and down == 1:
        inside = np.arange(len(samples)) + np.repeat(at - start, counts)
        for p in range(up):
            y = x if up > 1 and p == 0 else np.convolve(x, h[p][::-1], "full")[taps - 1 - before :]
            out[p::up] = y[inside]
    else:
        k = np.arange(len(out)) - np.repeat(row_out, new)
        base, phase = np.repeat(at, new) + k * down // up - before, k * down % up
        for lo in range(0, len(out), 1 << 16):
            b = base[lo : lo + (1 << 16)]
            out[lo : lo + (1 << 16)] = np.einsum("nt,nt->n", x[b[:, None] + np.arange(taps)], h[phase[lo : lo + (1 << 16)]])
    np.rint(out, out=out)
    np.clip(out, -32768, 32767, out=out)
    return out.astype(np.int16), new


def expand(codec: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if codec == "ima_adpcm":
        return decode_adpcm(data, offsets)
    return (MULAW if codec == "mulaw" else ALAW)[data], np.diff(offsets)


def _decoder(target: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, *_ in C.chunks(whole.column(3), C.CHUNK_BYTES):
                b = whole.slice(lo, hi - lo)
                codec, rate = b.column(1).to_pylist(), b.column(2).to_pylist()
                group: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(codec, rate)):
                    if key[0] in CODECS and key[1] is not None and key[1] > 0:
                        group.setdefault(key, []).append(i)
                for (c, r), rows in group.items():
                    at = pa.array(rows, pa.int64())
                    data, offsets, null = C.binary_parts(b.column(3).take(at))
                    pcm, n = resample(*expand(c, data, offsets), r, target)
                    ends = np.concatenate(([0], np.cumsum(n))) * 2
                    stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pcm.astype("<i2").view(np.uint8))]).cast(pa.binary())
                    if null.any():
                        stored = pc.if_else(pa.array(~null), stored, None)
                    yield _batch(b, at, target, n, stored)
                rest = [i for i in range(b.num_rows) if not (codec[i] in CODECS and rate[i] is not None and rate[i] > 0)]
                if rest:
                    yield _batch(b, pa.array(rest, pa.int64()), target, np.zeros(len(rest), np.int64), pa.nulls(len(rest), pa.binary()))

    return run


def _batch(b: pa.RecordBatch, at: pa.Array, target: int, n: np.ndarray, pcm: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(at), target, np.int32)), pa.array(n.astype(np.int64)), pcm], names=["doc_id", "codec", "sample_rate", "n_samples", "pcm"])


def to_pcm(media: DataFrame, target: int = TARGET) -> DataFrame:
    """Rows of (doc_id, codec, sample_rate, payload) -> (doc_id, codec, sample_rate, n_samples, pcm)."""
    schema = T.StructType([T.StructField("doc_id", media.schema["doc_id"].dataType), T.StructField("codec", T.StringType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("n_samples", T.LongType()), T.StructField("pcm", T.BinaryType())])
    return media.select("doc_id", "codec", F.col("sample_rate").cast("int"), "payload").mapInArrow(_decoder(target), schema)


def text_media(docs: DataFrame) -> DataFrame:
    """The bytes of whole texts as payloads, the three codecs in turn."""
    codec = F.element_at(F.array(*map(F.lit, CODECS)), (F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(3)) + 1).cast("int"))
    return docs.select("doc_id", codec.alias("codec"), F.lit(RATE).alias("sample_rate"), F.col("text").cast("binary").alias("payload"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_pcm(text_media(C.table(spark, sf_dir, "documents")))
