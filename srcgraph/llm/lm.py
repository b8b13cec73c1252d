"""Language-model scoring by online logistic context mixing.

Predictors guess a byte's bits one by one, highest first. Three have the last 2, 3 or 5 bytes as their context. A context has
255 nodes, one for each prefix of a byte. How often a byte follows a context is counted over all documents, whatever
the size of the corpus; the predictor's output is the log-odds of a one at the node, of those counts less one, as one
occurrence is the scored text's own: what occurs nowhere else is not known. The fourth predictor's context is a hash of the
text so far: of the text's first ``FIRST`` bytes, twice as many and so on, and of all of it, how many other texts begin
with the same; where some do, it says how they go on, and with what odds. A document is then coded bit by bit: the
predictors' log-odds are combined by a set of weights that the bit's position gates, weights move along the gradient of the
coding cost after each byte, and the mix is refined by a table, by bit position and by the mix itself rounded, of
corrections that are learned likewise as the text goes by. Weights and corrections start afresh in every document, so
scores don't depend on the order of documents. ``total_bits`` is the cost of all bits. A text that occurs twice, or begins
like another, is known to the fourth predictor and costs less.

Counting and scoring are numpy passes. Only pairs of a context and a byte that occur are counted, and those that occur again kept, so the model grows
with the corpus and nothing bounds it: it is never in one place, but (for short contexts) in files of the shared folder, one for each predictor and
group of contexts, with sorted pairs and the log-odds on each one's way. A scoring task maps the files and takes from
them what its texts need; texts' own beginnings are counted by grouped aggregation and joined to their rows. Scoring runs many documents in step, longest first, one byte of each at a time.

Defined results: a null or empty text has 0 bytes and 0 bits, and null bits a byte; a null ``doc_id`` is scored like any;
repeated rows are each counted and scored; empty tables give empty results; columns besides ``doc_id`` and ``text`` are
not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.llm import common as C

ORDERS, FIRST = (2, 3, 5), 64
K = len(ORDERS) + 1  # predictors
GROUP_BYTES, GROWTH = 1 << 24, 0.7  # groups of contexts: one, times this power of the corpus in such units, as contexts grow slower than texts
PAIRS, COUNTED = 2 << 20, 1 << 31  # pairs a task gathers, and bytes it counts, before it sends them
SCALE, PRIOR = 16.0, (0.4, 0.4, 0.4, 0.1)  # log-odds are kept in 16ths; what is added to each count
LANES, STEPS, GROUP = 2048, 32, 8 << 20  # documents in step; bytes whose inputs are prepared at once; bytes of texts in step
RATE, START, REFINE_RATE, REFINE_CELLS = 0.001, (0.35, 0.35, 0.35, 0.7), 0.03, 17
#: A byte's bits.
BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(np.float32)
#: The first bytes of a word, by how many bits two bytes differ in from the highest such bit on.
_SHARED = np.array([(1 << 8 * (9 - n)) - 1 if n > 1 else (1 << 64) - 1 for n in range(9)], np.uint64)
_WIDTH = np.array([n.bit_length() for n in range(256)])


def windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte, with the ones before it within its row above it, 0 before its start."""
    most = max(ORDERS)
    padded = np.concatenate([np.zeros(7, np.uint8), data])
    w = np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)
    w &= np.uint64((1 << 8 * (most + 1)) - 1)
    for t in range(most):
        at = starts + t
        w[at[at < len(data)]] &= np.uint64((1 << 8 * (t + 1)) - 1)
    return w


def pairs(w: np.ndarray, k: int) -> np.ndarray:
    """Predictor k's context and the byte, of windows."""
    return w & np.uint64((1 << 8 * (ORDERS[k] + 1)) - 1)


def level(t: int) -> int:
    """Which beginning a byte belongs to: the first ``FIRST`` bytes are 0, as many again are 1, ..."""
    return (t // FIRST).bit_length()


def group(keys: np.ndarray, groups: int) -> np.ndarray:
    return (C.mix(keys >> np.uint64(8)) % np.uint64(groups)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, once each, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _counter(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sent(w: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(len(ORDERS)):
            keys, counts = summed(pairs(w, k), n)
            g = group(keys, groups)
            order = np.argsort(g, kind="stable")
            keys, counts, g = keys[order].astype("<u8"), counts[order].astype("<u4"), g[order]
            edges = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else np.zeros(1, int)
            for i in range(0, len(edges) - 1, 64):
                ends = edges[i : i + 65]
                raw = [keys[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(raw), pa.int32()), pa.array(g[ends[:-1]], pa.int64()), pa.array(raw, pa.binary())], names=["k", "g", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, done = Sums(), 0
        for b in batches:
            for _, _, data, offsets, _ in C.chunks(b.column(0)):
                for lo in range(0, len(data), C.CHUNK_BYTES):
                    e = pa.array(block(data, offsets[:-1], lo)).dictionary_encode()
                    sums.add(e.dictionary.to_numpy(), np.bincount(e.indices.to_numpy()))
                done += len(data)
                if sums.full() or done > COUNTED:
                    yield from sent(*sums.take())
                    done = 0
        yield from sent(*sums.take())

    return C.trimmed(run)


class Sums:
    """Counts of keys, added up whenever what is gathered has grown to twice what was there."""

    def __init__(self):
        self.found, self.size, self.most = [], 0, PAIRS

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.found.append((keys, counts))
        self.size += len(keys)
        if self.size > self.most:
            self.found = [summed(*(np.concatenate(x) for x in zip(*self.found)))]
            self.size = len(self.found[0][0])
            self.most = max(PAIRS, 2 * self.size)

    def full(self) -> bool:
        return self.most > PAIRS

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order and their counts; then nothing is left."""
        out = summed(*(np.concatenate(x) for x in zip(*self.found))) if self.found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.__init__()
        return out


def block(data: np.ndarray, starts: np.ndarray, lo: int) -> np.ndarray:
    """Windows of ``CHUNK_BYTES`` of the data, from lo on."""
    most, hi = max(ORDERS), min(lo + C.CHUNK_BYTES, len(data))
    a = max(0, lo - most)
    near = starts[np.searchsorted(starts, a) : np.searchsorted(starts, hi)]
    return windows(data[a:hi], near - a)[lo - a :]


def log_odds(keys: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Of pairs in order: log-odds of a one at the 8 nodes on the byte's way, in 16ths, as one 64-bit word."""
    out = np.zeros((len(keys), 8), np.int8)
    child = counts.astype(np.float64)
    for j in range(7, -1, -1):
        node = keys >> np.uint64(8 - j)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        both = np.repeat(np.add.reduceat(counts.astype(np.float64), first), np.diff(np.r_[first, len(keys)]))
        x = np.log((child + prior) / (both - child + prior)) * SCALE
        one = (keys >> np.uint64(7 - j)) & np.uint64(1) == 1
        out[:, j] = np.clip(np.rint(np.where(one, x, -x)), -127, 127)
        child = both
    return out.view(np.uint64)[:, 0]


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _reducer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kept(k: int, g: int, sums: Sums) -> Iterator[pa.RecordBatch]:
        keys, counts = sums.take()
        keys, counts = keys[counts > 1], counts[counts > 1] - 1
        if not len(keys):
            return
        at, path = _located(folder)
        name = f"{k}-{g}-{uuid.uuid4().hex}"
        with at.open_output_stream(f"{path}/{name}") as f:
            f.write(keys.astype("<u8").tobytes())
            f.write(log_odds(keys, counts, PRIOR[k]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([g], pa.int64()), pa.array([name])], names=["k", "g", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, Sums()
        for b in batches:
            for k, g, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if now != (k, g):
                    if now is not None:
                        yield from kept(*now, sums)
                    now = (k, g)
                raw = raw.as_buffer()
                n = raw.size // 12
                sums.add(np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64))
        if now is not None:
            yield from kept(*now, sums)

    return C.trimmed(run)


class Table:
    """A predictor's pairs in files by group."""

    def __init__(self, k: int, groups: int, folder: str):
        self.k, self.groups, self.folder, self.names = k, groups, folder, {}
        self._open: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def any(self) -> bool:
        return bool(self.names)

    def part(self, g: int) -> np.ndarray:
        """A group's pairs and their words, as two rows: mapped where the shared folder is mounted, else read and not kept."""
        if g in self._open:
            return self._open[g]
        at, path = _located(f"{self.folder}/{self.names[g]}")
        if isinstance(at, fs.LocalFileSystem):
            self._open[g] = np.memmap(path, np.uint64, "r").reshape(2, -1)
            return self._open[g]
        with at.open_input_file(path) as f:
            return np.frombuffer(f.read(), np.uint64).reshape(2, -1)

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Words of some pairs."""
        keys, back = np.unique(keys, return_inverse=True)
        g = group(keys, self.groups)
        order = np.argsort(g, kind="stable")
        out = np.zeros(len(keys), np.uint64)
        for at in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            if len(at) and int(g[at[0]]) in self.names:
                known, words = self.part(int(g[at[0]]))
                out[at] = found(known, words, keys[at])
        return out[back]


def found(known: np.ndarray, words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Words of pairs in order: a known pair's own, or of one that isn't, what its context has of its way."""
    i = np.searchsorted(known, keys)
    after, before = np.minimum(i, len(known) - 1), np.maximum(i, 1) - 1
    x, y = known[after] ^ keys, known[before] ^ keys
    near = np.where(y < x, before, after)
    x = np.minimum(x, y)
    return np.where(x < 256, words[near] & _SHARED[_WIDTH[x.astype(np.int64) & 255]], np.uint64(0))


def train(docs: DataFrame) -> list[Table]:
    """The tables of the predictors with short contexts, from all documents."""
    texts = docs.select("text").filter("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + int((size / GROUP_BYTES) ** GROWTH)
    folder = C.scratch(docs.sparkSession, "lm")
    at, path = _located(folder)
    at.create_dir(path)
    parts = texts.mapInArrow(_counter(groups), "k int, g long, part binary").repartition("k", "g").sortWithinPartitions("k", "g")
    tables = [Table(k, groups, folder) for k in range(len(ORDERS))]
    for r in parts.mapInArrow(_reducer(folder), "k int, g long, name string").collect():
        tables[r.k].names[r.g] = r.name
    return tables


def beginnings(docs: DataFrame) -> DataFrame:
    """(_sg_text, _sg_known) of texts that begin like others: a text's key, and for its beginnings (``level``) how many other rows have the same, where some do."""
    own = docs.filter("text <> ''").select(C.text_key(F.col("text")).alias("_sg_text"), F.col("text").cast("binary").alias("b"), F.octet_length("text").alias("n"))
    last = f"CAST(CASE WHEN n <= {FIRST} THEN 0 ELSE length(bin((n - 1) DIV {FIRST})) END AS INT)"
    keys = F.expr(f"transform(sequence(0, {last}), j -> xxhash64(substring(b, 1, CAST(least({FIRST} * shiftleft(1L, j), n) AS INT)), j))")
    texts = C.cut(own.select("_sg_text", keys.alias("keys")).groupBy("_sg_text").agg(F.first("keys").alias("keys"), F.count("*").alias("c")))
    each = texts.select("_sg_text", "c", F.posexplode("keys").alias("j", "key"))
    again = each.groupBy("key").agg(F.sum("c").alias("rows")).filter("rows > 1")
    return each.join(again, "key").groupBy("_sg_text").agg(F.collect_list(F.struct("j", (F.col("rows") - 1).alias("others"))).alias("_sg_known"))


def confidence(known: pa.Array) -> np.ndarray:
    """[rows, levels] of log-odds, in 16ths, that a text goes on as others do; 0 where none begin like it."""
    kind = pa.list_(pa.struct([("j", pa.int32()), ("others", pa.int64())]))
    known = known.cast(kind)
    size = pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False)
    flat = known.flatten()
    out = np.zeros((len(known), 40), np.float32)
    x = np.log((flat.field(1).to_numpy(zero_copy_only=False) + PRIOR[-1]) / PRIOR[-1]) * SCALE
    out[np.repeat(np.arange(len(known)), size), flat.field(0).to_numpy(zero_copy_only=False)] = np.minimum(np.rint(x), 127)
    return out


def bits(words: list[np.ndarray], index: np.ndarray, sure: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Total bits of each of some texts, which must come longest first; index: of each byte's words; sure: each text's ``confidence``."""
    lanes, n = len(starts), K
    total = np.zeros(lanes)
    weight = np.empty((n, lanes, 8), np.float32)
    weight[:] = np.array(START, np.float32)[:, None, None] / np.float32(SCALE)
    refine = np.zeros(lanes * 8 * REFINE_CELLS, np.float32)
    cell = (np.arange(lanes * 8, dtype=np.int64) * REFINE_CELLS).reshape(lanes, 8)
    rate, half = np.float32(RATE / SCALE), np.float32(0.5)
    low, high, middle, learn = np.float32(-7.9), np.float32(7.9), np.float32(8.5), np.float32(REFINE_RATE)
    live = lanes
    for t0 in range(0, int(lengths[0]) if lanes else 0, STEPS):
        live = int(np.searchsorted(-lengths[:live], -t0, "left"))  # texts with more than t0 bytes
        steps = min(STEPS, int(lengths[0]) - t0)
        if live < weight.shape[1] // 2 or t0 == 0:
            weight, cell = np.ascontiguousarray(weight[:, :live]), cell[:live]
        w, c = weight[:, :live], cell[:live]
        when = np.arange(t0, t0 + steps)[:, None]
        at = np.minimum(starts[:live] + when, len(data) - 1)
        now, pick = data[at], index[at]
        bit = BITS[now]
        x = np.empty((steps, n, live, 8), np.float32)
        for k in range(n - 1):
            x[:, k] = words[k].take(pick).view(np.int8).reshape(steps, live, 8)
        np.multiply(2 * bit - 1, sure[:live, level(t0)][None, :, None], out=x[:, n - 1])
        logit = np.empty((steps, live, 8), np.float32)
        tmp, mix, p = np.empty((n, live, 8), np.float32), np.empty((live, 8), np.float32), np.empty((live, 8), np.float32)
        where = np.empty((live, 8), np.int64)
        for t in range(steps):
            xt, bt, out = x[t], bit[t], logit[t]
            np.multiply(w, xt, out=tmp)
            np.add.reduce(tmp, axis=0, out=mix)
            # refined
            np.maximum(mix, low, out=p)
            np.minimum(p, high, out=p)
            p += middle
            np.copyto(where, p, casting="unsafe")
            where += c
            r = refine.take(where)
            np.add(mix, r, out=out)
            # p of a one is (1 + tanh(x / 2)) / 2; both the correction and the weights learn from what it misses
            np.multiply(out, half, out=p)
            np.tanh(p, out=p)
            p += 1
            p *= half
            np.subtract(bt, p, out=p)
            np.multiply(p, learn, out=mix)
            r += mix
            refine[where] = r
            p *= rate
            np.multiply(xt, p, out=tmp)
            w += tmp
        logit *= 1 - 2 * bit
        np.minimum(logit, np.float32(60), out=logit)
        np.exp(logit, out=logit)
        logit += 1
        np.log(logit, out=logit)
        cost = logit.sum(-1)
        cost[when >= lengths[:live]] = 0
        total[:live] += cost.sum(0, dtype=np.float64)
    return total / np.log(2)


def score_column(model: list[Table], column: pa.Array, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, total bits) of each row; known: each row's ``_sg_known``."""
    size = np.diff(C.binary_parts(column)[1])
    sure = confidence(known) if known is not None else np.zeros((len(size), 40), np.float32)
    order = np.argsort(-size, kind="stable")
    order = order[: int(np.count_nonzero(size))]
    out = np.zeros(len(size))
    upto, at = np.cumsum(size[order]), 0
    while at < len(order):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GROUP, "right"))
        pick = order[at : min(max(end, at + 1), at + LANES)]
        at += len(pick)
        data, offsets, _ = C.binary_parts(column.take(pa.array(pick)))
        each = [pa.array(block(data, offsets[:-1], lo)).dictionary_encode() for lo in range(0, len(data), C.CHUNK_BYTES)]
        each = pa.chunked_array(each).unify_dictionaries().chunks
        seen = each[-1].dictionary.to_numpy()
        words = [t.words(pairs(seen, t.k)) for t in model]
        index = np.concatenate([e.indices.to_numpy() for e in each])
        del each, seen
        out[pick] = bits(words, index, sure[pick], data, offsets[:-1], size[pick])
    return size, out


def _scorer(model: list[Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, total = score_column(model, b.column(1), b.column(2))
            each = pa.array(total / np.maximum(size, 1), mask=size == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(total), each], names=["doc_id", "n_bytes", "total_bits", "bits_per_byte"])

    return C.trimmed(run)


def score(docs: DataFrame, tables: list[Table] | None = None) -> DataFrame:
    """(doc_id, n_bytes, total_bits, bits_per_byte) for every row, by a model of ``docs`` or given tables (to which all beginnings are new)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("total_bits", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    C.batches(docs.sparkSession, 10_000, 64 << 20)  # many texts in step are what makes scoring fast
    if tables is None:
        tables = train(docs)
        known = C.cut(beginnings(docs))
        if known.count() * 256 <= C.BROADCAST_BYTES:
            known = F.broadcast(known)
        rows = docs.select("doc_id", "text", C.text_key(F.col("text")).alias("_sg_text")).join(known, "_sg_text", "left").select("doc_id", "text", "_sg_known")
    else:
        rows = docs.select("doc_id", "text", F.lit(None).cast("array<struct<j:int,others:bigint>>").alias("_sg_known"))
    return rows.mapInArrow(_scorer(tables), schema)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"))
