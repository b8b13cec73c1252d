"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` normalised characters has an error budget of ``k = m // ERROR_EVERY`` edits. It is cut into
``k + 1`` pieces; a passage within ``k`` edits of the item holds at least one piece unchanged, so exact piece hits (one
Aho-Corasick pass over each whole text) miss nothing. Around each hit the item's window is verified with Myers'
bit-parallel distance (J. ACM 1999), in its form for the best match that ends anywhere.

Normalised: lower case, runs of anything but letters and digits become one space.

The items' size is measured before they are sent to the executors; past ``common.BROADCAST_BYTES`` they are dealt out
by hash to parts below that size, with one pass over the documents for each part, so results are the same.

Defined results: null or wordless items match nothing; null or wordless texts match nothing; an item of fewer than
``SHORT`` characters is matched with the spaces around it, so that it is found anywhere but as whole words only (``cat``
isn't in ``concatenate``); items that are equal after normalising are each reported; repeated document
rows give repeated results; null ids are reported as null; empty tables give no matches; columns other than
``doc_id`` and ``text`` pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.llm import common as C

ERROR_EVERY, SHORT = 15, 25
_WORDS = re.compile(r"[^\W_]+")
_built: dict[int, tuple] = {}


def normalise(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def budget(m: int) -> int:
    return m // ERROR_EVERY


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 stretches that cover 0..m, of lengths that differ by one at most."""
    return [(m * j // (k + 1), m * (j + 1) // (k + 1)) for j in range(k + 1)]


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def myers(bits: dict[str, int], m: int, text: str) -> int:
    """Least edits between a pattern and any substring of ``text``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    get = bits.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


class Matcher:
    """Finds items, given as (ids, normalised text), in normalised texts."""

    def __init__(self, items: list[tuple[list, str]]):
        framed = [(ids, f" {t} " if len(t) < SHORT else t, budget(len(t))) for ids, t in items]
        self.items = [(ids, t, k, pattern_bits(t)) for ids, t, k in framed]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t, k, _) in enumerate(self.items):
            for a, b in pieces(len(t), k):
                where.setdefault(t[a:b], []).append((i, b))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, at)
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item, least edits) of all items within budget."""
        if not text or not self.any:
            return []
        out, text = [], f" {text} "
        starts: dict[int, set[int]] = {}
        for end, at in self.automaton.iter(text):
            for i, b in at:
                starts.setdefault(i, set()).add(end + 1 - b)
        for i, at in starts.items():
            _, t, k, bits = self.items[i]
            if t in text:
                out.append((i, 0))
                continue
            best, lo, hi = k + 1, None, 0
            m = len(t)
            for s in [*sorted(at), None]:
                if lo is not None and (s is None or s - k > hi):
                    best = min(best, myers(bits, m, text[max(0, lo) : hi]))
                    lo = None
                if s is not None:
                    lo, hi = (s - k if lo is None else lo), s + m + k
            if best <= k:
                out.append((i, best))
        return out


def _matcher(token: int, items: list) -> Matcher:
    if token not in _built:
        _built.clear()
        _built[token] = Matcher(items)
    return _built[token]


def parts(benchmark: DataFrame) -> list:
    """Broadcasts of (ids, normalised text) lists, each of bounded size."""
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = -(-int(size) // (C.BROADCAST_BYTES // 8))  # an automaton takes several times its pieces
    out = []
    for p in range(n):
        by: dict[str, list] = {}
        for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == p).collect():
            if t := normalise(r.text):
                by.setdefault(t, []).append(r.item_id)
        if by:
            out.append(benchmark.sparkSession.sparkContext.broadcast([(by[t], t) for t in sorted(by)]))
    return out


def _finder(items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(items.id, items.value)
        for b in batches:
            ids, edits, row = [], [], []
            for j, text in enumerate(b.column(1)):
                for i, d in m.find(normalise(text.as_py())):
                    for item in m.items[i][0]:
                        row.append(j)
                        ids.append(item)
                        edits.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(ids, items.kind), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "edits"])

    return run


def _filter(items, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(items.id, items.value)
        for b in batches:
            yield b.filter(pa.array([not m.find(normalise(text.as_py())) for text in b.column(at)], pa.bool_()))

    return run


class _Part:
    """A broadcast with the Arrow type of its ids."""

    def __init__(self, broadcast, kind: pa.DataType):
        self.broadcast, self.id, self.kind = broadcast, broadcast._jbroadcast.id(), kind

    def __reduce__(self):
        return _part, (self.broadcast, self.id, self.kind)

    @property
    def value(self):
        return self.broadcast.value


def _part(broadcast, token: int, kind: pa.DataType) -> _Part:
    p = object.__new__(_Part)
    p.broadcast, p.id, p.kind = broadcast, token, kind
    return p


def _all_parts(benchmark: DataFrame) -> list[_Part]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    return [_Part(b, kind) for b in parts(benchmark)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits) for every document row and item within its budget; edits: the least over all passages."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("edits", T.IntegerType())])
    out = docs.sparkSession.createDataFrame([], schema)
    found = [docs.select("doc_id", "text").mapInArrow(C.trimmed(_finder(p)), schema) for p in _all_parts(benchmark)]
    for f in found[1:]:
        found[0] = found[0].unionByName(f)
    return found[0] if found else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without rows that hold an item."""
    for p in _all_parts(benchmark):
        docs = docs.mapInArrow(C.trimmed(_filter(p, docs.columns.index("text"))), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
