"""Token-ID output with Simple-8b word-aligned coding.

Each document's ids (a public byte-level BPE vocabulary; its file is a parameter) are cut into blocks of ``BLOCK`` ids. A
64-bit word holds a selector in its upper 4 bits and ids in the other 60: ``COUNTS[s]`` ids of ``WIDTHS[s]`` bits. Selector 15
is the escape: the next word holds one id whole, so any unsigned 64-bit id can be coded. Every block begins with a
fresh word, and the row keeps each block's first word and the number of ids, so all blocks decode side by side.

Encoding is greedy (each word takes as many ids as fit) and vectorised: the best selector of every position is found
at once from the distance to the next id that is too wide, then all blocks' chains of words are followed in step.

Defined results: a null or empty text has no ids, no words and no blocks; special-token strings in a text are ordinary
text; repeated rows are each coded; a null ``doc_id`` stays null; empty tables give empty results; columns besides
``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from srcgraph.llm import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024
#: Ids a word, and bits an id, by selector; 15 is the escape.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64], np.int64)
ESCAPE = 15
_encoders: dict[str, object] = {}


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of uint64 values."""
    out = np.zeros(len(x), np.uint8)
    big = (x >> np.uint64(52)).astype(bool)
    low = x.astype(np.float64)
    out[:] = np.frexp(low)[1]
    if big.any():  # past 52 bits a float may round up
        v = x[big]
        n = np.zeros(len(v), np.uint8)
        for s in (32, 16, 8, 4, 2, 1):
            up = v >> np.uint64(s)
            n[up > 0] += s
            v = np.where(up > 0, up, v)
        out[big] = n + 1
    return out


def _fit(bits: np.ndarray, first: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For every position the selector that takes most ids; past a block's end anything fits."""
    n = len(bits)
    left = first[block + 1] - np.arange(n)
    sel = np.full(n, ESCAPE, np.uint8)
    widest = int(bits.max(initial=0))
    for s in range(ESCAPE - 1, -1, -1):
        width, count = int(WIDTHS[s]), int(COUNTS[s])
        if widest <= width:
            sel[:] = s
            continue
        bad = np.flatnonzero(bits > width)
        gap = np.full(n, n, np.int32)  # distance to the next id that is too wide
        edge = np.concatenate(([-1], bad))
        gap = np.repeat(bad, np.diff(edge)) - np.arange(edge[-1] + 1)
        ok = np.ones(n, bool)
        ok[: len(gap)] = gap >= np.minimum(count, left[: len(gap)])
        sel[ok] = s
    return sel


def encode(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of several rows -> (words, first word of each row and the end, first word of each block within its row, first block of each row and the end)."""
    ids = ids.astype(np.uint64)
    n, rows = len(ids), len(lengths)
    blocks = -(-lengths // block)
    row_block = np.concatenate(([0], np.cumsum(blocks)))
    nb = int(row_block[-1])
    row_first = np.concatenate(([0], np.cumsum(lengths)))
    owner = np.repeat(np.arange(rows), blocks)
    first = np.empty(nb + 1, np.int64)
    first[:nb] = row_first[owner] + (np.arange(nb) - row_block[owner]) * block
    first[nb] = n
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64), row_block
    of = np.repeat(np.arange(nb), np.diff(first))
    sel = _fit(bit_length(ids), first, of)
    step = COUNTS[sel]
    # follow the chains of all blocks in step
    starts, at, end = [], first[:-1].copy(), first[1:]
    live = np.arange(nb)
    while len(live):
        starts.append(at)
        at = at + step[at]
        go = at < end[live]
        at, live = at[go], live[go]
    start = np.sort(np.concatenate(starts))
    s = sel[start].astype(np.int64)
    width = np.where(s == ESCAPE, 2, 1)
    where = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[where] = s.astype(np.uint64) << np.uint64(60)
    stop = np.minimum(start + COUNTS[s], end[of[start]])
    for k in np.unique(s):
        pick = np.flatnonzero(s == k)
        if k == ESCAPE:
            words[where[pick] + 1] = ids[start[pick]]
        elif WIDTHS[k]:
            w = words[where[pick]]
            for j in range(int(COUNTS[k])):
                p = start[pick] + j
                inside = p < stop[pick]
                w |= np.where(inside, ids[np.minimum(p, n - 1)], np.uint64(0)) << np.uint64(int(WIDTHS[k]) * j)
            words[where[pick]] = w
    begin = np.searchsorted(start, first[:-1])
    block_word = where[begin] if nb else np.zeros(0, np.int64)
    ends = np.concatenate((block_word, [len(words)]))
    row_word = ends[row_block]
    return words, row_word, block_word - row_word[:-1][owner], row_block


def decode(words: np.ndarray, n: int, block_words: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The n ids of one row, all blocks at once."""
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    payload = np.zeros(len(words), bool)
    # a word after an escape is payload; the chain can't be read off selectors alone, so walk runs of escapes
    esc = sel == ESCAPE
    if esc.any():
        i = 0
        at = np.flatnonzero(esc)
        while i < len(at):
            payload[at[i] + 1] = True
            i += 2 if i + 1 < len(at) and at[i + 1] == at[i] + 1 else 1
    head = np.flatnonzero(~payload)
    s = sel[head]
    owner = np.searchsorted(block_words, head, "right") - 1
    count = COUNTS[s]
    total = np.concatenate(([0], np.cumsum(count)))
    begin = total[:-1] - total[np.searchsorted(head, block_words)][owner] + owner * block
    stop = np.minimum(begin + count, np.minimum((owner + 1) * block, n))
    for k in np.unique(s):
        pick = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[begin[pick]] = words[head[pick] + 1]
        elif WIDTHS[k]:
            mask = np.uint64((1 << int(WIDTHS[k])) - 1)
            for j in range(int(COUNTS[k])):
                p = begin[pick] + j
                ok = p < stop[pick]
                out[p[ok]] = (words[head[pick[ok]]] >> np.uint64(int(WIDTHS[k]) * j)) & mask
    return out


def encoder(vocabulary: str):
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _write(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = encoder(vocabulary).encode_ordinary
        for b in batches:
            for lo, hi, *_ in C.chunks(b.column(1)):
                ids = [tokenize(t) if t else [] for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                lengths = np.array([len(x) for x in ids], np.int64)
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
                words, row_word, block_word, row_block = encode(flat, lengths)
                raw = words.astype("<u8").view(np.uint8)
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((row_word * 8).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                offsets = pa.ListArray.from_arrays(pa.array(row_block.astype(np.int32)), pa.array(block_word.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lengths), offsets, binary], names=["doc_id", "n_tokens", "block_words", "words"])

    return run


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, block_words: first word of each block, words: little-endian 64-bit words) for every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("block_words", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(C.trimmed(_write(os.path.realpath(vocabulary))), schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [decode(np.frombuffer(r["words"], "<u8").astype(np.uint64), r["n_tokens"], np.array(r["block_words"], np.int64)).astype(np.int64) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_token_ids(coded: DataFrame) -> DataFrame:
    """(doc_id, ids) of what ``token_ids`` made."""
    schema = T.StructType([T.StructField("doc_id", coded.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.LongType()))])
    return coded.select("doc_id", "n_tokens", "block_words", "words").mapInArrow(_read, schema)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(C.table(spark, sf_dir, "documents"))
