import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from srcgraph.llm import tokens as K


def plain_encode(ids):
    """One block, greedily, one word at a time."""
    out, at = [], 0
    while at < len(ids):
        for s in range(16):
            part = ids[at : at + int(K.COUNTS[s])]
            if s == K.ESCAPE or all(int(x).bit_length() <= K.WIDTHS[s] for x in part):
                break
        if s == K.ESCAPE:
            out += [s << 60, int(part[0])]
            at += 1
        else:
            out.append(s << 60 | sum(int(x) << (int(K.WIDTHS[s]) * j) for j, x in enumerate(part)))
            at += len(part)
    return out


ids = st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 300), st.integers(0, 60000), st.integers(0, 2**64 - 1), st.sampled_from([2**30 - 1, 2**30, 2**52, 2**53 - 1, 2**60, 2**64 - 1, 15 << 60]))


@given(st.lists(st.lists(ids, max_size=60), max_size=6), st.sampled_from([1, 3, 16, 1024]))
@settings(max_examples=150, deadline=None)
def test_round_trip_and_greedy_words(rows, block):
    flat = np.array([x for r in rows for x in r], np.uint64)
    words, row_word, block_word, row_block = K.encode(flat, np.array([len(r) for r in rows], np.int64), block)
    for i, r in enumerate(rows):
        mine = words[row_word[i] : row_word[i + 1]]
        starts = block_word[row_block[i] : row_block[i + 1]]
        assert [int(w) for w in mine] == [w for at in range(0, len(r), block) for w in plain_encode(r[at : at + block])]
        assert K.decode(mine, len(r), starts, block).tolist() == r


def test_long_runs():
    r = [0] * 5000 + [7] * 3000 + [2**40] * 5 + list(range(4000))
    words, row_word, block_word, _ = K.encode(np.array(r, np.uint64), np.array([len(r)]))
    assert K.decode(words, len(r), block_word).tolist() == r


def test_round_trip_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coded = K.token_ids(docs)
    enc = K.encoder(K.VOCABULARY)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = K.read_token_ids(coded).collect()
    assert len(got) == len(text)
    for r in got:
        assert enc.decode(r.ids) == text[r.doc_id]
    size = coded.selectExpr("sum(length(words)) AS b", "sum(n_tokens) AS n").first()
    assert size.b < 4 * size.n


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "a"), (2, "", 2, "b"), (None, "x", 3, "c"), (4, "<|endoftext|>", 4, "d"), (4, "<|endoftext|>", 4, "d"), (5, "é word " * 20000, 5, "e")]])
def test_hard_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, words string")
    coded = K.token_ids(df)
    assert coded.columns == ["doc_id", "n_tokens", "block_words", "words"]
    got = K.read_token_ids(coded).collect()
    enc = K.encoder(K.VOCABULARY)
    assert [(r.doc_id, enc.decode(r.ids)) for r in got] == [(d, t or "") for d, t, *_ in rows]
    for r in coded.collect():
        assert len(r.block_words) == -(-r.n_tokens // K.BLOCK)
