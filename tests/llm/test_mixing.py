import hashlib
import math
import re
from collections import defaultdict

import duckdb
import pytest
from srcgraph.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, n_chars long, shard string, block int"


def brute(rows, weights=None, share=M.SHARE, block=M.BLOCK_TOKENS, shard_tokens=M.SHARD_TOKENS):
    """Seat by seat."""
    docs = []
    for d, t, s in rows:
        n = len(re.findall(r"[^ \t\n\r\f]+", t or ""))
        if n:
            h = hashlib.md5(f"{M.SEED}|{'' if d is None else d}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
            docs.append((s or "", h, n, d))
    k = max(1, math.ceil(sum(x[2] for x in docs) / shard_tokens))
    tokens, streams = defaultdict(int), defaultdict(list)
    for s, h, n, d in sorted(docs):
        tokens[s] += n
        streams[s, int(h[:8], 16) % k].append((d, n))
    w = {s: math.sqrt(n) for s, n in tokens.items()} if weights is None else weights
    cap = {x: math.ceil(sum(n for _, n in ds) / block) for x, ds in streams.items()}
    out = []
    for shard in {x[1] for x in streams}:
        seats = math.floor(sum(c for x, c in cap.items() if x[1] == shard) * share)
        got = defaultdict(int)
        for _ in range(seats):
            open_ = [x for x in cap if x[1] == shard and got[x] < cap[x] and w.get(x[0], 0) > 0]
            if not open_:
                break
            got[min(open_, key=lambda x: (-w[x[0]] / (2 * got[x] + 1), x[0]))] += 1
        for x, q in got.items():
            at = 0
            for d, n in streams[x]:
                for b in range(at // block, (at + n - 1) // block + 1):
                    if b < q:
                        lo, hi = max(at, b * block), min(at + n, (b + 1) * block)
                        out.append((d, x[0], shard, b, lo - at, hi - lo))
                at += n
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "x", 2) for d, t, s in rows], SCHEMA)


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "": 1.0}, {"a": 1.0, "b": 1.0, "c": 0.0}])
def test_matches_seat_by_seat(spark, weights):
    rows = [(i, "w " * (i * 37 % 91), "abc"[i % 7 % 3]) for i in range(150)] + [(200, None, "a"), (201, "", "a"), (202, " \n", "b"), (None, "x y", None), (5, "p q r", "a"), (5, "p q r", "a"), (300, "long " * 3000, "c"), (301, "z", "zz")]
    m = M.Mix(frame(spark, rows), weights, 0.6, block=64, shard_tokens=1500)
    assert m.shards > 2
    want = brute(rows, weights, 0.6, 64, 1500)
    assert sorted((tuple(r) for r in m.pieces().collect()), key=str) == want
    kept = m.keep(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, *_, f, _ in want if f == 0), key=str)


@pytest.mark.parametrize("ids", ["null", "one", "same rows"])
def test_as_many_are_kept_as_have_seats(spark, ids):
    rows = [(None if ids == "null" else 7, "w " * (10 if ids == "same rows" else 3 + i % 20), "a") for i in range(120)] + [(i, "v " * 11, "b") for i in range(40)]
    m = M.Mix(frame(spark, rows), None, 0.5, block=64)
    pieces = [tuple(r) for r in m.pieces().collect()]
    assert sorted(pieces, key=str) == brute(rows, None, 0.5, 64)
    want = sum(r[4] == 0 for r in pieces)
    kept = m.keep(frame(spark, rows).repartition(5)).collect()
    assert len(kept) == want < len(rows)
    assert sum(r.source == "a" for r in kept) == sum(r[4] == 0 and r[1] == "a" for r in pieces)


def test_target_is_met(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = M.Mix(docs, {"src1": 2.0, "src2": 1.0, "src3": 1.0}, 0.05, block=64)
    n = {r.source: r.n for r in m.pieces().groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert set(n) == {"src1", "src2", "src3"}
    assert abs(n["src1"] / sum(n.values()) - 0.5) < 0.1


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'" if __import__("os").path.isdir(f"{sf}/documents.parquet") else f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = M.op10_mixing(spark, sf)
    assert sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({M.OP10_SQL})").fetchall()) == sorted(tuple(r) for r in got.collect())


def test_empty(spark):
    m = M.Mix(frame(spark, []))
    assert m.pieces().count() == 0 and m.keep(frame(spark, [])).count() == 0
