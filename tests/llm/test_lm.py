import math

import numpy as np
from srcgraph.llm import lm as L

SCHEMA = "doc_id long, text string, n_bytes string, total_bits long"


def brute(texts, scored):
    """Counts and scores one bit at a time."""
    pairs = [{} for _ in L.ORDERS]
    for t in texts:
        past = [0] * 5
        for b in t:
            for k, n in enumerate(L.ORDERS):
                c = bytes(past[-n:])
                pairs[k][c, b] = pairs[k].get((c, b), 0) + 1
            past.append(b)
    nodes = [{} for _ in L.ORDERS]
    for k in range(len(L.ORDERS)):
        for (c, b), n in pairs[k].items():
            for j in range(8):
                nodes[k].setdefault((c, j, b >> (8 - j)), [0, 0])[b >> (7 - j) & 1] += n - 1
    ends = {t: [*(n for n in (L.FIRST << j for j in range(30)) if n < len(t)), len(t)] for t in texts if t}
    begin = {}
    for t in texts:
        for j, n in enumerate(ends.get(t, ())):
            begin[j, t[:n]] = begin.get((j, t[:n]), 0) + 1
    odds = lambda n1, n0, prior: max(-127, min(127, round(math.log((n1 + prior) / (n0 + prior)) * L.SCALE)))
    out = []
    for t in scored:
        w = [[a / L.SCALE for a in L.START] for _ in range(8)]
        refine, cost, past = {}, 0.0, [0] * 5
        for at, b in enumerate(t):
            level = next(j for j, n in enumerate(ends[t]) if at < n)
            others = begin[level, t[: ends[t][level]]] - 1
            for j in range(8):
                bit = b >> (7 - j) & 1
                x = []
                for k, n in enumerate(L.ORDERS):
                    n0, n1 = nodes[k].get((bytes(past[-n:]), j, b >> (8 - j)), (0, 0))
                    x.append(odds(n1, n0, L.PRIOR[k]))
                x.append(odds(others, 0, L.PRIOR[-1]) * (2 * bit - 1))
                mix = sum(a * c for a, c in zip(w[j], x))
                cell = j, int(max(-7.9, min(7.9, mix)) + 8.5)
                r = refine.get(cell, 0.0)
                p = 1 / (1 + math.exp(-mix - r))
                cost -= math.log2(p if bit else 1 - p)
                refine[cell] = r + L.REFINE_RATE * (bit - p)
                w[j] = [a + L.RATE / L.SCALE * (bit - p) * c for a, c in zip(w[j], x)]
            past.append(b)
        out.append(cost)
    return out


def test_matches_brute_force(spark, sf):
    """Whole texts, of very different lengths, and more of them than are scored in step."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    longest = [r.doc_id for r in docs.orderBy(docs.n_chars.desc()).limit(3).collect()]
    some = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id % 12 == 0 or r.doc_id in longest[1:])
    rows = some + [(90000, "é" * 150), (90001, "a"), (90002, some[1][1]), (90003, some[2][1] + " and more"), (90004, some[3][1][: len(some[3][1]) // 2])] + [(100000 + i, f"{i} of many") for i in range(2100)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).coalesce(1)
    got = {r.doc_id: r for r in L.score(df).collect()}
    want = brute([t.encode() for _, t in rows], [t.encode() for _, t in rows])
    assert max(len(t) for _, t in rows) > 3000 and len(rows) > L.LANES
    for (d, t), c in zip(rows, want):
        assert got[d].n_bytes == len(t.encode())
        assert math.isclose(got[d].total_bits, c, rel_tol=2e-3, abs_tol=0.5)
        assert math.isclose(got[d].bits_per_byte, got[d].total_bits / got[d].n_bytes)


def test_scores_do_not_depend_on_company(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.train(docs)
    rows = docs.orderBy("doc_id").limit(50).toArrow().column("text").combine_chunks()
    size, together = L.score_column(model, rows)
    for i in (0, 7, 33):
        assert np.allclose(L.score_column(model, rows.slice(i, 1))[1], together[i], rtol=1e-4)
    assert all(t.any() for t in model)


def test_a_text_that_occurs_twice_costs_less(spark):
    """Planted second copies among texts that occur once, some of which have near copies: they cost less than nine tenths of the others do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 400").dropDuplicates(["text"]).select("doc_id", "text", "lang")
    half = docs.filter("doc_id % 10 = 3")
    both = docs.unionByName(half.selectExpr("doc_id + 1000000 AS doc_id", "text", "lang"))
    bits = {r.doc_id: r.bits_per_byte for r in L.score(both).collect()}
    twice = {r.doc_id for r in half.collect()}
    once = sorted(b for d, b in bits.items() if d < 1000000 and d not in twice)
    assert np.mean([bits[d] < once[len(once) // 10] for d in twice]) > 0.9
    assert np.median([bits[d] for d in twice]) < 0.8 * np.median(once)


def test_held_out_text_beats_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tables = L.train(docs.filter("doc_id % 2 = 0"))
    held = L.score(docs.filter("doc_id % 2 = 1 AND n_chars > 500"), tables).agg({"bits_per_byte": "avg"}).first()[0]
    rng = np.random.default_rng(0)
    noise = spark.createDataFrame([(i, bytes(rng.integers(33, 127, 2000).astype(np.uint8)).decode(), "x", 1) for i in range(5)], SCHEMA)
    assert held < 3 < 6 < L.score(noise, tables).agg({"bits_per_byte": "min"}).first()[0]


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (None, "abc"), (4, "abc"), (4, "abc"), (5, "long text " * 20000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = {(r.doc_id, r.n_bytes): r for r in L.score(df).collect()}
    assert L.score(df).count() == 6 and set(got) == {(1, 0), (2, 0), (None, 3), (4, 3), (5, 200000)}
    assert got[1, 0].total_bits == 0 and got[1, 0].bits_per_byte is None
    assert got[5, 200000].bits_per_byte < 0.1
    assert L.score(df.limit(0)).count() == 0


def test_model_grows_with_the_corpus(spark):
    """Every pair that occurs again is in the model: counts of 3 and 5 bytes are those of a dictionary, less one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [b"\0" * 5 + r.text.encode() for r in docs.filter("text IS NOT NULL").collect()]
    tables = L.train(docs)
    for k in (1, 2):
        n, counts = L.ORDERS[k], {}
        for t in texts:
            for i in range(5, len(t)):
                c = counts.setdefault(t[i - n : i], {})
                c[t[i]] = c.get(t[i], 0) + 1
        parts = [tables[k].part(g) for g in tables[k].names]
        assert sum(p.shape[1] for p in parts) == sum(v > 1 for c in counts.values() for v in c.values())
        for context in [b"\0" * n, *list(counts)[:: len(counts) // 50]]:
            for b in (*list(counts.get(context, {}))[:3], 1, 200):
                want = []
                for j in range(8):
                    at = [(v - 1, o >> (7 - j) & 1) for o, v in counts.get(context, {}).items() if o >> (8 - j) == b >> (8 - j)]
                    n0, n1 = (sum(v for v, x in at if x == y) for y in (0, 1))
                    want.append(max(-127, min(127, round(math.log((n1 + L.PRIOR[k]) / (n0 + L.PRIOR[k])) * L.SCALE))))
                window = np.array([int.from_bytes(context.rjust(5, b"\0") + bytes([b]))], np.uint64)
                assert tables[k].words(L.pairs(window, k)).view(np.int8).tolist() == want
