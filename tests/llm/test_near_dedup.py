import random
import re
from collections import defaultdict

import numpy as np
from srcgraph.llm import near_dedup as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, k string, bands string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, "x", "y", "z") for r in rows], SCHEMA)


def word_set(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + N.SHINGLE]) for i in range(max(1, len(w) - N.SHINGLE + 1))} if w else set()


def brute(rows):
    """Groups by every pair's exact similarity."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [word_set(t) if t is not None else None for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if None in (rows[i][0], rows[j][0]) or sets[i] is None or sets[j] is None:
                continue
            a, b = sets[i], sets[j]
            if rows[i][1] == rows[j][1] or (a and b and len(a & b) >= N.THRESHOLD * len(a | b)):
                parent[top(i)] = top(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[top(i)].append(d)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def classes(df):
    out = defaultdict(list)
    for r in N.near_duplicates(df).collect():
        out[r.class_id].append(r.doc_id)
        assert r.n_links > 0
    assert all(c == min(ids) for c, ids in out.items())
    return sorted(sorted(ids) for ids in out.values())


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = classes(docs)
    pairs = lambda groups: {(a, b) for g in groups for a in g for b in g if a < b}
    assert pairs(got) <= pairs(want)
    assert len(pairs(got)) >= 0.9 * len(pairs(want))
    assert N.drop_near_duplicates(docs).count() == len(rows) - sum(len(g) - 1 for g in got)


def test_planted(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    base = [rng.choices(words, k=120) for _ in range(40)]
    rows, want = [], []
    for i, b in enumerate(base):
        near = list(b)
        for at in rng.sample(range(120), 6):
            near[at] = rng.choice(words)
        rows += [(10 * i, " ".join(b)), (10 * i + 1, " ".join(b)), (10 * i + 2, " ".join(near)), (10 * i + 3, " ".join(rng.choices(words, k=120)))]
        want.append([10 * i, 10 * i + 1, 10 * i + 2])
    assert classes(frame(spark, rows)) == want


def test_hard_rows(spark):
    long = "word%d " * 30000 % tuple(range(30000))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "?!"), (6, "Hi there"), (7, "hi, there!"), (8, "hi"), (9, long), (10, long + " end"), (None, "Hi there"), (11, "a b c d e f"), (11, "a b c d e f"), (12, "x y z q w")]
    df = frame(spark, rows)
    got = classes(df)
    assert got == [[3, 4], [6, 7], [9, 10], [11, 11]]
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 1, 2, 3, 5, 6, 8, 9, 11, 12]


def test_empty(spark):
    df = frame(spark, [])
    assert N.near_duplicates(df).count() == 0
    assert N.drop_near_duplicates(df).count() == 0


def test_chain_is_one_group(spark):
    """Neighbours are similar, ends aren't: one component."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[20 * i : 20 * i + 100])) for i in range(8)]
    assert classes(frame(spark, rows)) == brute(rows) == [list(range(8))]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    one = rng.integers(0, 2**63, 1).astype(np.uint64)
    h, row = np.concatenate([a, b, one]), np.repeat([0, 1, 2], [300, 300, 1])
    s = N.sketch(h, row, 4)
    assert (s[:3] != N._EMPTY).all() and (s[3] == N._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.13


def test_sketch_does_not_depend_on_its_batch():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 90).astype(np.uint64)
    both = N.sketch(h.copy(), np.repeat([0, 1], [20, 70]), 2)
    assert (both[1] == N.sketch(h[20:].copy(), np.zeros(70, int), 1)[0]).all()


def shared_passage(n, words=100, own=120):
    """n documents that share a passage (similarity about 0.28) and have nothing else in common, and n // 50 near copies."""
    rng = random.Random(n)
    passage = [f"p{i}" for i in range(words)]
    rows = [(i, [*passage, *(f"d{i}x{j}" for j in range(own))]) for i in range(n)]
    for i in range(n // 50):
        t = list(rows[7 * i][1])
        for at in rng.sample(range(len(t)), 6):
            t[at] = f"e{i}x{at}"
        rows.append((n + i, t))
    return [(i, " ".join(t)) for i, t in rows], [[7 * i, n + i] for i in range(n // 50)]


def test_a_passage_that_many_share_costs_no_pairs(spark):
    """Pairs that are verified grow with the documents, not with their square, and no link is lost."""
    pairs = {}
    for n in (250, 500, 1000):
        rows, want = shared_passage(n)
        df = frame(spark, rows)
        c = N.Classes(df)
        pairs[n] = c.pairs.count() + c.first.count()
        found = {tuple(sorted((x.a, x.b))) for x in c.links.collect()}
        ids = {r.node: r._sg_id for r in c.nodes.collect()}
        assert sorted(sorted((ids[a], ids[b])) for a, b in found) == want
    print(pairs)
    assert pairs[1000] < 4.6 * pairs[250] and pairs[1000] < 20 * 1000


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(9)
    sets = []
    for i in range(160):
        base = sets[rng.randrange(len(sets))][1] if sets and rng.random() < 0.7 else []
        kept = [x for x in base if rng.random() < rng.choice([0.5, 0.7, 0.9])]
        sets.append((i, sorted({*kept, *rng.sample(range(60 if i % 3 else 5000), rng.randint(1, 30))})))
    df = spark.createDataFrame(sets, "node long, shingles array<long>")
    nodes = df.selectExpr("node", "node % 40 AS comp")
    want = {(a, b) for a, x in sets for b, y in sets if a < b and a % 40 != b % 40 and len({*x} & {*y}) >= N.THRESHOLD * len({*x} | {*y})}
    got = {(r.a, r.b) for r in N.prefix_pairs(nodes, df).collect()}
    assert len(want) > 30 and want <= got and len(got) < 160 * 159 / 2
