import random

import pytest
from srcgraph.llm import decontaminate as D


def distance(pattern, text):
    """Least edits to any substring, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edit(rng, text, n):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[at] = rng.choice("abcdefgh")
        elif kind == 1:
            del t[at]
        else:
            t.insert(at, rng.choice("abcdefgh"))
    return "".join(t)


@pytest.mark.parametrize("seed", range(20))
def test_myers_is_the_edit_distance(seed):
    rng = random.Random(seed)
    p, t = ("".join(rng.choices("abc ", k=n)) for n in (rng.randint(1, 90), rng.randint(0, 150)))
    assert D.myers(D.pattern_bits(p), len(p), t) == distance(p, t)


def make(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "en", i, "z") for i, t in docs], "doc_id long, text string, lang string, item_id long, edits string"),
        spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"),
    )


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(rng.randint(6, 40) if i % 5 else rng.randint(2, 5))) for i in range(25)]
    docs = []
    for d in range(60):
        t = say(rng.randint(0, 60))
        if d % 2:
            item = items[rng.randrange(25)][1]
            t += " " + edit(rng, item, rng.randint(0, D.budget(len(item)) + 2)) + " " + say(rng.randint(0, 30))
        docs.append((d, t))
    df, bench = make(spark, docs, items)
    want = set()
    for d, t in docs:
        for i, x in items:
            x, n = D.normalise(x), D.normalise(t)
            x, n, k = (x, n, D.budget(len(x))) if len(x) >= D.SHORT else (f" {x} ", f" {n} ", D.budget(len(x)))
            if (e := distance(x, n)) <= k:
                want.add((d, i, e))
    got = [tuple(r) for r in D.find_leaks(df, bench).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_hard_rows(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank, twice a day."
    docs = [(1, None), (2, ""), (3, "..."), (4, item), (4, item), (5, "x " * 50000 + item.upper().replace(" ", "!! ")), (None, item), (6, "short one"), (7, "a short one here"), (8, "a short oneness")]
    df, bench = make(spark, docs, [(1, item), (2, item), (3, None), (4, ""), (5, "Short one"), (None, item + item)])
    got = sorted((r.doc_id or 0, r.item_id) for r in D.find_leaks(df, bench).collect())
    assert got == [(0, 1), (0, 2), (4, 1), (4, 1), (4, 2), (4, 2), (5, 1), (5, 2), (6, 5), (7, 5)]
    assert sorted(r.doc_id for r in D.drop_leaks(df, bench).collect()) == [1, 2, 3, 8]


def test_short_items_are_found_within_longer_texts_as_whole_words(spark):
    docs = [(1, "They said: the answer is forty-two, no less."), (2, "the answer is forty twos"), (3, "The answer is fourty two!"), (4, "the cat sat"), (5, "concatenate"), (6, "cat")]
    df, bench = make(spark, docs, [(1, "The answer is forty two"), (2, "cat")])
    assert sorted(map(tuple, D.find_leaks(df, bench).collect())) == [(1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 2, 0), (6, 2, 0)]


def test_empty(spark):
    df, bench = make(spark, [], [])
    assert D.find_leaks(df, bench).count() == 0 and D.drop_leaks(df, bench).count() == 0
    df, bench = make(spark, [(1, "a b")], [])
    assert D.find_leaks(df, bench).count() == 0 and D.drop_leaks(df, bench).count() == 1
    df, bench = make(spark, [], [(1, "a b")])
    assert D.find_leaks(df, bench).count() == 0


def test_many_parts_give_the_same(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(D.C, "BROADCAST_BYTES", 8 * 4000)
    assert len(D.parts(bench)) > 1
    assert sorted(map(tuple, D.find_leaks(docs, bench).collect())) == one
    assert D.drop_leaks(docs, bench).count() == docs.count() - len({r[0] for r in one})
