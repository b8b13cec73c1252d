import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from srcgraph.llm import language as L

PAGES = "page_id long, url string, html string, lang string, host string, top int"
DOCS = "doc_id long, text string, lang string, source string, ll double, page_id long"


def brute(docs, pages):
    """Every step on one row at a time, in plain Python."""
    names = sorted({r.lang for r in docs if r.lang and r.text is not None})
    bucket = lambda t: L.trigrams(np.frombuffer(t, np.uint8)).tolist()
    counts = {n: defaultdict(int) for n in names}
    for r in docs:
        if r.lang and r.text is not None:
            for x in bucket(r.text.encode()):
                counts[r.lang][x] += 1
    size = {n: sum(counts[n].values()) + L.SMOOTH_COUNT * L.BUCKETS for n in names}
    rows = []
    for r in docs:
        rows.append((r.doc_id, None, r.text, r.source and "source:" + r.source, None, None, None))
    for r in pages:
        host = re.sub(r"^[a-z]+://", "", r.url).split("/")[0].split("?")[0].split("#")[0]
        parts = host.split(".")
        d = re.search(r'<html[^>]* lang="(\w+)', r.html)
        text = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ", r.html)
        rows.append((None, r.page_id, text, host, ".".join(parts[-2:]), parts[-1], d and d.group(1)))
    read = []
    for r in rows:
        b = bucket((r[2] or "").encode())
        ll = [sum(math.log((counts[n][x] + L.SMOOTH_COUNT) / size[n]) for x in b) * L.EVIDENCE for n in names]
        read.append((ll, max(range(len(names)), key=lambda i: (ll[i], -i)) if b else None))
    total = [sum(t == i for _, t in read) for i in range(len(names))]
    seen = [defaultdict(lambda: [0] * len(names)) for _ in range(4)]
    for r, (_, t) in zip(rows, read):
        for s, key in zip(seen, r[3:]):
            if key is not None and t is not None:
                s[key][t] += 1
    out = {}
    for r, (ll, t) in zip(rows, read):
        own = [int(t == i) for i in range(len(names))]
        left = [[max(0, a - b) for a, b in zip(s[key], own)] if key is not None else [0] * len(names) for s, key in zip(seen, r[3:])]
        prior = [(n + 1) / (sum(total) + len(names)) for n in total]
        for c in (left[1], left[0]):
            prior = [(a + L.SMOOTH_HOST * p) / (sum(c) + L.SMOOTH_HOST) for a, p in zip(c, prior)]
        score = [a + math.log(p) for a, p in zip(ll, prior)]
        rest = [n - o for n, o in zip(total, own)]
        for c in (left[3], left[2]):
            if sum(c):
                share = sum(c) / max(1, sum(rest))
                score = [s + math.log((a + L.SMOOTH_HOST * share) / (n + L.SMOOTH_HOST)) for s, a, n in zip(score, c, rest)]
        best = max(range(len(names)), key=lambda i: (score[i], -i))
        out[r[0], r[1]] = (names[best], 1 / sum(math.exp(s - score[best]) for s in score))
    return out


def test_matches_brute_force_and_is_right(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    got = L.identify(docs, pages).collect()
    want = brute(docs.collect(), pages.collect())
    assert len(got) == len(want)
    for r in got:
        lang, p = want[r.doc_id, r.page_id]
        assert math.isclose(r.probability, p, abs_tol=1e-4)
        assert r.lang == lang or p < 0.51
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.lang == truth[r.doc_id] for r in got if r.doc_id is not None]) > 0.95


def test_held_out_text(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    mixed = docs.filter("doc_id % 2 = 0").unionByName(docs.filter("doc_id % 2 = 1").withColumn("lang", L.F.lit(None).cast("string")))
    truth = {r.doc_id: r.lang for r in docs.filter("doc_id % 2 = 1").collect()}
    got = L.identify(mixed, spark.read.parquet(f"{d}/pages.parquet").limit(0)).collect()
    assert np.mean([r.lang == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.95


def test_evidence_decides_where_text_does_not(spark):
    docs = [(i, t * 20, l, l, 0.0, 1) for i, (t, l) in enumerate([("the cat and the dog ", "en"), ("le chat et le chien ", "fr")] * 30)]
    page = lambda l, t: f'<html lang="{l}"><p>{t}</p></html>'
    pages = [(i, f"http://h{l}.{s}/x", page(l, t * 20), "x", "y", 1) for i, (t, l, s) in enumerate([("the cat and the dog ", "en", "uk"), ("le chat et le chien ", "fr", "fr")] * 30)]
    pages += [(100, "http://hfr.fr/", page("fr", ""), "x", "y", 1), (101, "http://hen.uk/", page("en", "!"), "x", "y", 1), (102, "http://new.fr/", page("fr", "42"), "x", "y", 1)]
    got = {r.page_id: r for r in L.identify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages, PAGES)).collect() if r.page_id is not None}
    assert [got[i].lang for i in (100, 101, 102)] == ["fr", "en", "fr"] and got[100].probability > 0.9


def test_more_languages_and_hosts_than_are_sent_at_once_give_the_same(spark, sf, monkeypatch):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    one = sorted(map(str, L.identify(docs, pages).select("doc_id", "page_id", "lang", F.round("probability", 6)).collect()))
    monkeypatch.setattr(L, "LANGUAGES", 2)
    monkeypatch.setattr(L.C, "BROADCAST_BYTES", 8)
    assert len(L.train(docs)[1]) == 2
    assert sorted(map(str, L.identify(docs, pages).select("doc_id", "page_id", "lang", F.round("probability", 6)).collect())) == one


def test_a_whole_book_outweighs_its_host(spark):
    docs = [(i, "the cat and the dog ", "en", "en", 0.0, 1) for i in range(200)] + [(300, "le chat et le chien ", "fr", "fr", 0.0, 1), (301, "le chat et le chien " * 5000, None, "en", 0.0, 1)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], PAGES)).collect()}
    assert got[301].lang == "fr" and got[301].probability > 0.999


def test_hard_rows(spark):
    docs = [(1, None, "en", "a", 0.0, 1), (2, "", "en", None, 0.0, 1), (3, "hello there friend", "en", "a", 0.0, 1), (3, "hello there friend", "en", "a", 0.0, 1), (4, "bonjour mon ami", None, "a", 0.0, 1), (None, "mot " * 100000, "fr", "b", 0.0, 1)]
    pages = [(1, None, None, "q", "q", 1), (2, "", "", "q", "q", 1), (None, "http://", "<script>", "q", "q", 1), (4, "nonsense", "<" * 5000, "q", "q", 1), (5, "http://a:80/", '<html lang=ZZ>hello</html>', "q", "q", 1)]
    d, p = spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages, PAGES)
    got = L.identify(d, p).collect()
    assert len(got) == 11 and all(r.lang in ("en", "fr") for r in got)
    assert L.identify(d.limit(0), p).filter("lang IS NULL").count() == 5
    assert L.identify(d.limit(0), p.limit(0)).count() == 0
    assert L.identify(d, p.limit(0)).count() == 6
