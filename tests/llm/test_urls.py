import math
from collections import Counter

import numpy as np
import pyarrow as pa
from srcgraph.llm import urls as U


def test_features():
    x = U.lexical(pa.array(["https://www.A-b.example.com/x/12/?q=1&r=%20#top", None, "no-scheme", "http://h"]))
    f = dict(zip(U.FEATURES, x.T))
    assert f["url_length"].tolist() == [47, 0, 9, 8] and f["host_length"].tolist() == [19, 0, 9, 1]
    assert f["depth"].tolist() == [2, 0, 0, 0] and f["labels"].tolist() == [4, 0, 1, 1] and f["hyphens"].tolist() == [1, 0, 1, 0]
    assert f["parameters"][0] == 2 and f["fragment"][0] == 1 and f["https"].tolist() == [1, 0, 0, 0] and f["longest_label"].tolist() == [7, 0, 9, 1]
    n = Counter("no-scheme")
    assert math.isclose(f["entropy"][2], -sum(c / 9 * math.log2(c / 9) for c in n.values()), rel_tol=1e-5)
    assert math.isclose(f["digit_share"][0], 5 / 47, rel_tol=1e-5)


def test_held_out_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = U.seed_labels(pages)
    part = U.F.pmod(U.F.xxhash64("url"), U.F.lit(2))
    f = U.Filter(pages, labels.filter(part == 0))
    truth = {r.url: r.bad for r in labels.filter(part == 1).collect()}
    got = [(r.blocked, truth[r.url]) for r in f.score(pages).collect() if r.url in truth]
    assert np.mean([b == bool(t) for b, t in got]) > 0.97
    assert np.mean([b for b, t in got if t]) > 0.85


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (None, "http://a.b"), (4, "::::"), (5, "http://x.y/" + "p" * 100000), (6, "http://é.ü/ö"), (6, "http://é.ü/ö"), (7, "http://h\nh.com/?&&="), (8, "//no.host")]
    pages = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], "page_id long, url string, host string, score double, bad int")
    labels = spark.createDataFrame([("http://a.b", 1, 1), (None, 1, 1), ("http://c.d/e", None, 1), ("http://e.f", 0, 1)], "url string, bad int, page_id int")
    got = U.Filter(pages, labels).score(pages).collect()
    assert sorted(map(str, [(r.page_id, r.url) for r in got])) == sorted(map(str, rows))
    assert all(r.score == 0 and not r.blocked for r in got if not r.url)
    none = U.Filter(pages, labels.limit(0)).score(pages).collect()
    assert {r.score for r in none if r.url} == {0.5}
    assert U.Filter(pages.limit(0), labels).score(pages.limit(0)).count() == 0
    assert U.Filter(pages.limit(0), labels.limit(0)).score(pages.limit(0)).count() == 0


def test_suffixes(spark):
    want = {"http://a.b.co.uk/x": "co.uk", "co.uk": "co.uk", "http://www.shop.com.br:80": "com.br", "http://u@a.com./": "com", "http://10.0.0.7:8080/": "ip", "http://[::1]/": "ip", "http://com": "com", "": "", None: "", "http://x.notco.uk": "uk"}
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: r.s for r in df.select("url", U.suffix(U.F.col("url")).alias("s")).collect()} == want


def test_suffix_statistics(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.com/1", "http://a.com:80/2", "http://b.com", "http://c.org", "http://c.org./x"])], "page_id long, url string")
    f = U.Filter(pages, pages.selectExpr("url", "int(page_id = 3) AS bad"))
    s = {r._sg_suffix: (r._sg_urls, r._sg_hosts, r._sg_n, r._sg_b) for r in f.stats.collect()}
    assert s == {"com": (3, 3, 3, 0), "org": (2, 2, 2, 1)}
