import numpy as np
from srcgraph.llm import boosting as B
from srcgraph.llm import quality as Q


def slow_predict(m, x):
    """One row and one node at a time."""
    out = []
    for r in x:
        s = m.base
        for t in range(len(m.leaf)):
            at = 0
            while at < m.feature.shape[1]:
                at = 2 * at + 1 + int(np.float32(r[m.feature[t][at]]) > m.cut[t][at])
            s += float(m.leaf[t][at - m.feature.shape[1]])
        out.append(1 / (1 + np.exp(-s)))
    return np.array(out)


def test_trees_learn_and_traversal_is_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = B.fit(x[:2000], y[:2000])
    p = B.predict(m, x)
    assert ((p[2000:] > 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(p[:300], slow_predict(m, x[:300]))


def test_one_class_or_none():
    assert np.allclose(B.predict(B.fit(np.zeros((0, 3)), np.zeros(0)), np.zeros((2, 3))), 0.5)
    assert np.allclose(B.predict(B.fit(np.ones((8, 3)), np.ones(8)), np.zeros((2, 3))), 0.9)


def test_features_against_plain_python():
    texts = ["Hello big big World 42!", "", "a\nb\na\n\nb", "éé ÀÀ -- éé"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    f = dict(zip(Q.FEATURES, Q.features(data, offsets).T))
    assert np.isnan(f["upper"][1])
    assert np.allclose(f["upper"][0], 2 / 16) and np.allclose(f["digit"][0], 2 / 23) and np.allclose(f["repeated_words"], [0.2, np.nan, 0.5, 1 / 3], equal_nan=True)
    assert np.allclose(f["mean_word"][0], (5 + 3 + 3 + 5 + 2) / 5)
    assert np.allclose(f["repeated_lines"][[0, 2]], [0, 0.5])
    alone = Q.features(np.frombuffer(raw[3], np.uint8), np.array([0, len(raw[3])]))
    assert np.allclose(alone[0], Q.features(data, offsets)[3])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen, held = labels.filter("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    got = Q.score(docs, seen).collect()
    assert len(got) == docs.count()
    right = [r.keep == bool(held[r.doc_id]) for r in got if r.doc_id in held]
    assert np.mean(right) > 0.97
    kept = Q.drop_low_quality(docs, seen)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.keep)


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0, 1), (2, "", 1.0, 1), (3, "!!!", 1.0, 1), (4, "word " * 100000, 1.0, 1), (None, "some words here", 1.0, 1), (6, "good", 1.0, 1), (6, "good", 1.0, 1)], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(4, 0, 0, "x"), (6, 1, None, "x"), (6, None, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = Q.score(docs, labels).collect()
    assert len(got) == 7 and [r.keep for r in got[:3]] == [False] * 3 and got[0].score == 0
    assert Q.drop_low_quality(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert sorted(r.doc_id or 0 for r in Q.drop_low_quality(docs, none).collect()) == [0, 4, 6, 6]
    assert Q.score(docs.limit(0), labels).count() == 0
