import corpus_pipeline as P
import numpy as np
from srcgraph.llm import boosting, decontaminate, mixing, near_dedup, quality, tokens

from tests.llm.test_decontaminate import distance
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_dedup import brute as brute_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string"


def run_stages(spark, docs, sf, tmp):
    out = []
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp}/{i}")
        docs = spark.read.parquet(f"{tmp}/{i}")
        out.append(docs)
    return out


def test_every_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = run_stages(spark, docs, sf, tmp_path)
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_ids"]
    for k in kept[:-1]:
        assert k.columns == docs.columns
    rows = [[(r.doc_id, r.text, r.source) for r in k.collect()] for k in (docs, *kept[:-1])]
    # quality: the model's scores, one document at a time
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def score(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        x = quality.features(raw, np.array([0, len(raw)]))
        return 0 if np.isnan(x[0, 0]) else boosting.predict(model, x)[0]

    assert {d for d, *_ in rows[1]} == {d for d, t, _ in rows[0] if score(t) >= quality.KEEP_AT}
    # near duplicates: the least of each group stays
    groups = brute_groups([(d, t) for d, t, _ in rows[1]])
    gone = {d for g in groups for d in g if d != min(g)}
    lost = {d for d, *_ in rows[1]} - {d for d, *_ in rows[2]}
    assert lost <= gone and len(lost) >= 0.9 * len(gone)
    # leaks
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        """Within the budget, for whatever shares a fragment of four words with an item: fragments that no edit of the budget spares are too many to miss."""
        t = decontaminate.normalise(text)
        return any(x in t or any(f in t for f in parts) and distance(x, t) <= decontaminate.budget(len(x)) for x, parts in cut)

    cut = [(x, [x[a:b] for a, b in decontaminate.pieces(len(x), decontaminate.budget(len(x)))]) for x in items]
    stay = {d for d, *_ in rows[3]}
    assert all(leaks(t) != (d in stay) for d, t, _ in rows[2])
    # mixing
    assert sorted(d for d, *_ in rows[4]) == sorted(r[0] for r in brute_mix(rows[3]) if r[4] == 0)
    # token ids
    enc = tokens.encoder(tokens.VOCABULARY)
    text = {d: t for d, t, _ in rows[4]}
    last = tokens.read_token_ids(kept[-1]).collect()
    assert sorted(r.doc_id for r in last) == sorted(text)
    assert all(enc.decode(r.ids) == text[r.doc_id] for r in last)


def test_run_gives_the_stages_rows(spark, sf):
    assert P.run(spark, sf).columns == ["doc_id", "n_tokens", "block_words", "words"]


def test_stages_on_hard_rows(spark, sf, tmp_path):
    rows = [(1, None, None, None, None, None, None), (None, "some text here", "en", "a", 1, 0.0, "k"), (3, "", "en", "a", 0, 0.0, "k"), (4, "long text " * 40000, "en", "b", 1, 0.0, "k"), (5, "Twice told.", "en", "b", 1, 0.0, "k"), (5, "Twice told.", "en", "b", 1, 0.0, "k")]
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= 6
    kept = run_stages(spark, docs, sf, tmp_path / "hard")
    assert kept[1].filter("doc_id = 5").count() == kept[0].filter("doc_id = 5").count() // 2
    run_stages(spark, docs.limit(0), sf, tmp_path / "empty")
