import numpy as np
import pytest
from srcgraph.llm import audio as A


def ulaw(b):
    b = ~b & 255
    x = ((2 * (b & 15) + 33) << (b >> 4 & 7)) - 33
    return -4 * x if b & 128 else 4 * x


def alaw(b):
    b ^= 0x55
    e, m = b >> 4 & 7, b & 15
    x = 2 * m + 1 if e == 0 else (2 * m + 33) << (e - 1)
    return 8 * x if b & 128 else -8 * x


def adpcm(block):
    """One block, one sample at a time."""
    if len(block) < 4:
        return []
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(A.STEPS[index])
            d = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                d += part if n & bit else 0
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[n & 7]))
            out.append(value)
    return out


def slow_resample(x, up, down):
    h, before = A.filters(up, down)
    out = []
    for k in range(-(-len(x) * up // down)):
        base, p = k * down // up - before, k * down % up
        s = sum(float(h[p][j]) * x[base + j] for j in range(h.shape[1]) if 0 <= base + j < len(x))
        out.append(max(-32768, min(32767, s)))
    return np.array(out)


def parts(rows):
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def test_tables():
    assert A.MULAW.tolist() == [ulaw(b) for b in range(256)]
    assert A.ALAW.tolist() == [alaw(b) for b in range(256)]
    assert len(A.STEPS) == 89


def test_adpcm_blocks():
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 3, 4, 5, 255, 256, 257, 259, 260, 1000, 5000)]
    got, counts = A.decode_adpcm(*parts(rows))
    want = [[s for at in range(0, len(r), 256) for s in adpcm(r[at : at + 256])] for r in rows]
    assert counts.tolist() == [len(w) for w in want] and got.tolist() == [s for w in want for s in w]


@pytest.mark.parametrize("rates", [(8000, 16000), (8000, 24000), (16000, 8000), (11025, 16000), (8000, 8000)])
def test_resampling(rates):
    rng = np.random.default_rng(1)
    rows = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (0, 1, 7, 300)]
    got, counts = A.resample(np.concatenate(rows), np.array([len(r) for r in rows]), *rates)
    g = np.gcd(*rates)
    want = [r if rates[0] == rates[1] else slow_resample(r.astype(float), rates[1] // g, rates[0] // g) for r in rows]
    assert counts.tolist() == [len(w) for w in want]
    assert np.abs(got - np.concatenate(want)).max() <= 1


def test_a_tone_stays_a_tone():
    t = np.arange(4000) / 8000
    x = np.rint(12000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    y, _ = A.resample(x, np.array([4000]), 8000, 16000)
    want = 12000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert np.abs(y - want)[50:-50].max() < 60


def test_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(40)
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    got = A.to_pcm(A.text_media(docs)).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        raw = text[r.doc_id]
        x = [ulaw(b) for b in raw] if r.doc_id % 3 == 0 else [alaw(b) for b in raw] if r.doc_id % 3 == 1 else [s for at in range(0, len(raw), 256) for s in adpcm(raw[at : at + 256])]
        pcm = np.frombuffer(r.pcm, "<i2")
        assert r.n_samples == len(pcm) == 2 * len(x) and pcm[::2].tolist() == x
        n = min(len(x), 60)
        assert np.abs(pcm[: 2 * n - 20] - slow_resample(np.array(x[: n + 20], float), 2, 1)[: 2 * n - 20]).max() <= 1


def test_hard_rows(spark):
    rows = [(1, "mulaw", 8000, None), (2, "alaw", 8000, b""), (3, "mp3", 8000, b"x"), (4, None, 8000, b"x"), (5, "alaw", None, b"x"), (6, "alaw", 0, b"x"), (7, "ima_adpcm", 8000, b"abc"), (None, "mulaw", 8000, b"x"), (8, "mulaw", 16000, b"y" * 3_000_000), (9, "alaw", 8000, b"z"), (9, "alaw", 8000, b"z")]
    df = spark.createDataFrame([(*r, "q", b"p") for r in rows], "doc_id long, codec string, sample_rate long, payload binary, n_samples string, pcm binary")
    got = sorted(((r.doc_id or 0, r.n_samples, r.pcm is None) for r in A.to_pcm(df).collect()))
    assert got == [(0, 2, False), (1, 0, True), (2, 0, False), (3, 0, True), (4, 0, True), (5, 0, True), (6, 0, True), (7, 0, False), (8, 3_000_000, False), (9, 2, False), (9, 2, False)]
    assert A.to_pcm(df.limit(0)).count() == 0
    docs = spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")
    assert sorted((r.codec, r.n_samples) for r in A.to_pcm(A.text_media(docs)).collect()) == [("mulaw", 0), ("mulaw", 2)]
