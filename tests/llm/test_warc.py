import hashlib
import json
from pathlib import Path

from srcgraph.llm import warc as W

SCHEMA = "page_id long, url string, html string, shard int, id string, size long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def read(folder):
    """What the manifest lists, checked against the files."""
    out = []
    m = json.loads((folder / "manifest.json").read_text())
    for f in m["files"]:
        data = (folder / f["file"]).read_bytes()
        assert len(data) == f["bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
        records = W.read_warc(data)
        assert records[0][1]["WARC-Type"] == "warcinfo" and records[0][1]["WARC-Filename"] == f["file"]
        assert len(records) - 1 == f["records"]
        out += [(f["file"], *r) for r in records[1:]]
    assert {p.name for p in folder.iterdir() if not p.name.startswith(".")} == {"manifest.json"} | {f["file"] for f in m["files"]}
    return out


def test_round_trip_and_same_bytes(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    a, b = tmp_path / "a", tmp_path / "b"
    kw = {"shard_bytes": 100_000, "file_bytes": 12_000}
    index = {(r.warc_file, r.file_offset): r for r in W.write_warc(pages, f"file://{a}", **kw).collect()}
    W.write_warc(pages.repartition(7).orderBy("html"), f"file://{b}", **kw)
    rows = sorted((r.url, r.page_id, r.html) for r in pages.collect())
    got = read(a)
    assert len({r[0] for r in got}) > 5 and len(got) == len(rows) == len(index)
    for (file, offset, head, block), (url, page_id, html) in zip(got, rows):
        assert head["WARC-Target-URI"] == url and block.partition(b"\r\n\r\n")[2].decode() == html
        assert head["WARC-Payload-Digest"] == W._sha1(html.encode()) and head["WARC-Block-Digest"] == W._sha1(block)
        r = index[file, offset]
        assert (r.page_id, r.url, r.record_id, r.payload_digest) == (page_id, url, head["WARC-Record-ID"], head["WARC-Payload-Digest"])
        assert W.read_warc((a / file).read_bytes()[offset : offset + r.record_length])[0][1] == head
    assert len({r[2]["WARC-Record-ID"] for r in got}) == len(got)
    names = sorted(p.name for p in a.iterdir())
    assert names == sorted(p.name for p in b.iterdir())
    assert all((a / n).read_bytes() == (b / n).read_bytes() for n in names)
    sizes = [(a / n).stat().st_size for n in names if n.endswith("gz")]
    assert max(sizes) <= 12_000 or max(sizes) < 12_000 + max(r.record_length for r in index.values())


def test_hard_rows(spark, tmp_path):
    rows = [(1, None, "a"), (None, None, None), (2, "http://x/ é\r\nEvil: 1", "b"), (3, "http://y", ""), (4, "http://z", "z" * 3_000_000), (5, "http://z", "w"), (5, "http://z", "w"), (5, "http://z", None)]
    index = W.write_warc(frame(spark, rows), f"file://{tmp_path}/w", file_bytes=500)
    assert index.count() == 8
    got = read(tmp_path / "w")
    assert len({r[2]["WARC-Record-ID"] for r in got}) == 8
    assert sorted(r[2]["WARC-Target-URI"] for r in got) == sorted(["urn:page:1", "urn:page:None", "http://x/%20%C3%A9%0D%0AEvil:%201", "http://y", "http://z", "http://z", "http://z", "http://z"])


def test_empty(spark, tmp_path):
    assert W.write_warc(frame(spark, []), f"file://{tmp_path}/w").count() == 0
    assert json.loads(Path(tmp_path, "w", "manifest.json").read_text())["files"] == []
