"""Long ways through re-exports and inheritance."""

from srcgraph.operators import resolve
from srcgraph.operators.extract import extract
from srcgraph.operators.pointsto import solve_sources


def test_every_hop_and_level_is_followed(spark):
    sources = {"m0.py": "def f(): pass\n", "c0.py": "class C0:\n    def go(self): pass\n", "ring.py": "from ring.a import a\n"}
    sources |= {f"m{i}.py": f"from m{i - 1} import f\n" for i in range(1, 11)}
    sources["c0.py"] += "".join(f"class C{i}(C{i - 1}): pass\n" for i in range(1, 15))
    sources["use.py"] = "from m10 import f\nfrom c0 import C14\nfrom ring import a\ndef run():\n    f()\n    x = C14()\n    x.go()\n    a.b()\n"
    assert ("use.run", "m0.f") in solve_sources(sources)
    df = spark.createDataFrame(list(sources.items()), "file_key string, source string").coalesce(1).selectExpr("file_key", "source", "0D AS last_modified", "1L AS file_size", "'h' AS content_hash", "CAST(NULL AS STRING) AS error")
    got = {r.method_name: r.callee_signature for r in resolve.resolve_calls(extract(df)).collect() if r.caller_signature == "use.run"}
    assert got["f"] == "m0.f" and got["go"] == "c0.C0.go"
