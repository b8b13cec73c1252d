"""Points-to call edges on own sources with the features that matter."""

from srcgraph.operators import pointsto
from srcgraph.operators.extract import extract
from srcgraph.operators.pointsto import decomposed_edges, points_to_edges, solve_sources
from srcgraph.plans import source_queries
from srcgraph.plans.engine import Options, analyze_sources


def edges(source, name="m.py"):
    return solve_sources({name: source})


def test_functions_as_arguments_and_alias_chains():
    got = edges("def triple(x): return x\ndef apply(f, x): return f(x)\ndef main():\n    g = triple\n    h = g\n    apply(h, 1)\n")
    assert {("m.apply", "m.triple"), ("m.main", "m.apply")} <= got


def test_decorators_and_closures():
    got = edges("def log(fn):\n    def wrapper(*a):\n        return fn(*a)\n    return wrapper\n@log\ndef greet(n): return n\ndef main(): greet(1)\n")
    assert ("m.log.wrapper", "m.greet") in got and ("m.main", "m.log.wrapper") in got


def test_virtual_dispatch_super_and_constructors():
    got = edges(
        "class A:\n    def __init__(self): self.n = 1\n    def speak(self): pass\n    def describe(self): self.speak()\n"
        "class B(A):\n    def __init__(self): super().__init__()\n    def speak(self): pass\ndef main():\n    b = B()\n    b.describe()\n"
    )
    assert {("m.A.describe", "m.B.speak"), ("m.B.__init__", "m.A.__init__"), ("m.main", "m.B.__init__"), ("m.main", "m.A.describe")} <= got


def test_async_pipeline():
    got = edges(
        "import asyncio\nasync def fetch_data(u): return u\nasync def process_url(u):\n    return await fetch_data(u)\n"
        "async def fetch_all(us):\n    return await asyncio.gather(*[process_url(u) for u in us])\nasync def pipeline(us):\n    return await fetch_all(us)\n"
    )
    assert {("m.process_url", "m.fetch_data"), ("m.pipeline", "m.fetch_all"), ("m.fetch_all", "m.process_url")} <= got


def test_imports_across_files_and_reexports():
    got = solve_sources({"p/__init__.py": "from .a import f as g\n", "p/a.py": "def f(): pass\n", "main.py": "from p import g\nimport p.a as q\ndef run():\n    g()\n    q.f()\n"})
    assert ("main.run", "p.a.f") in got


def test_result_is_the_same_every_time_and_mutual_recursion_ends():
    source = "".join(f"def f{i}(g): return f{(i + 1) % 50}(f{(i + 7) % 50}) or g(g)\n" for i in range(50))
    assert edges(source) == edges(source)


def test_shards_that_run_away_are_taken_apart(spark):
    ring = "".join(f"def f{i}(g): return f{(i + 1) % 30}(f{(i + 7) % 30}) or g(g)\n" for i in range(30))
    sources = {"a.py": "def f(): return 1\ndef main(): f()\n", "b.py": "def g(): return 2\ndef main(): g()\n", "wild.py": ring}
    df = spark.createDataFrame(list(sources.items()), "file_key string, source string").selectExpr("file_key", "source", "0D AS last_modified", "1L AS file_size", "'h' AS content_hash", "CAST(NULL AS STRING) AS error")
    x = extract(df)
    one = x.selectExpr("0 AS shard_id", "file_key")
    asked = []

    def replan(files, budget):
        asked.append(sorted(r.file_key for r in files.collect()))
        return files.selectExpr("abs(hash(file_key)) AS shard_id", "file_key")

    assert points_to_edges(x, one, max_facts=60).count() == 0
    got = {(r.source, r.target) for r in decomposed_edges(x, one, replan, [3, 1], max_facts=60).collect()}
    assert got == {("a.main", "a.f"), ("b.main", "b.g")} and asked == [["a.py", "b.py", "wild.py"]]
    assert points_to_edges(x, one).count() > 30


def test_where_nothing_plans_again_there_is_no_limit_on_facts(spark, monkeypatch):
    files = spark.createDataFrame([("d/a.py", "def f(): return 1\ndef main(): f()\n")], "file_key string, source string").selectExpr("file_key", "source", "0D AS last_modified", "1L AS file_size", "'h' AS content_hash", "CAST(NULL AS STRING) AS error")
    assert {(r.source, r.target) for r in analyze_sources(spark, files, Options(".", level=2, max_facts=1)).level_2.collect()} == {("d.a.main", "d.a.f")}
    limits, solved, x = [], pointsto._solved, extract(files)
    monkeypatch.setattr(pointsto, "_solved", lambda *a: limits.append(a[3]) or solved(*a))
    monkeypatch.setattr(source_queries, "parsed", lambda *_: x)
    for q in (source_queries.pointsto_edges, source_queries.level2_call_graph):
        assert {(r.source, r.target) for r in q(spark, "").collect()} == {("d.a.main", "d.a.f")}
    assert limits == [None, None]


def rendered(spark, sources):
    return spark.createDataFrame(list(sources.items()), "file_key string, source string").selectExpr("file_key", "source", "0D AS last_modified", "1L AS file_size", "'h' AS content_hash", "CAST(NULL AS STRING) AS error")


PACKAGE = {
    "p/root.py": "class Root:\n    def __init__(self, x): self.x = x\n    def grow(self, by): return self\ndef own(): return Root(1).grow(2)\n",
    **{f"p/m{i}.py": f"from .root import Root as R\nimport lib\ndef f{i}(g=None):\n    R(1).grow(2).grow(3)\n    lib.call(g)\n    h{i}()\ndef h{i}(): pass\n" for i in range(6)},
}


def test_files_are_solved_beside_what_they_import_in_parts_of_bounded_size(spark):
    x = extract(rendered(spark, PACKAGE))
    sizes, want = {r.file_key: r.n for r in x.selectExpr("file_key", "size(flows) AS n").collect()}, solve_sources(PACKAGE)
    parts = pointsto.plan_parts(sizes, [(f, "p/root.py") for f in sizes], 60)
    assert len({s for _, s, _, _ in parts}) >= 3 and sorted(f for f, _, own, _ in parts if own) == sorted(sizes)
    most = max(sum(sizes[f] for f, s, own, _ in parts if s == shard and own) for shard in {s for _, s, _, _ in parts})
    assert most <= 60 < sum(sizes.values())
    assert {(r.source, r.target) for r in pointsto.whole_edges(x, part_rows=60).collect()} == want and len(want) > 20
    assert {(r.source, r.target) for r in pointsto.whole_edges(x).collect()} == want


def test_what_one_file_hands_to_another_by_an_imported_one_is_found(spark):
    more = {
        "p/base.py": "class Box: pass\nbox = Box()\ndef keep(f): box.f = f\ndef run(f): f()\nclass A:\n    def go(self): self.step()\n    def step(self): pass\n",
        "p/give.py": "from .base import keep\ndef given(): pass\ndef give(): keep(given)\n",
        "p/take.py": "from .base import box\ndef take(): box.f()\n",
        "p/sub.py": "from .base import A, run\nclass B(A):\n    def step(self): pass\ndef main():\n    B().go()\n    run(main)\n",
        "q/user.py": "import p\ndef use(): p.take.take()\n",
        "p/__init__.py": "from . import take\n",
    }
    sources = PACKAGE | more
    got = {(r.source, r.target) for r in pointsto.whole_edges(extract(rendered(spark, sources)), part_rows=40).collect()}
    assert {("p.take.take", "p.give.given"), ("p.base.A.go", "p.sub.B.step"), ("p.base.run", "p.sub.main"), ("q.user.use", "p.take.take")} <= got
    assert got == solve_sources(sources)


def test_parts_whose_imports_are_tangled_stay_whole():
    sizes = {f"f{i}": 10 for i in range(30)}
    parts = pointsto.plan_parts(sizes, [(f"f{i}", f"f{j}") for i in range(30) for j in range(i)], 20)
    assert {s for _, s, _, _ in parts} == {0} and all(own for _, _, own, _ in parts)
