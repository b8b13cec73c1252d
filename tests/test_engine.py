"""Whole projects: scan, model, sinks, cache, store, command line, stream."""

import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import propgraph
from srcgraph.operators.store import GraphStore
from srcgraph.plans import cli
from srcgraph.plans.engine import Engine, InputNotFound, Options, analyze_sources
from srcgraph.sources import sinks
from srcgraph.functions import names as N
from srcgraph.sources.project import list_files, project_checksum, read_project
from srcgraph.streaming.watch import keep_store

FILES = {
    "pypkg/__init__.py": "from .core import Shape\n",
    "pypkg/core.py": '"""Core."""\nimport os\n\n\nclass Shape:\n    """A shape."""\n    sides: int = 0\n\n    def area(self):\n        return helper(self.sides)\n\n\ndef helper(n):\n    total = n\n    return os.path.join(str(total))\n',
    "pypkg/_private.py": "from pypkg import Shape\n\n\ndef make():\n    s = Shape()\n    return s.area()\n",
    "main.py": "from pypkg._private import make\n\n\ndef main():\n    make()\n    make()\n",
    "bad.py": "def (\n",
    "tests/test_main.py": "def test(): pass\n",
    ".venv/lib.py": "x = 1\n",
}


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    for name, source in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(source)
    return root


def analyse(spark, root, **options):
    return Engine(spark, Options(str(root), **options)).analyze()


def test_scan(spark, project):
    assert list_files(str(project), skip_tests=True) == ["bad.py", "main.py", "pypkg/__init__.py", "pypkg/_private.py", "pypkg/core.py"]
    paths = ["a/b.py", "build/a.py", "a/tests/b.py", "a/test_b.py", "a/build.py", "conftest.py", "test.py"]
    assert [p for (p,) in spark.createDataFrame([(p,) for p in paths], "p string").filter(N.is_entry_point(F.col("p"))).collect()] == ["a/b.py", "a/build.py", "test.py"]
    (project / "latin.py").write_bytes(b"# \xe9\xff\n")
    rows = {r.file_key: r for r in read_project(spark, str(project)).collect()}
    assert rows["latin.py"].error and rows["main.py"].source == FILES["main.py"] and "tests/test_main.py" in rows
    one = read_project(spark, str(project)).filter("file_key = 'main.py'").collect()
    assert [r.file_key for r in one] == ["main.py"]
    every = hashlib.sha256(b"".join(p.read_bytes() for p in sorted(project.rglob("*.py")))).hexdigest()
    assert project_checksum(str(project)) == every


def test_model_and_call_graph(spark, project):
    m = analyse(spark, project, level=2)
    e = {(r.source, r.target): r for r in m.call_edges.collect()}
    assert e["main.main", "pypkg._private.make"].weight == 3 and sorted(e["main.main", "pypkg._private.make"].provenance) == ["jedi", "pycg"]
    assert ("pypkg._private.make", "pypkg.core.Shape.area") in e and ("pypkg.core.Shape.area", "pypkg.core.helper") in e
    assert {"os.path.join", "builtins.str"} & {r.signature for r in m.external_symbols.collect()}
    assert [r.file_key for r in m.parse_errors.collect()] == ["bad.py"]


def test_sharded_level_2_has_the_edges_of_its_shards(spark, project, monkeypatch):
    from srcgraph.operators import pointsto

    whole = {(r.source, r.target) for r in analyse(spark, project, level=2).level_2.collect()}
    monkeypatch.setattr(pointsto, "WHOLE_PROJECT_FILES", 1)
    assert analyse(spark, project, level=2, shard=False).level_2.count() == 0
    for options in ({}, {"shard": True}):
        assert {(r.source, r.target) for r in analyse(spark, project, level=2, **options).level_2.collect()} == whole
    by_package = {(r.source, r.target) for r in analyse(spark, project, level=2, shard_strategy="package").level_2.collect()}
    assert by_package and by_package <= whole
    assert analyse(spark, project, level=2, shard_strategy="package", shard_budget=1).shard_assignment.count() == 1
    wild = {(r.source, r.target) for r in analyse(spark, project, level=2, shard=True, max_facts=1).level_2.collect()}
    assert wild == set()


def test_document_script_and_contract(spark, project, tmp_path):
    m = analyse(spark, project)
    doc = json.loads(open(sinks.write_json(m, str(tmp_path / "o"))).read())
    assert set(doc["symbol_table"]) == {"main.py", "pypkg/__init__.py", "pypkg/_private.py", "pypkg/core.py"}
    packed = sinks.write_binary(m, str(tmp_path / "o"))
    assert os.path.getsize(packed) > 0
    folder = sinks.write_documents(m, str(tmp_path / "lines"))
    for back in (sinks.read_json(spark, str(tmp_path / "o" / "analysis.json")), sinks.read_json(spark, packed), sinks.read_documents(spark, folder)):
        for name in (*sinks._NEST, "call_edges", "external_symbols"):
            want = getattr(m, name).drop("ord", "base_refs", "dotted")
            columns = [c for c in back[name].columns if c != "ord"]
            assert sorted(map(str, back[name].select(*columns).collect())) == sorted(map(str, want.select(*columns).collect())), name
    one, two = (open(sinks.write_script(m, str(tmp_path / d), "app")).read() for d in "ab")
    assert one == two and "MERGE" in one and "DETACH DELETE" in one
    assert json.loads(sinks.write_contract())["node_labels"]


def test_emitted_graph_keeps_to_the_contract(spark, project):
    nodes, edges = propgraph.project(analyse(spark, project), "app")
    c = json.loads(sinks.write_contract())
    labels = {n["label"] for n in c["node_labels"]} | {n["merge_label"] for n in c["node_labels"]}
    assert {x for r in nodes.select("labels").collect() for x in r.labels} <= labels
    assert {r.type for r in edges.select("type").distinct().collect()} <= {r["type"] for r in c["relationship_types"]}


def test_cache_takes_unchanged_files_and_drops_vanished_ones(spark, project):
    before = analyse(spark, project).call_edges.count()
    assert (project / ".srcgraph").is_dir()
    assert analyse(spark, project).call_edges.count() == before
    (project / "main.py").write_text("def other(): pass\n")
    os.utime(project / "main.py", (time.time() + 9, time.time() + 9))
    (project / "pypkg/_private.py").unlink()
    got = {r.signature for r in analyse(spark, project).callables.collect()}
    assert got == {"main.other", "pypkg.core.Shape.area", "pypkg.core.helper"}


def contents(store, app):
    nodes, edges = store.read()
    own = nodes.filter(F.col("module").isNotNull() & (F.col("app") == app)).select("labels", "value", "module", F.to_json("props"))
    return sorted(map(str, own.collect())), sorted(map(str, edges.filter(F.col("app") == app).select("type", "from_value", "to_value", "module", F.to_json("props")).collect()))


def test_applications_of_equal_file_names_do_not_meet(spark, project, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    nodes, edges = propgraph.project(analyse(spark, project), "app")
    store.push(nodes, edges, "app")
    n, e = store.read()
    assert (n.count(), e.count()) == (nodes.count(), edges.count())
    before = contents(store, "app")
    store.push(nodes, edges, "app")
    assert contents(store, "app") == before and tuple(x.count() for x in store.read()) == (n.count(), e.count())
    (project / "main.py").write_text("def other(): pass\n")
    os.utime(project / "main.py", (time.time() + 9, time.time() + 9))
    (project / "pypkg/_private.py").unlink()
    rows = propgraph.project(analyse(spark, project, rebuild=True), "other")
    store.push(*rows, "other", full=True)
    assert contents(store, "app") == before
    mine = contents(store, "other")
    assert len(mine[0]) == rows[0].filter("props['_module'] IS NOT NULL").count() and len(mine[1]) == rows[1].count()
    assert any("other" in x for x in mine[0]) and not any("main.main" in x for x in mine[0])
    store.push(*propgraph.project(analyse(spark, project, rebuild=True, file="main.py"), "app"), "app", full=False)
    assert {r.file_key for r in store.modules().filter("app = 'app'").collect()} == {"main.py", "pypkg/__init__.py", "pypkg/_private.py", "pypkg/core.py"}
    assert any("main.other" in x for x in contents(store, "app")[0]) and contents(store, "other") == mine
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("v-")]) <= 4


def test_a_node_that_moves_to_another_file_is_there_once(spark, tmp_path):
    schema = "file_key string, source string, last_modified double, file_size long, content_hash string, error string"
    store = GraphStore(spark, str(tmp_path / "store"))
    for v, sources in enumerate([{"a.py": "def f(): g()\ndef g(): pass\n", "b.py": "from a import g\ndef h(): g()\n"}, {"a.py": "def f(): pass\n", "b.py": "def h(): pass\n"}, {"b.py": "def h(): pass\n"}]):
        df = spark.createDataFrame([(k, s, 0.0, 1, f"{hash(s)}", None) for k, s in sources.items()], schema)
        store.push(*propgraph.project(analyze_sources(spark, df), "app"), "app")
        nodes, edges = store.read()
        assert {r.value for r in nodes.filter("array_contains(labels, 'PyCallable')").collect()} == [{"a.f", "a.g", "b.h"}, {"a.f", "b.h"}, {"b.h"}][v]
        assert {(r.from_value, r.to_value) for r in edges.filter("type = 'PY_CALLS'").collect()} == [{("a.f", "a.g"), ("b.h", "a.g")}, set(), set()][v]


def test_a_full_push_drops_vanished_modules_with_what_they_own(spark, project, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    store.push(*propgraph.project(analyse(spark, project), "app"), "app")
    (project / "pypkg/_private.py").unlink()
    store.push(*propgraph.project(analyse(spark, project, rebuild=True), "app"), "app")
    nodes, edges = store.read()
    assert nodes.filter("module = 'pypkg/_private.py'").count() == 0
    assert edges.filter("from_value = 'pypkg._private.make'").count() == 0
    assert {r.file_key for r in store.modules().collect()} == {"main.py", "pypkg/__init__.py", "pypkg/core.py"}


def test_command_line(spark, project, tmp_path, capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and "srcgraph" in capsys.readouterr().out
    assert cli.main(["--emit", "schema"]) == 0 and "node_labels" in capsys.readouterr().out
    assert cli.main([]) == 1 and cli.main(["-i", str(tmp_path / "none")]) == 1
    assert cli.main(["-i", str(project), "-o", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out" / "analysis.json").read_text())["symbol_table"]
    with pytest.raises(SystemExit):
        cli.main(["-i", str(project), "-a", "3"])
    with pytest.raises(ValueError):
        Options(".", shard_budget=0)
    with pytest.raises(InputNotFound):
        analyse(spark, tmp_path / "none")


def test_stream_keeps_the_store(spark, tmp_path):
    schema = "file_key string, source string, last_modified double, file_size long, content_hash string, error string"
    drop = tmp_path / "in"
    for i, source in enumerate(["def f(): g()\ndef g(): pass\n", "def f(): pass\n"]):
        spark.createDataFrame([("a.py", source, float(i), len(source), f"h{i}", None)], schema).coalesce(1).write.mode("append").json(str(drop))
        store = GraphStore(spark, str(tmp_path / "store"))
        q = keep_store(spark.readStream.schema(schema).json(str(drop)), store, "app").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    nodes, edges = store.read()
    assert {r.value for r in nodes.filter("array_contains(labels, 'PyCallable')").collect()} == {"a.f"}
    assert edges.filter("type = 'PY_CALLS'").count() == 0
