"""Extraction from own small sources."""

from srcgraph.operators.extract import extract, extract_module
from srcgraph.operators.relations import modules, parse_errors, relation

NESTED = '''
def f():
    class Outer:
        def m(self):
            def inner():
                return g(1)
            return inner()
    return Outer()

def g(x): return x
'''


def rows(source, name, rel="pkg/m.py", **options):
    return extract_module(source, rel, rel, **options)[name]


def test_nested_definitions_keep_their_own_calls():
    assert {c["signature"] for c in rows(NESTED, "callables")} == {"pkg.m.f", "pkg.m.f.Outer.m", "pkg.m.f.Outer.m.inner", "pkg.m.g"}
    assert [c["signature"] for c in rows(NESTED, "classes")] == ["pkg.m.f.Outer"]
    calls = {(c["caller_signature"], c["method_name"]) for c in rows(NESTED, "call_sites")}
    assert calls == {("pkg.m.f", "Outer"), ("pkg.m.f.Outer.m", "inner"), ("pkg.m.f.Outer.m.inner", "g")}


def test_the_last_of_two_definitions_wins_with_all_below_it():
    got = extract_module("class A:\n  def f(self):\n    def gone(): return h()\n  def f(self):\n    return A()\n", "m.py", "m.py")
    assert [c["signature"] for c in got["callables"]] == ["m.A.f"]
    assert [c["method_name"] for c in got["call_sites"]] == ["A"]


def test_calls_in_decorators_and_defaults_belong_to_the_enclosing_scope():
    got = rows("def f():\n  @deco(1)\n  def g(a=dflt(), *, k=kwd()) -> res(): return own()\n  class C(base(), metaclass=meta()): x = body()\n", "call_sites")
    assert {c["method_name"] for c in got if c["caller_signature"] == "pkg.m.f"} == {"deco", "dflt", "kwd", "res", "base", "meta"}
    assert {c["method_name"] for c in got if c["caller_signature"] == "pkg.m.f.g"} == {"own"}


def test_parameters_in_order_with_defaults():
    source = "def f(a, b=1, /, c: int = 2, *rest, d, e=3, **kw): pass"
    got = [(p["name"], p["type"], p["default_value"]) for p in rows(source, "parameters")]
    assert got == [("a", None, None), ("b", "int", "1"), ("c", "int", "2"), ("rest", None, None), ("d", None, None), ("e", "int", "3"), ("kw", None, None)]
    assert rows(source, "parameters", compat=True)[1]["default_value"] is None


def test_imports():
    got = [(i["module"], i["name"], i["alias"]) for i in rows("import os, a.b as ab\nfrom . import x\nfrom ..p.q import y as z\nfrom s import *\n", "imports")]
    assert got == [("os", "os", None), ("a.b", "ab", "a.b"), (".", "x", None), ("..p.q", "z", "y"), ("s", "*", None)]


def test_docstrings_and_comments():
    source = '"""M."""\nclass A:\n    """A."""\n    def f(self):\n        """"""\n# c\n'
    assert [(c["owner_id"], c["content"]) for c in rows(source, "comments") if c["is_docstring"]] == [("pkg/m.py", "M."), ("pkg.m.A", "A.")]
    assert [c["content"] for c in rows(source, "comments") if not c["is_docstring"]] == ["c"]
    assert all(c["is_docstring"] for c in rows(source, "comments", compat=True))


def test_variables_and_attributes():
    source = "X = 1\nif X:\n    Y: str = 'a'\nclass C:\n    n: int = 0\n    def f(self):\n        self.v = 1\n        def g():\n            w = 2\n"
    assert [(v["name"], v["scope"]) for v in rows(source, "variables") if v["owner_kind"] == "module"] == [("X", "module"), ("Y", "module")]
    got = {(v["owner_id"], v["name"], v["scope"]) for v in rows(source, "variables") if v["owner_kind"] == "callable"}
    assert got == {("pkg.m.C.f", "v", "class"), ("pkg.m.C.f", "w", "function"), ("pkg.m.C.f.g", "w", "function")}
    assert [(a["name"], a["type"]) for a in rows(source, "attributes")] == [("n", "int")]


def test_complexity():
    source = "def f(x):\n    for i in x:\n        if i and x or i: yield i\n    assert x\n    try: return 1\n    except E: return 2 if x else 3\n"
    assert rows(source, "callables")[0]["cyclomatic_complexity"] == 1 + 1 + 1 + 2 + 1 + 1 + 1 + 1 + 1 + 1 + 1


def test_paths_to_signatures():
    assert rows("def f(): pass", "callables", "src.py/pyx/__init__.py")[0]["signature"] == "src.py.pyx.__init__.f"
    assert rows("def f(): pass", "callables", "src/pypkg/pytest_x.py", compat=True)[0]["signature"] == "srcpkgtest_x.f"


def test_files_that_cannot_be_parsed_leave_the_others_alone(spark):
    files = [("a.py", "def f(): g()", None), ("b.py", "def (", None), ("c.py", None, "UnicodeDecodeError: x"), ("d.py", "", None), ("e.py", "def f():\r\n    return 1\r\n", None)]
    df = spark.createDataFrame(files, "file_key string, source string, error string").selectExpr("file_key", "source", "0D AS last_modified", "1L AS file_size", "'h' AS content_hash", "error")
    x = extract(df)
    assert {r.file_key for r in modules(x).collect()} == {"a.py", "d.py", "e.py"}
    assert {r.file_key for r in parse_errors(x).collect()} == {"b.py", "c.py"}
    assert {r.signature for r in relation(x, "callables").collect()} == {"a.f", "e.f"}
    assert extract(df.limit(0)).count() == 0


def test_only_what_is_asked_is_computed_and_is_the_same():
    from srcgraph import schemas

    source = NESTED + '''
class A:
    """Doc."""
    size: int = 0
    "How large."

    def f(self, x, *r, k=1):
        y = [i for i in r if i]
        return self.g(lambda q: q + x)

    def f(self): return 2
'''
    every = extract_module(source, "m.py")
    for name in schemas.FIELDS:
        drop = lambda rows: [{k: v for k, v in r.items() if k != "ord"} for r in rows]
        assert drop(extract_module(source, "m.py", only=frozenset([name]))[name]) == drop(every[name]), name
        assert not any(v for k, v in extract_module(source, "m.py", only=frozenset([name])).items() if k != name)
    assert all(r["code"] is None for r in extract_module(source, "m.py", only=frozenset(["callables"]), code=False)["callables"])
    assert [(c["owner_id"], c["content"]) for c in every["comments"] if c["owner_kind"] == "attribute"] == [("m.A.size", "How large.")]


def test_short_unparse_says_what_ast_does():
    import ast
    import inspect
    import textwrap

    from srcgraph.operators.extract import unparse

    own = "@d(1)\nasync def f(a, b: int = -1, *c, **d) -> x.y:\n    'doc'\n    g('a\\nb')(k).m(1.5)\n    if a:\n        return\n    elif b:\n        s = f'''{a}\n'''\n    t = (1,)\n    return t[0]\n"
    for source in (own, *(textwrap.dedent(inspect.getsource(m)) for m in (textwrap, inspect, ast))):
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, (ast.stmt, ast.expr)):
                assert unparse(node) == ast.unparse(node)


def test_files_are_taken_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    from srcgraph.operators import extract as E

    monkeypatch.setattr(E, "PART_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"k": list("abcde"), "source": ["x" * 4, "x" * 7, None, "x" * 30, "x"]})
    assert [p.column(0).to_pylist() for p in E._parts(batch)] == [["a", "b"], ["c", "d"], ["e"]]


def test_bodies_are_bound_only_where_their_names_are_asked_for(monkeypatch):
    from srcgraph.operators import extract as E

    bound, plain = [], E._File.bind_body
    monkeypatch.setattr(E._File, "bind_body", lambda self, scope, body: bound.append(scope.name) or plain(self, scope, body))
    source = "class A:\n    x: int = 1\ndef f(a):\n    return g(a)\n"
    extract_module(source, "m.py", only=frozenset(["classes", "callables", "imports"]))
    assert bound == ["m"]
    extract_module(source, "m.py", only=frozenset(["call_sites"]))
    assert bound == ["m", "m", "m.f"]
