"""One pass over each source file: text in, every relation's rows of that file out.

``extract_module`` parses with the standard ``ast`` and returns plain dicts; ``extract`` runs it on batches of files, one
output row a file with an array of structs for each relation, so that a relation is an ``inline`` of one column. A
Python pass can't be pruned from outside, so ``only`` names the relations that are wanted and nothing else is computed (their
rows and the order of their ``ord`` are the same). A file that can't be read or parsed gives a row with ``error`` and empty
relations.

Names are resolved here as far as one file can tell: a call's ``callee_ref`` is a dotted name, either a signature of this
file, what an import says, or a builtin; ``operators.resolve`` joins it to the other files. ``flows`` are the facts of
assignment, call, return and attribute access for points-to analysis.

Where observed behaviour and documented intent differ, the default is the intent; ``compat=True`` gives the observed: paths
lose every '.py', no '#' comments, positional-only defaults are null, a callee is looked up at the leftmost name.
"""

from __future__ import annotations

import ast
import builtins
import gc
import io
import re
import tokenize
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from srcgraph import schemas
from srcgraph.runtime import small_batches

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BUILTINS = frozenset(dir(builtins))
#: Statements that bind names, and what has a scope of its own.
_BINDERS = frozenset((*_DEFS, ast.ClassDef, ast.Lambda, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.Assign, ast.AnnAssign))
_LITERALS = {ast.List: "list", ast.ListComp: "list", ast.Dict: "dict", ast.DictComp: "dict", ast.Set: "set", ast.SetComp: "set", ast.Tuple: "tuple", ast.JoinedStr: "str", ast.Compare: "bool"}
#: What a file's text has if it imports all names of a module.
_STAR = re.compile(r"\bimport[\s\\]*\*")


def dotted_path(rel: str, compat: bool = False) -> str:
    """The name that signatures in a file begin with."""
    dotted = rel.replace("/", ".")
    return dotted.replace(".py", "") if compat else dotted.removesuffix(".py")


def import_path(rel: str) -> str:
    """The name that imports use for a file: a package's for its ``__init__``."""
    dotted = rel.removesuffix(".py").replace("/", ".")
    return dotted.removesuffix(".__init__") if dotted != "__init__" else ""


#: Fields that hold no nodes, or only those of contexts and operators, which nothing here looks at.
_BARE = frozenset("ctx op ops id attr level kind type_comment simple is_async conversion".split())
_FIELDS: dict[type, tuple[str, ...]] = {ast.Constant: ()}
_INNER = ("body", "handlers", "orelse", "finalbody", "cases")
_STATEMENTS: dict[type, tuple[str, ...]] = {}


def children(node: ast.AST) -> list[ast.AST]:
    """``ast.iter_child_nodes`` without contexts and operators."""
    kind = node.__class__
    fields = _FIELDS.get(kind)
    if fields is None:
        fields = _FIELDS[kind] = tuple(f for f in kind._fields if f not in _BARE)
    out: list[ast.AST] = []
    for f in fields:
        v = getattr(node, f, None)
        if v.__class__ is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


def walk(node: ast.AST) -> list[ast.AST]:
    """``ast.walk`` without contexts and operators."""
    out = [node]
    for n in out:
        if n.__class__ is not ast.Name and n.__class__ is not ast.Constant:
            out += children(n)
    return out


def _inner(node: ast.AST) -> tuple[str, ...]:
    """The fields that hold a node's statements."""
    kind = node.__class__
    fields = _STATEMENTS.get(kind)
    if fields is None:
        fields = _STATEMENTS[kind] = tuple(f for f in kind._fields if f in _INNER) if issubclass(kind, (ast.stmt, ast.mod, ast.ExceptHandler, ast.match_case)) else ()
    return fields


def statements(node: ast.AST) -> list[ast.AST]:
    """The statements, handlers and cases of ``ast.walk``, in its order: none is inside an expression."""
    out = [node]
    for n in out:
        for f in _inner(n):
            out += getattr(n, f)
    return out


def own_scope_calls(fn: ast.AST) -> list[ast.Call]:
    """Calls that run in a function's own scope, in pre-order: not those of nested bodies, but those of nested decorators, defaults, annotations of results, bases and class keywords."""
    out, todo = [], fn.body[::-1]
    while todo:
        node = todo.pop()
        kind = node.__class__
        if kind is ast.Name or kind is ast.Constant:
            continue
        if kind is ast.Call:
            out.append(node)
            inside = children(node)
        elif isinstance(node, _DEFS):
            a = node.args
            inside = [*node.decorator_list, *a.defaults, *(d for d in a.kw_defaults if d), *([node.returns] if node.returns else [])]
        elif kind is ast.ClassDef:
            inside = [*node.decorator_list, *node.bases, *(k.value for k in node.keywords)]
        else:
            inside = children(node)
        todo += inside[::-1]
    return out


#: Nodes that count one each.
_ONE = frozenset(getattr(ast, kind) for kind in "If IfExp For While With Try ExceptHandler Assert Return Yield YieldFrom".split())


def complexity(nodes: list[ast.AST]) -> int:
    """Of a callable's nodes."""
    kinds = [n.__class__ for n in nodes]
    return 1 + sum(k in _ONE for k in kinds) + (sum(len(n.values) - 1 for n in nodes if n.__class__ is ast.BoolOp) if ast.BoolOp in kinds else 0)


def _span(node: ast.AST, last: ast.AST | None = None) -> dict:
    end = last if last is not None else node
    return {"start_line": getattr(node, "lineno", -1), "end_line": getattr(end, "end_lineno", -1), "start_column": getattr(node, "col_offset", -1), "end_column": getattr(end, "end_col_offset", -1)}


def _plain(e: ast.expr) -> str | None:
    """``ast.unparse`` of names, attributes of names, small constants, and calls of and with such; None for the rest."""
    kind = e.__class__
    if kind is ast.Name:
        return e.id
    if kind is ast.Constant:
        v = e.value
        return repr(v) if v.__class__ in (int, bool) or v is None or v.__class__ is str and e.kind is None else None
    if kind is ast.Attribute:
        of = _plain(e.value) if e.value.__class__ is not ast.Constant else None
        return f"{of}.{e.attr}" if of is not None else None
    if kind is ast.Call and not e.keywords:
        parts = [_plain(e.func) if e.func.__class__ is not ast.Constant else None, *map(_plain, e.args)]
        return f"{parts[0]}({', '.join(parts[1:])})" if None not in parts else None
    return None


def unparse(node: ast.AST) -> str:
    """``ast.unparse``, by a shorter way for what most code is made of."""
    kind = node.__class__
    if kind in _DEFS:
        return _definition(node)
    if kind is ast.Expr:
        text = _plain(node.value)
    elif kind is ast.Return:
        value = "" if node.value is None else _plain(node.value)
        text = f"return {value}" if value else None if value is None else "return"
    elif kind is ast.Assign and len(node.targets) == 1 and node.type_comment is None:
        target, value = _plain(node.targets[0]), _plain(node.value)
        text = f"{target} = {value}" if target is not None and value is not None else None
    else:
        text = _plain(node)
    return text if text is not None else ast.unparse(node)


def _definition(node: ast.FunctionDef) -> str:
    """A function's statements one by one: whatever could hold a line break within a literal is left to ``ast.unparse``."""
    first = node.body[0]
    doc = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    rest = node.body[doc:]
    if not rest or getattr(node, "type_comment", None) is not None:
        return ast.unparse(node)
    lines = []
    for s in rest:
        text = unparse(s)
        if "\n" in text:
            if '\"\"\"' in text or "'''" in text or isinstance(s, (*_DEFS, ast.ClassDef)):
                return ast.unparse(node)
            lines += ["    " + x if x else x for x in text.split("\n")]
        elif isinstance(s, (*_DEFS, ast.ClassDef)):
            return ast.unparse(node)
        else:
            lines.append("    " + text)
    head = {f: getattr(node, f) for f in node._fields} | {"body": [first] if doc else [ast.Pass()]}
    text = ast.unparse(node.__class__(**head, lineno=node.lineno))
    return "\n".join([text if doc else text.removesuffix("\n    pass"), *lines])


def _text(node: ast.AST | None) -> str | None:
    return unparse(node) if node is not None else None


class _Scope:
    """A lexical scope: what its names are bound to, as far as can be told."""

    def __init__(self, kind: str, name: str, outer: _Scope | None, owner_class: str | None = None):
        self.kind, self.name, self.outer, self.owner_class = kind, name, outer, owner_class
        self._bound: dict[str, tuple[str, str | None]] = {}
        self.globals: set[str] = set()
        self.todo: Callable[[], None] | None = None  # what binds the names, once one is asked for

    @property
    def bound(self) -> dict[str, tuple[str, str | None]]:
        """name -> (kind of reference, dotted name)"""
        if self.todo is not None:
            todo, self.todo = self.todo, None
            todo()
        return self._bound

    def find(self, name: str) -> tuple[_Scope, tuple[str, str | None]] | None:
        s: _Scope | None = self
        first = True
        while s is not None:
            if (first or s.kind != "class") and name in s.bound and name not in s.globals:
                return s, s.bound[name]
            first = False
            s = s.outer
        return None

    def pointer(self, name: str) -> str:
        got = self.find(name)
        return f"{got[0].name if got else 'builtins'}::{name}"


class _File:
    def __init__(self, source: str, file_key: str, rel: str, compat: bool, only: frozenset[str] | None = None, code: bool = True):
        self.with_code = code
        self.only = only if only is not None else frozenset(schemas.FIELDS)
        self.tree = ast.parse(source, filename=rel)
        self.source, self.file_key, self.rel, self.compat = source, file_key, rel, compat
        self.base, self.dotted = dotted_path(rel, compat), import_path(rel)
        self.package = self.dotted if rel.endswith("__init__.py") else self.dotted.rpartition(".")[0]
        self.out: dict[str, list[dict]] = {name: [] for name in schemas.FIELDS}
        self.order = 0
        self.kept: list[tuple[int, int, str, str, str]] = []  # ord, depth, relation, signature, parent
        self.classes: dict[str, ast.ClassDef] = {}
        self.marks: list[tuple[int, int, str]] = []
        if not compat and "comments" in self.only and "#" in source:
            try:
                self.marks = [(*t.start, t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
            except (tokenize.TokenError, IndentationError):
                pass

    def add(self, relation: str, **row) -> dict:
        if relation in self.only:
            self.out[relation].append(row)
        return row

    def code(self, node: ast.AST, relation: str) -> str | None:
        return unparse(node).strip() if self.with_code and relation in self.only else None

    def next(self) -> int:
        self.order += 1
        return self.order

    def defined(self, kind: str, sig: str, parent: str, depth: int) -> int:
        """The place of a definition."""
        self.kept.append((self.next(), depth, kind, sig, parent))
        return self.order

    # scopes

    def absolute(self, module: str | None, level: int) -> str:
        if not level:
            return module or ""
        parts = self.package.split(".") if self.package else []
        parts = parts[: len(parts) - (level - 1)] if level > 1 else parts
        return ".".join([*parts, *([module] if module else [])])

    def bind_body(self, scope: _Scope, body: list[ast.stmt]) -> None:
        """Bindings made by a scope's own statements."""
        todo: list[ast.AST] = body[::-1]
        assigned: list[tuple[str, ast.expr | None]] = []
        while todo:
            node = todo.pop()
            kind = node.__class__
            if kind is ast.Name:
                if isinstance(node.ctx, ast.Store):
                    scope.bound.setdefault(node.id, ("variable", None))
                continue
            if kind not in _BINDERS:
                todo += children(node)[::-1]
                continue
            if isinstance(node, _DEFS):
                scope.bound[node.name] = ("function", f"{scope.name}.{node.name}")
                continue
            if isinstance(node, ast.ClassDef):
                scope.bound[node.name] = ("class", f"{scope.name}.{node.name}")
                continue
            if isinstance(node, ast.Lambda):
                continue
            if isinstance(node, ast.Import):
                for a in node.names:
                    scope.bound[a.asname or a.name.partition(".")[0]] = ("import", a.name if a.asname else a.name.partition(".")[0])
            elif isinstance(node, ast.ImportFrom):
                at = self.absolute(node.module, node.level)
                for a in node.names:
                    scope.bound[a.asname or a.name] = ("import", f"{at}.{a.name}" if at else a.name)
            elif isinstance(node, (ast.Global, ast.Nonlocal)):
                scope.globals |= set(node.names)
            elif isinstance(node, ast.Assign):
                for t in node.targets:
                    if isinstance(t, ast.Name):
                        assigned.append((t.id, node.value))
                    else:
                        assigned += [(x.id, None) for x in ast.walk(t) if isinstance(getattr(x, "ctx", None), ast.Store) and isinstance(x, ast.Name)]
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                assigned.append((node.target.id, node.value if node.value is not None else ast.Call(node.annotation, [], [])))
            todo += children(node)[::-1]
        for name, value in assigned:
            if scope.bound.get(name, ("variable", None))[0] == "variable":
                scope.bound[name] = ("variable", None)
        for name, value in assigned:
            if scope.bound[name][0] == "variable" and value is not None:
                scope.bound[name] = self.value_of(scope, value)

    def bind(self, scope: _Scope, body: list[ast.stmt], first: Callable[[], None] | None = None) -> None:
        """``bind_body`` after ``first``, when a name is asked for; at once where flows add names to scopes."""

        def todo() -> None:
            if first is not None:
                first()
            self.bind_body(scope, body)

        scope.todo = todo
        if "flows" in self.only:
            scope.bound  # noqa: B018

    def value_of(self, scope: _Scope, value: ast.expr) -> tuple[str, str | None]:
        """What a variable holds: an instance of a class, or another name for something."""
        if isinstance(value, ast.Await):
            value = value.value
        if isinstance(value, ast.Call):
            kind, ref = self.refer(scope, value.func)
            return ("instance", ref) if ref and kind in ("class", "import") else ("variable", None)
        if isinstance(value, (ast.Name, ast.Attribute)):
            kind, ref = self.refer(scope, value)
            return (kind, ref) if ref else ("variable", None)
        return "variable", None

    def refer(self, scope: _Scope, e: ast.expr) -> tuple[str, str | None]:
        """(kind, dotted name) of what an expression names; (unknown, None) where this file can't tell."""
        if isinstance(e, ast.Name):
            got = scope.find(e.id)
            if got is not None:
                return got[1]
            return ("builtin", f"builtins.{e.id}") if e.id in _BUILTINS else ("unknown", None)
        if isinstance(e, ast.Attribute):
            if isinstance(e.value, ast.Call) and isinstance(e.value.func, ast.Name) and e.value.func.id == "super":
                return ("super", f"{scope.owner_class}.{e.attr}") if scope.owner_class else ("unknown", None)
            kind, ref = self.refer(scope, e.value)
            if ref is None or kind in ("function", "unknown"):
                return "unknown", None
            if kind in ("instance", "self", "member"):
                return ("member", f"{ref}.{e.attr}") if kind != "member" else ("unknown", None)
            return (kind if kind != "class" else "member"), f"{ref}.{e.attr}"
        if isinstance(e, ast.Call):
            kind, ref = self.refer(scope, e.func)
            return ("instance", ref) if kind == "class" or (kind == "import" and ref and ref.rpartition(".")[2][:1].isupper()) else ("unknown", None)
        return "unknown", None

    # relations

    def run(self) -> dict[str, list[dict]]:
        scope = _Scope("module", self.base, None)
        self.bind_body(scope, self.tree.body)
        self.docs("module", self.file_key, self.tree)
        if "imports" in self.only:
            self.imports()
        if "variables" in self.only:
            self.module_variables(scope)
        if "bindings" in self.only:
            for name, (kind, ref) in scope.bound.items():
                if kind == "import":
                    self.add("bindings", dotted=f"{self.dotted}.{name}" if self.dotted else name, target=ref)
            for star in (n for n in (statements(self.tree) if _STAR.search(self.source) else ()) if isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names)):
                self.add("bindings", dotted=f"{self.dotted}.*", target=self.absolute(star.module, star.level) + ".*")
        if self.only <= {"imports", "bindings"}:
            return self.out
        self.definitions(self.tree, scope, "module", self.file_key, 0)
        if "flows" in self.only:
            self.flow_body(scope, self.tree.body, None)
        self.keep_last()
        return self.out

    def docs(self, kind: str, owner: str, node: ast.AST) -> None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) and first.value.value:
            self.add("comments", owner_kind=kind, owner_id=owner, ord=self.next(), content=first.value.value, **_span(first.value), is_docstring=True)
        if self.marks:
            lo, hi = getattr(node, "lineno", 1), getattr(node, "end_lineno", 1 << 30)
            inner = [(n.lineno, n.end_lineno) for n in ast.iter_child_nodes(node) if isinstance(n, (*_DEFS, ast.ClassDef))]
            for line, column, text in self.marks:
                if lo <= line <= hi and not any(a <= line <= b for a, b in inner):
                    self.add("comments", owner_kind=kind, owner_id=owner, ord=self.next(), content=text.lstrip("#").strip(), start_line=line, end_line=line, start_column=column, end_column=column + len(text), is_docstring=False)

    def imports(self) -> None:
        for node in statements(self.tree):
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                for a in node.names:
                    module = a.name if isinstance(node, ast.Import) else "." * node.level + (node.module or "")
                    self.add("imports", ord=self.next(), module=module, name=a.asname or a.name, alias=a.name if a.asname else None, **_span(node))

    def variable(self, scope: _Scope, kind: str, owner: str, target: ast.expr, node: ast.stmt, where: str) -> None:
        name = target.id if isinstance(target, ast.Name) else target.attr
        if isinstance(node, ast.AnnAssign):
            type_ = _text(node.annotation)
        else:
            type_ = self.type_of(scope, node.value)
        span = _span(target) | {"end_line": getattr(node, "end_lineno", -1)}
        self.add("variables", owner_kind=kind, owner_id=owner, ord=self.next(), name=name, type=type_, initializer=_text(node.value), scope=where, **span)

    def module_variables(self, scope: _Scope) -> None:
        level: list[ast.AST] = [self.tree]
        while level:  # breadth first, not into definitions
            below: list[ast.AST] = []
            for node in level:
                for child in (c for f in _inner(node) for c in getattr(node, f) if not isinstance(c, (*_DEFS, ast.ClassDef))):
                    targets = child.targets if isinstance(child, ast.Assign) else [child.target] if isinstance(child, ast.AnnAssign) else []
                    for t in targets:
                        if isinstance(t, ast.Name):
                            self.variable(scope, "module", self.file_key, t, child, "module")
                    below.append(child)
            level = below

    def type_of(self, scope: _Scope, e: ast.expr | None) -> str | None:
        """The short name of an expression's type, where it is plain to see."""
        if isinstance(e, ast.Constant):
            return type(e.value).__name__
        if e.__class__ in _LITERALS:
            return _LITERALS[e.__class__]
        if isinstance(e, ast.Call):
            kind, ref = self.refer(scope, e.func)
            return ref.rpartition(".")[2] if ref and (kind == "class" or kind == "builtin" and isinstance(getattr(builtins, ref[9:], None), type)) else None
        if isinstance(e, (ast.Name, ast.Attribute)):
            kind, ref = self.refer(scope, e)
            return ref.rpartition(".")[2] if ref and kind in ("instance", "class", "function", "self") else None
        return None

    def definitions(self, node: ast.AST, scope: _Scope, kind: str, parent: str, depth: int) -> None:
        """Direct children only: what is defined under an ``if`` or ``try`` has no row."""
        for child in node.body:
            if isinstance(child, ast.ClassDef):
                self.class_(child, scope, kind, parent, depth)
            elif isinstance(child, _DEFS):
                self.callable_(child, scope, kind, parent, depth)

    def class_(self, node: ast.ClassDef, scope: _Scope, kind: str, parent: str, depth: int) -> None:
        sig = f"{scope.name}.{node.name}"
        refs = [self.refer(scope, b)[1] for b in node.bases]
        self.classes[sig] = node
        self.add("classes", ord=self.defined("classes", sig, parent, depth), signature=sig, name=node.name, parent_kind=kind, parent_id=parent, depth=depth, base_classes=[unparse(b) for b in node.bases], base_refs=refs, code=self.code(node, "classes"), start_line=node.lineno, end_line=node.end_lineno)
        self.docs("class", sig, node)
        inner = _Scope("class", sig, scope, sig)
        self.bind(inner, node.body)
        found: dict[str, dict] = {}
        for stmt in node.body:
            for t in stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target] if isinstance(stmt, ast.AnnAssign) else []:
                if not isinstance(t, ast.Name):
                    continue
                type_ = _text(stmt.annotation) if isinstance(stmt, ast.AnnAssign) else self.type_of(inner, stmt.value)
                found[t.id] = {"name": t.id, "type": type_, "start_line": t.lineno, "end_line": stmt.end_lineno}
                if t.id == "__slots__" and not self.compat and hasattr(stmt.value, "elts"):
                    for slot in stmt.value.elts:
                        if isinstance(slot, ast.Constant) and isinstance(slot.value, str):
                            found[slot.value] = {"name": slot.value, "type": None, "start_line": slot.lineno, "end_line": slot.end_lineno}
        for row in found.values():
            self.add("attributes", class_signature=sig, ord=self.next(), **row)
        for stmt, text in zip(node.body, node.body[1:]) if not self.compat else ():
            if isinstance(stmt, (ast.Assign, ast.AnnAssign)) and isinstance(text, ast.Expr) and isinstance(text.value, ast.Constant) and isinstance(text.value.value, str) and text.value.value:
                for t in stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target]:
                    if isinstance(t, ast.Name):
                        self.add("comments", owner_kind="attribute", owner_id=f"{sig}.{t.id}", ord=self.next(), content=text.value.value, **_span(text.value), is_docstring=True)
        if "flows" in self.only:
            self.add("flows", kind="class", a=scope.pointer(node.name), b=sig, c=None, n=0)
            for i, b in enumerate(node.bases):
                self.add("flows", kind="base", a=sig, b=self.flow(scope, b), c=None, n=i)
        self.definitions(node, inner, "class", sig, depth + 1)
        if "flows" not in self.only:
            return
        self.flow_body(inner, node.body, None)
        for name in inner.bound:
            self.add("flows", kind="member", a=sig, b=f"{sig}::{name}", c=name, n=0)
        self.decorate(scope, node)

    def callable_(self, node: ast.FunctionDef, scope: _Scope, kind: str, parent: str, depth: int) -> None:
        sig = f"{scope.name}.{node.name}"
        cls = scope.name if scope.kind == "class" else None
        nodes = walk(node) if self.only & {"callables", "accessed_symbols"} else []
        self.add("callables", ord=self.defined("callables", sig, parent, depth), signature=sig, name=node.name, path=self.file_key, parent_kind=kind, parent_id=parent, depth=depth, decorators=[unparse(d) for d in node.decorator_list], return_type=_text(node.returns), code=self.code(node, "callables"), start_line=node.lineno, end_line=node.end_lineno, code_start_line=node.body[0].lineno, cyclomatic_complexity=complexity(nodes))
        self.docs("callable", sig, node)
        inner = _Scope("function", sig, scope, cls or scope.owner_class)
        if self.only & {"parameters", "flows"}:
            self.parameters(node, inner, sig, cls, scope)
            self.bind(inner, node.body)
        else:
            self.bind(inner, node.body, lambda: self.parameters(node, inner, sig, cls, scope))
        if "accessed_symbols" in self.only:
            self.symbols(nodes, inner, sig)
        if "call_sites" in self.only:
            self.sites(node, inner, sig)
        for n in statements(node) if "variables" in self.only else ():
            for t in n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []:
                if isinstance(t, ast.Name):
                    self.variable(inner, "callable", sig, t, n, "function")
                elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                    self.variable(inner, "callable", sig, t, n, "class")
        if "flows" not in self.only:
            self.definitions(node, inner, "callable", sig, depth + 1)
            return
        names = {unparse(d) for d in node.decorator_list}
        how = 1 if "staticmethod" in names else 2 if "classmethod" in names or node.name in ("__init_subclass__", "__class_getitem__") else 3 if "property" in names else 0
        self.add("flows", kind="function", a=scope.pointer(node.name), b=sig, c=cls, n=how)
        self.definitions(node, inner, "callable", sig, depth + 1)
        self.flow_body(inner, node.body, sig)
        self.decorate(scope, node)

    def parameters(self, node: ast.FunctionDef, inner: _Scope, sig: str, cls: str | None, outer: _Scope) -> None:
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        defaults: list[ast.expr | None] = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        if self.compat:
            defaults[: len(a.posonlyargs)] = [None] * len(a.posonlyargs)
        rows = [*zip(plain, defaults), *([(a.vararg, None)] if a.vararg else []), *zip(a.kwonlyargs, a.kw_defaults), *([(a.kwarg, None)] if a.kwarg else [])]
        for i, (p, default) in enumerate(rows):
            first = i == 0 and cls is not None and p in plain and not any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
            if p.annotation is not None:
                type_ = unparse(p.annotation)
                kind, ref = self.refer(outer, p.annotation)
                inner.bound[p.arg] = ("instance", ref) if ref and kind in ("class", "import") else ("parameter", None)
            elif first or p.arg in ("self", "cls") and cls is not None:
                type_ = cls.rpartition(".")[2]
                inner.bound[p.arg] = ("class", cls) if p.arg == "cls" else ("self", cls)
            else:
                type_ = self.type_of(outer, default) if default is not None else None
                inner.bound[p.arg] = ("parameter", None)
            if "parameters" in self.only:
                self.add("parameters", callable_signature=sig, ord=i, name=p.arg, type=type_, default_value=_text(default), **_span(p))
            if "flows" not in self.only:
                continue
            where = "*" if p is a.vararg else "**" if p is a.kwarg else p.arg
            self.add("flows", kind="param", a=sig, b=f"{sig}::{p.arg}", c=where, n=i if p in plain else -1)
            if default is not None:
                self.add("flows", kind="assign", a=f"{sig}::{p.arg}", b=self.flow(outer, default), c=None, n=0)

    def symbols(self, nodes: list[ast.AST], scope: _Scope, sig: str) -> None:
        kinds = {"function": "function", "class": "class", "parameter": "parameter", "self": "parameter", "import": "module", "builtin": "function"}
        for n in nodes:
            if n.__class__ is ast.Name and isinstance(n.ctx, ast.Load):
                kind, ref = self.refer(scope, n)
                k = kinds.get(kind, "variable")
                if kind == "builtin":
                    k = "class" if isinstance(getattr(builtins, (ref or "").rpartition(".")[2], None), type) else "function"
                self.add("accessed_symbols", callable_signature=sig, ord=self.next(), name=n.id, scope="global" if k == "module" else "local", kind=k, type=ref.rpartition(".")[2] if ref else None, qualified_name=ref, is_builtin=n.id in _BUILTINS, lineno=n.lineno, col_offset=n.col_offset)

    def sites(self, node: ast.AST, scope: _Scope, sig: str) -> None:
        for call in own_scope_calls(node):
            f = call.func
            at: ast.expr = f
            if self.compat:
                while isinstance(at, (ast.Attribute, ast.Call, ast.Subscript)):
                    at = at.func if isinstance(at, ast.Call) else at.value
            kind, ref = self.refer(scope, at)
            attr = isinstance(f, ast.Attribute)
            self.add(
                "call_sites",
                caller_signature=sig,
                ord=self.next(),
                method_name=f.attr if attr else f.id if isinstance(f, ast.Name) else "<unknown>",
                receiver_expr=unparse(f.value) if attr else None,
                receiver_type=self.type_of(scope, f.value) if attr else None,
                argument_types=[self.type_of(scope, x) or type(x).__name__ for x in call.args],
                return_type=self.type_of(scope, call),
                callee_ref=ref,
                ref_kind=kind,
                start_line=call.lineno,
                start_column=call.col_offset,
                end_line=call.end_lineno,
                end_column=call.end_col_offset,
            )

    # flows

    def temp(self, node: ast.AST, what: str) -> str:
        return f"{self.base}#{node.lineno}:{node.col_offset}-{node.end_lineno}:{node.end_col_offset}::{what}"

    def assign(self, target: str, value: str | None) -> None:
        if value is not None:
            self.add("flows", kind="assign", a=target, b=value, c=None, n=0)

    def flow(self, scope: _Scope, e: ast.expr | None) -> str | None:
        """The pointer that holds an expression's value; adds the facts that make it up."""
        if e is None:
            return None
        if isinstance(e, ast.Name):
            got = scope.find(e.id)
            p = scope.pointer(e.id)
            if got is not None and got[1][0] == "import":
                self.add("flows", kind="import", a=p, b=got[1][1], c=None, n=0)
            return p
        if isinstance(e, ast.Attribute):
            p = self.temp(e, "attr")
            if isinstance(e.value, ast.Call) and isinstance(e.value.func, ast.Name) and e.value.func.id == "super":
                if scope.owner_class:
                    self.add("flows", kind="super", a=p, b=scope.owner_class, c=e.attr, n=0)
                self.calls(scope, e.value)
                return p
            self.add("flows", kind="load", a=p, b=self.flow(scope, e.value), c=e.attr, n=0)
            return p
        if isinstance(e, ast.Call):
            return self.calls(scope, e)
        if isinstance(e, ast.Lambda):
            sig = f"{scope.name}.<lambda{e.lineno}:{e.col_offset}>"
            inner = _Scope("function", sig, scope, scope.owner_class)
            for i, a in enumerate([*e.args.posonlyargs, *e.args.args]):
                inner.bound[a.arg] = ("parameter", None)
                self.add("flows", kind="param", a=sig, b=f"{sig}::{a.arg}", c=a.arg, n=i)
            p = self.temp(e, "lambda")
            self.add("flows", kind="function", a=p, b=sig, c=None, n=0)
            self.add("flows", kind="inside", a=sig, b=scope.name, c=None, n=0)
            self.assign(f"{sig}::<ret>", self.flow(inner, e.body))
            return p
        p = self.temp(e, "value") if hasattr(e, "lineno") else None
        if isinstance(e, (ast.Await, ast.Starred, ast.NamedExpr, ast.YieldFrom)):
            v = self.flow(scope, e.value)
            if isinstance(e, ast.NamedExpr):
                self.assign(scope.pointer(e.target.id), v)
            return v
        if isinstance(e, (ast.IfExp, ast.BoolOp)):
            for x in (e.body, e.orelse) if isinstance(e, ast.IfExp) else e.values:
                self.assign(p, self.flow(scope, x))
            if isinstance(e, ast.IfExp):
                self.flow(scope, e.test)
            return p
        if isinstance(e, (ast.List, ast.Tuple, ast.Set, ast.Dict)):
            for x in e.elts if not isinstance(e, ast.Dict) else e.values:
                self.assign(p, self.flow(scope, x))
            return p
        if isinstance(e, ast.Subscript):
            v = self.flow(scope, e.value)
            self.flow(scope, e.slice)
            return v
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            for g in e.generators:
                self.store(scope, g.target, self.flow(scope, g.iter))
                for i in g.ifs:
                    self.flow(scope, i)
            self.assign(p, self.flow(scope, e.value if isinstance(e, ast.DictComp) else e.elt))
            return p
        if isinstance(e, ast.Yield):
            return self.flow(scope, e.value)
        for x in ast.iter_child_nodes(e):
            if isinstance(x, ast.expr):
                self.flow(scope, x)
            elif isinstance(x, ast.FormattedValue):
                self.flow(scope, x.value)
        return p

    def calls(self, scope: _Scope, e: ast.Call) -> str:
        call = self.temp(e, "call")
        self.add("flows", kind="call", a=call, b=self.flow(scope, e.func), c=scope.name, n=0 if scope.kind == "function" else 1)
        for i, x in enumerate(e.args):
            star = isinstance(x, ast.Starred)
            self.add("flows", kind="arg", a=call, b=self.flow(scope, x), c="*" if star else "", n=i)
        for k in e.keywords:
            self.add("flows", kind="arg", a=call, b=self.flow(scope, k.value), c=k.arg or "**", n=-1)
        return call

    def store(self, scope: _Scope, target: ast.expr, value: str | None) -> None:
        if isinstance(target, ast.Name):
            if target.id not in scope.bound:
                scope.bound[target.id] = ("variable", None)
            self.assign(scope.pointer(target.id), value)
        elif isinstance(target, ast.Attribute):
            self.add("flows", kind="store", a=self.flow(scope, target.value), b=value, c=target.attr, n=0)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.store(scope, t, value)
        elif isinstance(target, ast.Starred):
            self.store(scope, target.value, value)
        elif isinstance(target, ast.Subscript):
            base = self.flow(scope, target.value)
            if base is not None:
                self.assign(base, value)

    def flow_body(self, scope: _Scope, body: list[ast.stmt], fn: str | None) -> None:
        for s in body:
            if isinstance(s, (*_DEFS, ast.ClassDef)):
                continue
            if isinstance(s, ast.Assign):
                v = self.flow(scope, s.value)
                for t in s.targets:
                    self.store(scope, t, v)
            elif isinstance(s, (ast.AnnAssign, ast.AugAssign)):
                self.store(scope, s.target, self.flow(scope, s.value))
            elif isinstance(s, ast.Return) and fn is not None:
                self.assign(f"{fn}::<ret>", self.flow(scope, s.value))
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                self.store(scope, s.target, self.flow(scope, s.iter))
            else:
                if isinstance(s, (ast.With, ast.AsyncWith)):
                    for i in s.items:
                        v = self.flow(scope, i.context_expr)
                        if i.optional_vars is not None:
                            self.store(scope, i.optional_vars, v)
                else:
                    for e in ast.iter_child_nodes(s):
                        if isinstance(e, ast.expr):
                            v = self.flow(scope, e)
                            if fn is not None and isinstance(e, (ast.Yield, ast.YieldFrom)):
                                self.assign(f"{fn}::<ret>", v)
            for part in ("body", "orelse", "finalbody"):
                inside = getattr(s, part, None)
                if isinstance(inside, list):
                    self.flow_body(scope, inside, fn)
            for h in getattr(s, "handlers", []):
                self.flow_body(scope, h.body, fn)
            for case in getattr(s, "cases", []):
                self.flow_body(scope, case.body, fn)

    def decorate(self, scope: _Scope, node: ast.FunctionDef | ast.ClassDef) -> None:
        """A decorator is a call with what it decorates, and its result takes the name."""
        p = scope.pointer(node.name)
        for d in reversed(node.decorator_list):
            call = self.temp(d, "decorated")
            self.add("flows", kind="call", a=call, b=self.flow(scope, d), c=scope.name, n=0 if scope.kind == "function" else 1)
            self.add("flows", kind="arg", a=call, b=p, c="", n=0)
            self.assign(p, call)

    # definitions of one name

    def keep_last(self) -> None:
        """Of definitions of one kind and name in one scope the last stays; the others go with all that they hold."""
        seen = sorted(self.kept, key=lambda d: d[0])
        last = {(kind, sig, parent): at for at, _, kind, sig, parent in seen}
        gone = {at for at, _, kind, sig, parent in seen if last[kind, sig, parent] != at}
        if not gone:
            return
        # rows were added in pre-order: a definition's rows lie between its ord and the next one that isn't deeper
        cut = []
        for i, (at, depth, *_) in enumerate(seen):
            if at in gone:
                end = next((o for o, d, *_ in seen[i + 1 :] if d <= depth), 1 << 60)
                cut.append((at, end))
        inside = lambda o: any(a <= o < b for a, b in cut)
        dropped = {sig for at, _, kind, sig, _ in seen if kind == "callables" and inside(at)}
        self.out["parameters"] = self.last_parameters(dropped)
        for relation in ("classes", "callables", "comments", "call_sites", "accessed_symbols", "variables", "attributes"):
            self.out[relation] = [r for r in self.out[relation] if not inside(r["ord"])]

    def last_parameters(self, dropped: set[str]) -> list[dict]:
        """Parameters have an ord of their own: of several runs for one signature the last counts."""
        runs: dict[str, list[dict]] = {}
        for r in self.out["parameters"]:
            if r["ord"] == 0 and r["callable_signature"] in dropped:
                runs[r["callable_signature"]] = []
            runs.setdefault(r["callable_signature"], []).append(r)
        return [r for rows in runs.values() for r in rows]


def extract_module(source: str, file_key: str, rel: str | None = None, compat: bool = False, only: frozenset[str] | None = None, code: bool = True) -> dict[str, list[dict]]:
    """All relations' rows of one file, or those of ``only``; raises SyntaxError."""
    return _File(source, file_key, rel or file_key, compat, only, code).run()


def extract(files: DataFrame, root: str = "", compat: bool = False, only: Iterable[str] | None = None, code: bool = True) -> DataFrame:
    """``source_files`` -> one row a file with a column for each relation. ``root``: what to take off file keys for paths; ``only``: the relations that are wanted; without ``code``, that of classes and callables is null."""
    names = [n for n in schemas.FIELDS if only is None or n in set(only)]
    wanted = frozenset(names)
    schema = schemas.struct(", ".join([schemas.MODULE, *(schemas.column(n) for n in names)]))
    arrow = to_arrow_schema(schema)
    head = ["file_key", "source", "last_modified", "file_size", "content_hash", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                yield part(b)

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, sources, *_, errors = (c.to_pylist() for c in b.columns)
        stems, dotted, failed, found = [], [], [], {n: [] for n in names}
        for key, source, error in zip(keys, sources, errors):
            rel = key[len(root) :].lstrip("/") if root and key.startswith(root) else key.lstrip("/")
            got: dict[str, list[dict]] = {}
            if error is None and source is not None:
                on = gc.isenabled()
                gc.disable()  # trees hold no circles, and are gone over again and again while they grow
                try:
                    got = extract_module(source, key, rel, compat, wanted, code)
                except (SyntaxError, ValueError, RecursionError) as e:
                    error = f"{type(e).__name__}: {e}"
                finally:
                    if on:
                        gc.enable()
            stems.append(rel.rpartition("/")[2].removesuffix(".py"))
            dotted.append(import_path(rel))
            failed.append(error)
            for n in names:
                found[n].append(got.get(n, []))
        own = [pa.array(stems, pa.string()), pa.array(dotted, pa.string()), b.column(4), b.column(2), b.column(3), pa.array(failed, pa.string())]
        return pa.RecordBatch.from_arrays([b.column(0), *own, *(_lists(found[n], arrow.field(n).type) for n in names)], schema=arrow)

    small_batches(files.sparkSession)
    return files.select(*head).mapInArrow(run, schema)


#: Bytes of source whose rows are held at once, beside those of the file that passes it.
PART_BYTES = 1 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of files as slices of about ``PART_BYTES`` of source."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= PART_BYTES or i + 1 == len(sizes):
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def _lists(rows: list[list[dict]], kind: pa.ListType) -> pa.ListArray:
    """Each file's rows as one list, column by column."""
    offsets, n = [0], 0
    for r in rows:
        n += len(r)
        offsets.append(n)
    every = list(chain.from_iterable(rows))
    fields = list(kind.value_type)
    columns = [pa.array([r[f.name] for r in every], f.type) for f in fields]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields), type=kind)
