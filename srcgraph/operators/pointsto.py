"""Level-2 call graph: points-to analysis over assignment flows (after PyCG, ICSE 2021).

Pointers are variables, parameters, results, and attributes of classes; values are functions, bound methods, classes, instances,
modules and external names. Rules are applied pass after pass until nothing is added or ``max_iter`` is reached (-1: no
bound). A pass looks only at facts whose inputs grew in the one before. Each shard of files is solved in a task of its own,
so a project's shards run side by side; edges of shards are then coalesced.

``whole_edges`` gives the edges of all files together from tasks of bounded size: files are solved in parts, each beside all
that it imports. What a part adds to the facts of imported files could reach other parts; where that happens, all files
that imports hold together are solved as one, as then no smaller set has all the edges.

In ``decomposed_edges`` a shard whose facts pass ``MAX_FACTS`` has run away: its files are planned again with half
the budget, until they come to an end or can't be taken apart further. A count decides, not a clock, so results
are the same on any machine.
"""

from __future__ import annotations

import builtins
import math
from collections import defaultdict
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph import schemas
from srcgraph.operators import callgraph
from srcgraph.operators.graph import components
from srcgraph.operators.relations import modules, relation
from srcgraph.runtime import cut, sized

MAX_ITER, WHOLE_PROJECT_FILES, MAX_FACTS = 50, 500, 20_000_000
#: Rows of flows in a part, beside those of what it imports, and how often all rows may be solved again as imported ones.
PART_ROWS, AGAIN = 100_000, 3
_BUILTINS = frozenset(dir(builtins))


class Runaway(Exception):
    """More facts than a shard may have."""


class Solver:
    """The facts of one set of files. Values are (kind, name, self): function, method, class, instance, module or external."""

    def __init__(self, flows: Iterable[tuple], files: dict[str, str], bindings: dict[str, str], max_facts: int | None = None):
        self.facts, self.max_facts = 0, math.inf if max_facts is None else max_facts
        #: import path -> what its pointers begin with
        self.files, self.bindings = files, bindings
        self.points: dict[str, set[tuple]] = defaultdict(set)
        self.to: dict[str, set[str]] = defaultdict(set)
        self.functions: dict[str, tuple[str | None, int]] = {}
        self.bases: dict[str, list[str]] = defaultdict(list)
        self.members: dict[str, dict[str, str]] = defaultdict(dict)
        self.params: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
        self.loads, self.stores, self.supers = defaultdict(list), defaultdict(list), defaultdict(list)
        self.calls: dict[str, list[tuple[str, str]]] = defaultdict(list)
        self.args: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
        self.inside: dict[str, str] = {}
        self.edges: set[tuple[str, str]] = set()
        self.changed: set[str] = set()
        self.watch: dict[str, set[tuple]] = defaultdict(set)
        self.read(flows)

    def read(self, flows: Iterable[tuple]) -> None:
        """More facts, at the beginning or after ``solve``."""
        asked = set()
        for kind, a, b, c, n in flows:
            if kind in ("load", "call"):
                asked.add(b)
            elif kind == "store":
                asked.add(a)
            if kind == "assign":
                self.link(b, a)
            elif kind == "function":
                self.functions[b] = (c, n)
                self.add(a, ("function", b, None))
            elif kind == "class":
                self.add(a, ("class", b, None))
            elif kind == "base":
                self.bases[a].append(b)
            elif kind == "member":
                self.members[a][c] = b
            elif kind == "param":
                self.params[a].append((b, c, n))
            elif kind == "import":
                self.bring(a, b)
            elif kind == "load":
                self.loads[b].append((a, c))
            elif kind == "store" and b is not None:
                self.stores[a].append((b, c))
            elif kind == "super":
                self.supers[b].append((a, c))
            elif kind == "call":
                self.calls[b].append((a, c if not n else ""))
            elif kind == "arg" and b is not None:
                self.args[a].append((b, c, n))
            elif kind == "inside":
                self.inside[a] = b
        for p in {*self.calls, *self.loads, *self.to}:
            scope, _, name = p.partition("::")
            if scope == "builtins" and name in _BUILTINS:
                self.add(p, ("external", f"builtins.{name}", None))
        self.changed |= {p for p in asked if self.points.get(p)}

    def add(self, pointer: str, value: tuple) -> None:
        if value not in self.points[pointer]:
            self.points[pointer].add(value)
            self.changed.add(pointer)
            self.facts += 1
            if self.facts > self.max_facts:
                raise Runaway

    def link(self, source: str, target: str) -> None:
        if source != target and target not in self.to[source]:
            self.to[source].add(target)
            for v in list(self.points[source]):
                self.add(target, v)

    def bring(self, pointer: str, dotted: str) -> None:
        """An import: a module, a name of one, or something outside."""
        seen = set()
        while dotted not in seen:  # re-exports
            seen.add(dotted)
            if dotted in self.files:
                self.add(pointer, ("module", dotted, None))
                return
            head, _, name = dotted.rpartition(".")
            if head in self.files:
                self.link(f"{self.files[head]}::{name}", pointer)
                if dotted not in self.bindings:
                    return
            if dotted not in self.bindings or self.bindings[dotted] == dotted:
                break
            dotted = self.bindings[dotted]
        self.add(pointer, ("external", dotted, None))

    def lineage(self, cls: str, skip: bool = False) -> list[str]:
        """A class and its ancestors, nearest first, bases in order."""
        out, todo = [], [cls]
        while todo:
            c = todo.pop(0)
            if c in out:
                continue
            out.append(c)
            todo += [v[1] for b in self.bases.get(c, ()) for v in sorted(self.points[b], key=str) if v[0] in ("class", "external")]
        return out[1:] if skip else out

    def attribute(self, target: str, value: tuple, name: str, skip: bool = False) -> None:
        """What ``value.name`` holds goes to ``target``."""
        kind, at, _ = value
        if kind == "module":
            full = f"{at}.{name}"
            self.bring(target, full)
        elif kind == "external":
            self.add(target, ("external", f"{at}.{name}", None))
        elif kind in ("instance", "class"):
            for c in self.lineage(at, skip):
                self.link(f"{c}.{name}::<field>", target)
                if name in self.members.get(c, ()):
                    for v in list(self.points[self.members[c][name]]):
                        self.bind(target, v, kind, at)
                    self.watch[self.members[c][name]].add((target, kind, at))
                    return
                if c not in self.members and c not in self.bases and "." in c and not any(c == v[1] for v in self.points.get(c, ())) and c in self.outside:
                    self.add(target, ("external", f"{c}.{name}", None))
                    return

    def bind(self, target: str, v: tuple, kind: str, at: str) -> None:
        how = self.functions.get(v[1], (None, 0))[1] if v[0] == "function" else 1
        if how == 3 and kind == "instance":
            self.link(f"{v[1]}::<ret>", target)
        elif how == 2 or (how == 0 and kind == "instance"):
            self.add(target, ("method", v[1], ("class" if how == 2 else "instance", at, None)))
        else:
            self.add(target, v)

    def call(self, result: str, scope: str, value: tuple) -> None:
        kind, name, self_ = value
        caller = self.inside_of(scope)
        if kind == "external":
            if caller:
                self.edges.add((caller, name))
            # what is handed to code outside may be called by it
            return
        if kind == "class":
            self.add(result, ("instance", name, None))
            for c in self.lineage(name):
                init = self.members.get(c, {}).get("__init__")
                if init is not None:
                    for v in list(self.points[init]):
                        if v[0] == "function":
                            self.enter(result, caller, v[1], ("instance", name, None), False)
                    return
            if caller and name not in self.outside:
                self.edges.add((caller, f"{name}.__init__"))
            return
        if kind == "instance":
            p = f"{result}::__call__"
            self.attribute(p, value, "__call__")
            if (result, scope) not in self.calls[p]:
                self.calls[p].append((result, scope))
                self.changed.add(p)
            return
        if kind in ("function", "method"):
            self.enter(result, caller, name, self_, True)

    def inside_of(self, scope: str) -> str:
        while scope in self.inside:
            scope = self.inside[scope]
        return scope

    def enter(self, result: str, caller: str, fn: str, self_: tuple | None, returns: bool) -> None:
        target = self.inside_of(fn)
        if caller and not fn.rpartition(".")[2].startswith("<lambda"):
            self.edges.add((caller, fn))
        elif caller and target != caller:
            self.edges.add((caller, target))
        params = self.params.get(fn, ())
        shift = 1 if self_ is not None else 0
        by_place = {n: p for p, _, n in params if n >= 0}
        by_name = {c: p for p, c, _ in params}
        if self_ is not None and 0 in by_place:
            self.add(by_place[0], self_)
        for p, c, n in self.args.get(result, ()):
            if c == "*":
                for k, q in by_place.items():
                    if k >= n + shift:
                        self.link(p, q)
            elif c == "**":
                for q in by_name.values():
                    self.link(p, q)
            elif n >= 0:
                q = by_place.get(n + shift, by_name.get("*"))
                if q is not None:
                    self.link(p, q)
            elif c in by_name or "**" in by_name:
                self.link(p, by_name.get(c, by_name.get("**")))
        if returns:
            self.link(f"{fn}::<ret>", result)

    def solve(self, max_iter: int = MAX_ITER) -> set[tuple[str, str]]:
        self.outside = {v[1] for vs in self.points.values() for v in vs if v[0] == "external"}
        done = 0
        while self.changed and (max_iter < 0 or done < max_iter):
            done += 1
            now, self.changed = sorted(self.changed), set()
            for p in now:
                values = sorted(self.points[p], key=str)
                self.outside |= {v[1] for v in values if v[0] == "external"}
                for q in sorted(self.to[p]):
                    for v in values:
                        self.add(q, v)
                for target, kind, at in sorted(self.watch[p], key=str):
                    for v in values:
                        self.bind(target, v, kind, at)
                for target, name in self.loads.get(p, ()):
                    for v in values:
                        self.attribute(target, v, name)
                for source, name in self.stores.get(p, ()):
                    for v in values:
                        if v[0] in ("instance", "class"):
                            self.link(source, f"{v[1]}.{name}::<field>")
                        elif v[0] == "module":
                            self.link(source, f"{self.files.get(v[1], v[1])}::{name}")
                for result, scope in list(self.calls.get(p, ())):
                    for v in values:
                        self.call(result, scope, v)
            if done == 1:
                for cls, asks in self.supers.items():
                    for target, name in asks:
                        self.attribute(target, ("instance", cls, None), name, True)
        # a super() whose bases became known late
        for cls, asks in self.supers.items():
            for target, name in asks:
                self.attribute(target, ("instance", cls, None), name, True)
        for p in sorted(self.changed):
            for result, scope in list(self.calls.get(p, ())):
                for v in sorted(self.points[p], key=str):
                    self.call(result, scope, v)
        return self.edges


def _solved(extracted: DataFrame, shards: DataFrame | None, max_iter: int, max_facts: int | None) -> DataFrame:
    """(source, target, shard_id) of each shard's edges; one row of nulls and its id for a shard that ran away."""
    flows = relation(extracted, "flows")
    of = modules(extracted).select("file_key", "dotted")
    binds = relation(extracted, "bindings")
    none = F.lit(None).cast("string").alias("c")
    rows = flows.select("file_key", "kind", "a", "b", "c", "n").unionByName(binds.select("file_key", F.lit("bind").alias("kind"), F.col("dotted").alias("a"), F.col("target").alias("b"), none, F.lit(0).alias("n")))
    base = F.regexp_replace(F.replace(F.regexp_replace("file_key", "^/", ""), F.lit("/"), F.lit(".")), r"\.py$", "")
    rows = rows.unionByName(of.select("file_key", F.lit("file").alias("kind"), F.col("dotted").alias("a"), base.alias("b"), none, F.lit(0).alias("n")))
    rows = rows.join(shards.select("file_key", "shard_id"), "file_key") if shards is not None else rows.withColumn("shard_id", F.lit(0).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf.shard_id.iloc[0])
        facts = [(k, a, b, c if isinstance(c, str) else None, int(n)) for k, a, b, c, n in sorted(zip(pdf.kind, pdf.a, pdf.b, pdf.c, pdf.n), key=str)]
        files = {a: b for k, a, b, _, _ in facts if k == "file"}
        bindings = {a: b for k, a, b, _, _ in facts if k == "bind"}
        try:
            edges = sorted(Solver((f for f in facts if f[0] not in ("file", "bind")), files, bindings, max_facts).solve(max_iter))
        except Runaway:
            edges = [(None, None)]
        return pd.DataFrame([(s, t, shard) for s, t in edges], columns=["source", "target", "shard_id"])

    return rows.groupBy("shard_id").applyInPandas(run, "source string, target string, shard_id long")


def _edges(solved: DataFrame) -> DataFrame:
    e = solved.filter("source IS NOT NULL").select("source", "target", F.lit("CALL_DEP").alias("type"), F.lit(1).cast("long").alias("weight"), F.array(F.lit(callgraph.LEVEL_2)).alias("provenance"), "shard_id")
    return callgraph.coalesce_edges(e, "shard_id")


def points_to_edges(extracted: DataFrame, shards: DataFrame | None = None, max_iter: int = MAX_ITER, max_facts: int | None = None) -> DataFrame:
    """Call edges by points-to analysis; ``shards`` (shard_id, file_key), or all files as one.

    There is no limit on facts, as nothing plans shards again here; with ``max_facts``, shards that run away give no edges.
    """
    return _edges(_solved(extracted, shards, max_iter, max_facts))


def decomposed_edges(extracted: DataFrame, shards: DataFrame, replan: Callable[[DataFrame, int], DataFrame], budgets: list[int], max_iter: int = MAX_ITER, max_facts: int = MAX_FACTS) -> DataFrame:
    """``points_to_edges`` of ``shards``, with those that run away planned again: ``replan(files, budget)`` for each further budget.

    A file that runs away on its own stays without level-2 edges.
    """
    found, left = None, shards.select("shard_id", "file_key")
    for i, budget in enumerate(budgets):
        if i:
            left = cut(replan(left.select("file_key"), budget).select("shard_id", "file_key"))
        solved = cut(_solved(extracted, left, max_iter, max_facts))
        found = solved if found is None else found.unionByName(solved)
        failed = solved.filter("source IS NULL").select("shard_id")
        several = left.groupBy("shard_id").agg(F.count("*").alias("n")).filter("n > 1").select("shard_id")
        left = cut(left.join(failed, "shard_id", "left_semi").join(several, "shard_id", "left_semi"))
        if left.isEmpty():
            break
    return _edges(found)


def plan_parts(rows: dict[str, int], imports: Iterable[tuple[str, str]], part_rows: int = PART_ROWS) -> list[tuple[str, int, bool, str]]:
    """(file, shard, own, component) of files with their numbers of rows and (file, imported file).

    What imports hold together is a component: a small one is solved whole, with others up to ``part_rows``. A large one is taken apart,
    files that import each other in a circle staying together: a part is the files of its own, which import the same, and all
    that they import, directly or not. A component where that would go over all rows more than ``AGAIN`` times stays whole.
    """
    on: dict[str, set[str]] = {f: set() for f in rows}
    for f, g in imports:
        if f != g and f in on and g in on:
            on[f].add(g)
    circle = components(on)
    members: dict[str, list[str]] = defaultdict(list)
    held: dict[str, str] = {f: f for f in rows}

    def root(f: str) -> str:
        while held[f] != f:
            held[f] = f = held[held[f]]
        return f

    for f in sorted(rows):
        members[circle[f]].append(f)
        for g in on[f]:
            a, b = sorted((root(f), root(g)))
            held[b] = a
    whole: dict[str, list[str]] = defaultdict(list)
    for f in sorted(rows):
        whole[root(f)].append(f)
    size = {c: sum(rows[f] for f in fs) for c, fs in members.items()}
    out: list[tuple[str, int, bool, str]] = []
    shard, filled = 0, 0
    for component, files in sorted(whole.items()):
        total = sum(rows[f] for f in files)
        parts = _parts_of(files, on, circle, size, total, part_rows) if total > part_rows else None
        if parts is None:
            if filled and filled + total > part_rows:
                shard, filled = shard + 1, 0
            filled += total
            out += [(f, shard, True, component) for f in files]
            continue
        shard, filled = shard + bool(filled), 0
        for own, below in parts:
            out += [(f, shard, c in own, component) for c in sorted(own | below) for f in members[c]]
            shard += 1
    return out


def _parts_of(files: list[str], on: dict[str, set[str]], circle: dict[str, str], size: dict[str, int], total: int, part_rows: int) -> list[tuple[set[str], frozenset[str]]] | None:
    """(circles of its own, circles below them) of each part of a component; None where imports are too tangled."""
    next_: dict[str, set[str]] = defaultdict(set)
    for f in files:
        next_[circle[f]] |= {circle[g] for g in on[f]} - {circle[f]}
    below: dict[str, frozenset[str]] = {}
    same: dict[frozenset[str], frozenset[str]] = {}
    held = 0
    for start in sorted({circle[f] for f in files}):
        todo = [start]
        while todo:
            c = todo[-1]
            wait = [n for n in next_[c] if n not in below]
            if wait:
                todo += wait
                continue
            todo.pop()
            if c not in below:
                b = frozenset().union(next_[c], *(below[n] for n in next_[c]))
                below[c] = same.setdefault(b, b)
                held += len(b) if below[c] is b else 0
                if held > 50 * len(files) + 1000:
                    return None
    by: dict[frozenset[str], list[str]] = defaultdict(list)
    for c in sorted(below):
        by[below[c]].append(c)
    parts, again = [], 0
    for b, circles in by.items():
        rows_below, own, filled = sum(size[c] for c in b), set(), 0
        for c in circles:
            if own and filled + size[c] > part_rows:
                parts.append((own, b))
                own, filled, again = set(), 0, again + rows_below
            own.add(c)
            filled += size[c]
        parts.append((own, b))
        again += rows_below
        if again > AGAIN * total:
            return None
    return parts


def file_imports(extracted: DataFrame) -> DataFrame:
    """(file_key, on): files that a file's imports name, or name something in, or whose package they name."""
    of = modules(extracted).select(F.col("file_key").alias("on"), F.col("dotted").alias("_file"))
    fronts = lambda c: F.expr(f"transform(sequence(1, size(split({c}, '\\\\.'))), i -> array_join(slice(split({c}, '\\\\.'), 1, i), '.'))")
    flows = extracted.select("file_key", F.explode(F.expr("array_distinct(transform(filter(flows, f -> f.kind = 'import'), f -> f.b))")).alias("target"))
    binds = relation(extracted, "bindings").select("file_key", F.regexp_replace("target", r"\.\*$", "").alias("target"))
    targets = cut(flows.union(binds).filter("target IS NOT NULL").distinct())
    named = targets.select("file_key", F.explode(fronts("target")).alias("_file")).distinct().join(sized(of, 256), "_file").select("file_key", "on")
    inside = of.select("on", F.explode(fronts("_file")).alias("target"))
    return named.union(targets.join(inside, "target").select("file_key", "on")).filter("file_key <> on").distinct()


def planned_parts(extracted: DataFrame, part_rows: int) -> DataFrame:
    """``plan_parts`` in one task, which has a row for each file and import of a file."""
    files = extracted.filter("error IS NULL").select("file_key", F.lit("").alias("on"), F.size("flows").alias("n"))
    rows = files.unionByName(file_imports(extracted).withColumn("n", F.lit(0))).withColumn("_all", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, imports = pdf[pdf.on == ""], pdf[pdf.on != ""]
        parts = plan_parts({f: int(n) + 1 for f, n in zip(sizes.file_key, sizes.n)}, zip(imports.file_key, imports.on), part_rows)
        return pd.DataFrame(parts, columns=["file_key", "shard_id", "own", "component"])

    return rows.groupBy("_all").applyInPandas(run, "file_key string, shard_id long, own boolean, component string")


def _flow_rows(files: pa.Table, own: bool) -> list[tuple]:
    part = files.filter(pa.array([o == own for o in files.column("own").to_pylist()], pa.bool_()))
    flat = part.column("flows").combine_chunks().flatten()
    return sorted(zip(*(flat.field(f).to_pylist() for f in ("kind", "a", "b", "c", "n"))), key=str)


def solve_beside(below: list[tuple], own: list[tuple], files: dict[str, str], imported: set[str], bindings: dict[str, str], max_iter: int = MAX_ITER) -> tuple[set[tuple[str, str]], bool]:
    """(edges that come of ``own`` flows beside those ``below``, whether they add to what pointers of ``imported`` files hold); ``imported``: what these files' names begin with."""
    solver = Solver(below, files, bindings)
    before = set(solver.solve(max_iter))
    known = {p: len(v) for p, v in solver.points.items()}
    mine = set(files.values()) - imported
    solver.read(own)
    edges = solver.solve(max_iter)

    def foreign(pointer: str) -> bool:
        name = pointer.partition("::")[0].partition("#")[0]
        while name and name not in mine:
            if name in imported:
                return True
            name = name.rpartition(".")[0]
        return False

    adds = any(len(v) > known.get(p, 0) and foreign(p) for p, v in solver.points.items())
    return edges - before, adds


def _beside(extracted: DataFrame, parts: DataFrame, max_iter: int) -> DataFrame:
    """(source, target, component) of parts that import others; null edges and the component where a part adds to what it imports."""
    base = F.regexp_replace(F.replace(F.regexp_replace("file_key", "^/", ""), F.lit("/"), F.lit(".")), r"\.py$", "").alias("base")
    rows = extracted.filter("error IS NULL").select("file_key", "dotted", base, "flows", "bindings").join(sized(parts, 256), "file_key")

    def run(part: pa.Table) -> pa.Table:
        owns, bases = part.column("own").to_pylist(), part.column("base").to_pylist()
        files = dict(zip(part.column("dotted").to_pylist(), bases))
        names = part.column("bindings").combine_chunks().flatten()
        bindings = dict(sorted(zip(names.field("dotted").to_pylist(), names.field("target").to_pylist())))
        edges, adds = solve_beside(_flow_rows(part, False), _flow_rows(part, True), files, {b for b, o in zip(bases, owns) if not o}, bindings, max_iter)
        found = sorted(edges) + [(None, None)] * adds
        of = part.column("component")[0].as_py()
        return pa.table({"source": pa.array([s for s, _ in found], pa.string()), "target": pa.array([t for _, t in found], pa.string()), "component": pa.array([of] * len(found), pa.string())})

    return rows.groupBy("shard_id").applyInArrow(run, "source string, target string, component string")


def whole_edges(extracted: DataFrame, max_iter: int = MAX_ITER, part_rows: int = PART_ROWS) -> DataFrame:
    """Call edges by points-to analysis of all files together, a row each, solved in parts."""
    parts = cut(planned_parts(extracted, part_rows))
    several = cut(parts.filter("NOT own").select("shard_id").distinct())
    alone = parts.join(several, "shard_id", "left_anti")
    found = _solved(extracted, alone, max_iter, None).select("source", "target")
    if not several.isEmpty():
        beside = cut(_beside(extracted, parts.join(several, "shard_id", "left_semi"), max_iter))
        mixed = cut(beside.filter("source IS NULL").select("component").distinct())
        found = found.union(beside.filter("source IS NOT NULL").select("source", "target"))
        if not mixed.isEmpty():
            again = parts.join(mixed, "component", "left_semi").select("component", "file_key").distinct()
            again = again.join(mixed.withColumn("shard_id", F.monotonically_increasing_id()).transform(cut), "component")
            found = found.union(_solved(extracted, again, max_iter, None).select("source", "target"))
    return _edges(found.distinct().withColumn("shard_id", F.lit(0).cast("long")))


def solve_sources(sources: dict[str, str], max_iter: int = MAX_ITER) -> set[tuple[str, str]]:
    """The same on sources in memory, by relative path; for tests and small uses."""
    from srcgraph.operators.extract import dotted_path, extract_module, import_path

    flows, files, bindings = [], {}, {}
    for rel, source in sorted(sources.items()):
        out = extract_module(source, rel, rel)
        files[import_path(rel)] = dotted_path(rel)
        bindings |= {r["dotted"]: r["target"] for r in out["bindings"]}
        flows += [(r["kind"], r["a"], r["b"], r["c"], r["n"]) for r in out["flows"]]
    return Solver(sorted(flows, key=str), files, bindings).solve(max_iter)


EDGE_SCHEMA = schemas.CALL_EDGES
