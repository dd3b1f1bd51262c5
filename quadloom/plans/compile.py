"""Algebra to DataFrames."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import fields, is_dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quadloom.errors import QueryError
from quadloom.functions import builtins as fn
from quadloom.functions.values import DEC, NUMERIC_DT, RANK, Val, arithmetic, as_decimal, as_double, compare, const, ebv, lexical, number_term, order_key, rank_of
from quadloom.plans import rel as R
from quadloom.plans.algebra import BGP, Extend, Filter, Graph, Join, LeftJoin, Minus, Path, Query, Service, TriplePattern, Union, Unit, Values, Var, pattern_vars
from quadloom.plans.parser import bare_vars, has_aggregate
from quadloom.plans.paths import PathCompiler
from quadloom.plans.rel import IRI_REPR, TERM_REPR, C, Rel, Repr
from quadloom.session import cut
from quadloom.store import Active
from quadloom.terms import BNODE, IRI, LITERAL, TERM, TRIPLE, Term, nt_text, short_dt, term_col


def term_vars(t: Any) -> list[str]:
    if isinstance(t, Var):
        return [t.name]
    return [v for x in (t.s, t.p, t.o) for v in term_vars(x)] if isinstance(t, TriplePattern) else []


def conjuncts(e: Any) -> list[Any]:
    return conjuncts(e[2]) + conjuncts(e[3]) if isinstance(e, tuple) and e[0] == "op" and e[1] == "&&" else [e]


def deep_vars(x: Any) -> set[str]:
    """All variables that a pattern or expression names, at any depth."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, (tuple, list)):
        return set().union(*map(deep_vars, x)) if x else set()
    if isinstance(x, Extend):
        return deep_vars(x.inner) | deep_vars(x.expr) | {x.var}
    if isinstance(x, Values):
        return set(x.vars)
    if isinstance(x, Query):
        return set(pattern_vars(x))
    return set().union(*(deep_vars(getattr(x, f.name)) for f in fields(x))) if is_dataclass(x) and not isinstance(x, (Term, type)) else set()


def named(x: Any) -> Iterator[str | None]:
    """Every mention of a variable in a query; None stands for what may depend on all of them: all columns, all of a solution, a node or number of its own."""
    if isinstance(x, Var):
        yield x.name
    elif isinstance(x, (tuple, list)):
        if isinstance(x, tuple) and x[:1] == ("agg",) and x[2] is None and x[3] or isinstance(x, tuple) and x[:1] == ("call",) and x[1] in ("BNODE", "RAND", "UUID", "STRUUID"):
            yield None
        for y in x:
            yield from named(y)
    elif isinstance(x, Query):
        if x.project is None:
            yield None
        for n, e in x.project or []:
            yield n
            yield from named(e)
        for n, e in x.group or []:
            yield n
            yield from named(e)
        for y in (x.where, x.having, x.order, x.values, x.template, x.describe):
            yield from named(y)
    elif isinstance(x, Values):
        yield from x.vars
    elif is_dataclass(x) and not isinstance(x, (Term, type)):
        if isinstance(x, Extend):
            yield x.var
        for f in fields(x):
            yield from named(getattr(x, f.name))


def outer_uses(n: Any, bound: frozenset[str]) -> frozenset[str]:
    """The variables bound outside that a pattern uses where they are not in scope: in conditions, in bindings, and on the right of OPTIONAL and MINUS."""
    if isinstance(n, (Filter, Extend)):
        return ((frozenset(deep_vars(n.expr)) & bound) - frozenset(pattern_vars(n.inner))) | outer_uses(n.inner, bound)
    if isinstance(n, (LeftJoin, Minus)):
        alone = frozenset(deep_vars(n.right)) | frozenset(deep_vars(getattr(n, "expr", None)))
        return ((alone & bound) - frozenset(pattern_vars(n.left))) | outer_uses(n.left, bound) | outer_uses(n.right, bound)
    if isinstance(n, (Join, Union)):
        return outer_uses(n.left, bound) | outer_uses(n.right, bound)
    return outer_uses(n.inner, bound) if isinstance(n, Graph) else frozenset()


class Compiler:
    """Compiles one query against a store."""

    def __init__(self, spark: SparkSession, store, functions: dict | None = None, service=None, base: str | None = None):
        self.spark, self.store = spark, store
        self.functions, self.service, self.base = functions or {}, service, base
        self.fresh, self.made = 0, set()
        self.mentions: Counter | None = None  # how often the query names each variable, where that tells which columns it can do without

    # patterns

    def pattern(self, n: Any, active: Active) -> Rel:
        if isinstance(n, Unit):
            return self.unit(active)
        if isinstance(n, BGP):
            return self.bgp(n.triples, active)
        if isinstance(n, Join):
            if isinstance(n.right, Service) and self.service is not None:
                return self.service(self, n.right, active, self.pattern(n.left, active))
            return R.join(self.pattern(n.left, active), self.pattern(n.right, active))
        if isinstance(n, LeftJoin) and isinstance(n.right, Service) and self.service is not None:  # the matches, and the rows without one
            left, right = self.pattern(n.left, active), self.service(self, n.right, active, self.pattern(n.left, active).only(pattern_vars(n.right)))
            return self.optional(left, Rel(right.df.distinct(), right.reprs, right.maybe), n.expr, active)
        if isinstance(n, LeftJoin):
            return self.optional(self.pattern(n.left, active), self.pattern(n.right, active), n.expr, active)
        if isinstance(n, Filter):
            return self.filter(self.pattern(n.inner, active), n.expr, active)
        if isinstance(n, Union):
            return R.union(self.pattern(n.left, active), self.pattern(n.right, active))
        if isinstance(n, Minus):  # the variable of a GRAPH around is no shared one
            return R.minus(self.pattern(n.left, active), self.pattern(n.right, active), frozenset({active.name}) if active.kind == "var" else frozenset())
        if isinstance(n, Graph):
            return self.graph(n, active)
        if isinstance(n, Extend):
            return self.extend(self.pattern(n.inner, active), n.var, n.expr, active)
        if isinstance(n, Values):
            return self.values(n)
        if isinstance(n, Query):
            return self.select(n, active)
        if isinstance(n, Service):
            if self.service is None:
                raise QueryError("no transport for SERVICE")
            return self.service(self, n, active)
        raise QueryError(f"unknown pattern {type(n).__name__}")

    def optional(self, left: Rel, right: Rel, expr: Any, active: Active) -> Rel:
        """OPTIONAL under a condition; one with EXISTS in it is a filter of the joined rows, to which come the rows of left that it leaves without a match."""
        if expr is None or not self._has_exists(expr):
            return R.left_join(left, right, None if expr is None else lambda m: self.boolean(expr, m, active))
        self.fresh += 1
        key = f"?left{self.fresh}"
        marked = Rel(left.df.withColumn(key, F.struct(F.lit(0).alias("_"), *[C(v).alias(str(i)) for i, v in enumerate(left.vars)])), left.reprs | {key: Repr("key")}, left.maybe)
        hit = self.filter(R.join(marked, right), expr, active)
        return R.union(hit, R.semi(marked, Rel(hit.df.select(C(key)).distinct(), {key: Repr("key")}), True)).only([*left.vars, *[v for v in right.vars if v not in left.reprs]])

    def unit(self, active: Active) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("?unit")), {})

    def graph(self, n: Graph, active: Active) -> Rel:
        if isinstance(n.name, Term):
            if isinstance(n.inner, Unit):  # one solution if there is such a graph
                there = self.store.quads.where(F.col("g.v") == self.store.const(n.name).v).limit(1)
                return Rel(there.select(F.lit(1).alias("?unit")), {})
            return self.pattern(n.inner, Active("iri", n.name.v))
        name = n.name.name
        if isinstance(n.inner, Unit):
            names = self.store.quads.where("g is not null").select(F.col("g").alias(name)).distinct()
            return Rel(names, {name: TERM_REPR})
        if name in set(named(n.inner)):  # within the pattern it is a variable like others, which must agree with the graph in the end
            self.fresh += 1
            own = f"?graph{self.fresh}"
            out = self.graph(Graph(Var(own), n.inner), active)
            if name in out.reprs:
                out = out.as_terms([name])
                out = Rel(out.df.where(C(name).isNull() | (C(name) == C(own))), out.reprs, out.maybe)
            df = out.df.withColumn(name, C(own)).drop(own)
            return Rel(df, {v: r for v, r in out.reprs.items() if v != own} | {name: TERM_REPR}, out.maybe - {name, own})
        out = self.pattern(n.inner, Active("var", name))
        if name not in out.reprs:
            names = self.store.quads.where("g is not null").select(F.col("g").alias(name)).distinct()
            out = R.join(out, Rel(names, {name: TERM_REPR}))
        return out

    def bgp(self, triples: list[tuple], active: Active) -> Rel:
        """Joins the patterns: stars of one subject as one scan where the store can, the others most selective first and connected where possible."""
        if not triples:
            return self.unit(active)
        triples = [x for t in triples for x in self.steps(t)]
        parts: list[tuple[float, list[str], Any]] = []
        rest = list(triples)
        subjects: dict[Any, list[tuple]] = {}
        for t in triples:
            if isinstance(t[1], Term) and not isinstance(t[0], TriplePattern) and not isinstance(t[2], TriplePattern):
                subjects.setdefault(t[0], []).append(t)
        allowed = self.store.restrict(subjects)
        for s, group in subjects.items():
            unused = isinstance(s, Var) and self.mentions is not None and self.mentions[s.name] == len(group)
            if (got := self.store.star(s, [(p, o) for _, p, o in group], active, allowed, unused)) is not None:
                rest = [t for t in rest if t not in group]
                parts.append((sum(isinstance(o, Term) for _, _, o in group) + isinstance(s, Term), got.vars, got))
        for t in rest:
            names = [v for x in t for v in term_vars(x)]
            bound = sum(isinstance(x, Term) for x in t) - (2 if isinstance(t[1], Path) else 0)
            rows = None if isinstance(t[1], Path) else self.store.estimate(*t)
            parts.append((bound if rows is None else 3 - math.log10(1 + rows), names, t))  # counts, where the store has them, else the number of constants
        out: Rel | None = None
        while parts:
            have = set(out.reprs) if out else set()
            best = max(range(len(parts)), key=lambda i: (bool(have & set(parts[i][1])) or not have, parts[i][0], -i))
            _, _, item = parts.pop(best)
            got = item if isinstance(item, Rel) else self.triple(item, active, out)
            out = got if out is None else R.join(out, got)
        return out

    def steps(self, t: tuple) -> list[tuple]:
        """A path of plain steps as patterns over fresh variables, so that its steps join like any others; other paths stay."""
        s, p, o = t
        if not isinstance(p, Path):
            return [t]
        if p.op == "iri":
            return [(s, Term(IRI, p.args[0]), o)]
        if p.op == "inv":
            return self.steps((o, p.args[0], s))
        if p.op == "seq":
            self.fresh += 1
            mid = Var(f"?step{self.fresh}")
            return self.steps((s, p.args[0], mid)) + self.steps((mid, p.args[1], o))
        return [t]

    def triple(self, t: tuple, active: Active, bound: Rel | None = None) -> Rel:
        """One pattern; bound has the solutions of the pattern's neighbours, whose nodes a closure can start from."""
        s, p, o = t
        if not isinstance(p, Path):
            return self.store.scan(s, p, o, active)
        if p.op in ("star", "plus", "opt") and bound is not None and active.kind != "var" and isinstance(s, Var) and isinstance(o, Var) and s != o:
            for x, y, q in ((s, o, p), (o, s, Path(p.op, (Path("inv", p.args),)))):
                if x.name in bound.reprs:
                    seeds = cut(bound.df.select(bound.reprs[x.name].term(C(x.name)).alias("t")).distinct())
                    df = PathCompiler(self.store, active).seeded(q, seeds).select(F.col("s").alias(x.name), F.col("o").alias(y.name))
                    return Rel(df, {x.name: TERM_REPR, y.name: TERM_REPR})
        start, end = (self.store.const(x) if isinstance(x, Term) else None for x in (s, o))
        df = PathCompiler(self.store, active, tuple(x for x in (start, end) if x is not None)).pairs(p, start, end)
        cols, reprs = [], {}
        if isinstance(s, Var):
            cols.append(F.col("s").alias(s.name))
            reprs[s.name] = TERM_REPR
        if isinstance(o, Var):
            if isinstance(s, Var) and s.name == o.name:
                df = df.where(F.col("s") == F.col("o"))
            else:
                cols.append(F.col("o").alias(o.name))
                reprs[o.name] = TERM_REPR
        if active.kind == "var":
            cols.append(F.col("g").alias(active.name))
            reprs[active.name] = TERM_REPR
        return Rel(df.select(*cols) if cols else df.select(F.lit(1).alias("?unit")), reprs)

    def values(self, n: Values) -> Rel:
        rows = [[None if t is None else self.store.const(t) for t in row] for row in n.rows]
        cols: dict[str, Repr] = {}
        schema, data = [], [[] for _ in rows]
        for i, v in enumerate(n.vars):
            column = [r[i] for r in rows]
            native = column and all(t is not None and t.k == IRI for t in column)
            cols[v] = IRI_REPR if native else TERM_REPR
            schema.append(f"`{v}` {'string' if native else TERM.simpleString()}")
            for row, t in zip(data, column, strict=True):
                row.append(None if t is None else t.v if native else (t.k, t.v, t.dt, t.lang, t.dir))
        if not n.vars:
            return Rel(self.spark.range(len(rows)).select(F.lit(1).alias("?unit")), {})
        df = self.spark.createDataFrame([tuple(r) for r in data], ", ".join(schema))
        return Rel(df, cols, {v for i, v in enumerate(n.vars) if any(r[i] is None for r in rows)})

    def extend(self, r: Rel, name: str, e: Any, active: Active) -> Rel:
        r, v = self.value_in(e, r, active)
        self.made.add(name)
        if isinstance(e, Var) and e.name in r.reprs:
            return Rel(r.df.withColumn(name, C(e.name)), r.reprs | {name: r.reprs[e.name]}, r.maybe | ({name} if e.name in r.maybe else set()))
        kind = IRI_REPR if v.kind == "iri" else Repr(v.kind)
        return Rel(r.df.withColumn(name, v.col), r.reprs | {name: kind}, r.maybe | {name})

    def filter(self, r: Rel, e: Any, active: Active) -> Rel:
        later = []
        for c in conjuncts(e):
            negated = isinstance(c, tuple) and c[0] == "op" and c[1] == "!" and isinstance(c[2], tuple) and c[2][0] == "exists"
            if negated:
                c = ("exists", c[2][1], not c[2][2])
            if isinstance(c, tuple) and c[0] == "exists":
                r = self.exists(r, c[1], c[2], active)
            elif self._has_exists(c):
                later.append(c)
            else:
                r = Rel(r.df.where(F.coalesce(self.boolean(c, r, active), F.lit(False))), r.reprs, r.maybe)
        for c in later:
            names = r.vars
            r, v = self.value_in(c, r, active)
            r = Rel(r.df.where(F.coalesce(ebv(v), F.lit(False))), r.reprs, r.maybe).only(names)
        return r

    def _has_exists(self, e: Any) -> bool:
        return isinstance(e, (tuple, list)) and ((isinstance(e, tuple) and bool(e) and e[0] == "exists") or any(self._has_exists(x) for x in e))

    def exists(self, r: Rel, pattern: Any, negated: bool, active: Active) -> Rel:
        """EXISTS by semi join; conditions of the pattern on variables from outside move into the join, deeper ones meet the outer bindings where they stand."""
        outer, inner = [], pattern
        while isinstance(inner, Filter):
            own = set(pattern_vars(inner.inner))
            keep = []
            for c in conjuncts(inner.expr):
                (keep if self._has_exists(c) or bare_vars(c) <= own or not (bare_vars(c) & set(r.reprs)) else outer).append(c)
            if keep and outer:
                inner = Filter(reduce(lambda a, b: ("op", "&&", a, b), keep), inner.inner)
            if keep:
                break
            inner = inner.inner
        bound = frozenset(v for v in r.vars if not v.startswith("?"))
        if used := outer_uses(inner, bound):
            return self._correlated_exists(r, pattern, used, negated, active)
        b = self.pattern(inner, active)
        cond = None if not outer else lambda m: reduce(lambda x, y: x & y, [self.boolean(c, m, active) for c in outer])
        return R.semi(r, b, negated, cond)

    def _correlated_exists(self, r: Rel, pattern: Any, used: frozenset[str], negated: bool, active: Active) -> Rel:
        """EXISTS over the distinct bindings of the outer variables that the pattern names: they join in where the pattern uses them, under a key that stays."""
        self.fresh += 1
        key, names = f"?outer{self.fresh}", [v for v in r.vars if v in deep_vars(pattern)]
        bindings = F.struct(*[C(v).alias(str(i)) for i, v in enumerate(names)])  # structs with unbound fields are equal where all fields are
        distinct = r.df.select(*[C(v) for v in names], bindings.alias(key)).distinct()
        seeds = Rel(distinct, {v: r.reprs[v] for v in names} | {key: Repr("key")}, r.maybe & set(names))
        b = self._seeded(self.correlate(pattern, seeds, key, active), seeds, key)
        marked = Rel(r.df.withColumn(key, bindings), r.reprs | {key: Repr("key")}, r.maybe)
        return R.semi(marked, b.only([key]), negated).only(r.vars)

    def _seeded(self, r: Rel, seeds: Rel, key: str) -> Rel:
        return r if key in r.reprs else R.join(r, seeds)

    def correlate(self, n: Any, seeds: Rel, key: str, active: Active) -> Rel:
        """The solutions of a pattern for each of the outer bindings in seeds; parts that use none of them stay as they are."""
        bound = frozenset(v for v in seeds.vars if v != key)
        if not outer_uses(n, bound):
            return self.pattern(n, active)
        sub = lambda x: self.correlate(x, seeds, key, active)
        full = lambda x: self._seeded(sub(x), seeds, key)
        if isinstance(n, Join):
            return R.join(sub(n.left), sub(n.right))
        if isinstance(n, Union):
            return R.union(full(n.left), full(n.right))
        if isinstance(n, LeftJoin):
            return self.optional(full(n.left), sub(n.right), n.expr, active)
        if isinstance(n, Minus):
            return R.minus(full(n.left), sub(n.right), bound | {key})
        if isinstance(n, Filter):
            return self.filter(full(n.inner), n.expr, active)
        if isinstance(n, Extend):
            return self.extend(full(n.inner), n.var, n.expr, active)
        if isinstance(n, Graph) and isinstance(n.name, Term):
            return self.correlate(n.inner, seeds, key, Active("iri", n.name.v))
        if isinstance(n, Graph) and not isinstance(n.inner, Unit):
            return self.correlate(n.inner, seeds, key, Active("var", n.name.name))
        return self.pattern(n, active)

    # expressions

    def boolean(self, e: Any, r: Rel, active: Active) -> Column:
        return ebv(self.expr(e, r, active))

    def value_in(self, e: Any, r: Rel, active: Active) -> tuple[Rel, Val]:
        """The value of an expression over a relation, which gains a flag column for each EXISTS in a place other than a conjunct."""
        if not self._has_exists(e):
            return r, self.expr(e, r, active)

        def lift(x: Any) -> Any:
            nonlocal r
            if isinstance(x, tuple) and x and x[0] == "exists":
                self.fresh += 1
                key, flag = f"?row{self.fresh}", f"?exists{self.fresh}"
                df = r.df.withColumn(key, F.xxhash64(*[C(v) for v in r.vars]) if r.vars else F.lit(0))
                marked = Rel(df, r.reprs, r.maybe)
                distinct = Rel(r.df.select(*[C(v) for v in r.vars]).distinct() if r.vars else r.df, r.reprs, r.maybe)
                hit = self.exists(distinct, x[1], False, active).df
                cols = [C(v).alias(f"?h:{v}") for v in r.vars]
                on = reduce(lambda a, b: a & b, [C(v).eqNullSafe(C(f"?h:{v}")) for v in r.vars], F.lit(True))
                df = marked.df.join(hit.select(*cols, F.lit(True).alias(flag)), on, "left").withColumn(flag, F.coalesce(C(flag), F.lit(False)) != F.lit(bool(x[2])))
                r = Rel(df, r.reprs, r.maybe)
                return ("column", flag)
            if isinstance(x, tuple):
                return tuple(lift(y) for y in x)
            return [lift(y) for y in x] if isinstance(x, list) else x

        e = lift(e)
        return r, self.expr(e, r, active)

    def expr(self, e: Any, r: Rel, active: Active) -> Val:
        if isinstance(e, Var):
            return r.val(e.name) if e.name in r.reprs else Val("term", F.lit(None).cast(TERM))
        if isinstance(e, Term):
            return const(self.store.const(e))
        kind = e[0]
        sub = lambda x: self.expr(x, r, active)
        if kind == "column":
            return Val("bool", C(e[1]))
        if kind == "value":
            return e[1]
        if kind == "op":
            op = e[1]
            if op in ("&&", "||"):
                a, b = ebv(sub(e[2])), ebv(sub(e[3]))
                return Val("bool", a & b if op == "&&" else a | b)
            if op == "!":
                return Val("bool", ~ebv(sub(e[2])))
            if op == "neg":
                v = sub(e[2])
                return Val(v.kind, -v.col) if v.kind in RANK else arithmetic("-", Val("int", F.lit(0).cast("bigint")), v)
            if op in ("+", "-", "*", "/"):
                return arithmetic(op, sub(e[2]), sub(e[3]))
            return Val("bool", compare(op, sub(e[2]), sub(e[3])))
        if kind == "in":
            v = sub(e[1])
            hits = [compare("=", v, sub(x)) for x in e[2]]
            out = reduce(lambda a, b: a | b, hits) if hits else F.when(F.lit(True), F.lit(False))
            return Val("bool", ~out if e[3] else out)
        if kind == "call":
            return self.call(e[1], e[2], r, active)
        if kind == "fn":
            return self.function(e[1], [sub(x) for x in e[2]])
        if kind == "agg":
            raise QueryError("an aggregate outside of a grouped query")
        raise QueryError(f"unknown expression {kind}")

    def call(self, name: str, args: list[Any], r: Rel, active: Active) -> Val:
        if name == "BOUND":
            return Val("bool", C(args[0].name).isNotNull() if args[0].name in r.reprs else F.lit(False))
        vals = [self.expr(a, r, active) for a in args]
        if name == "IF":
            c = ebv(vals[0])
            return self._merge(vals[1:], lambda x: F.when(c, x[0]).when(~c, x[1]))
        if name == "COALESCE":
            if not vals:
                return Val("term", F.lit(None).cast(TERM))
            return self._merge(vals, lambda x: F.coalesce(*x))
        consts = [a.v if isinstance(a, Term) and a.k == LITERAL and a.dt == "xsd:string" else None for a in args]
        if name == "DATATYPE" and getattr(self.store, "short", False):
            full = fn.call(name, vals, consts, self.base)
            return Val("iri", F.regexp_replace(F.regexp_replace(full.col, "^http://www.w3.org/2001/XMLSchema#", "xsd:"), "^http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdf:"))
        own = [v for v in r.vars if v not in self.made and r.reprs[v].kind != "key"]  # what BIND adds does not make another solution
        key = F.concat_ws("|", *[r.reprs[v].term(C(v)).cast("string") for v in own]) if own else None
        return fn.call(name, vals, consts, self.base, key)

    def _merge(self, vals: list[Val], f) -> Val:
        kinds = {v.kind for v in vals}
        if len(kinds) == 1:
            return Val(vals[0].kind, f([v.col for v in vals]))
        return Val("term", f([v.term() for v in vals]))

    def function(self, name: str, args: list[Val]) -> Val:
        if name in self.functions:
            out = self.functions[name](*args)
            return out if isinstance(out, Val) else Val("term", out)
        short = short_dt(name)
        if short.startswith("xsd:") and len(args) == 1:
            return fn.cast(short, args[0])
        raise QueryError(f"unknown function <{name}>")

    # grouping

    def group(self, q: Query, r: Rel, active: Active) -> tuple[Rel, Query]:
        """Groups and aggregates; the query comes back with its aggregates replaced by variables."""
        aggs: dict[Any, str] = {}

        def lift(e: Any) -> Any:
            if isinstance(e, tuple) and e and e[0] == "agg":
                return Var(aggs.setdefault(_freeze(e), f"?agg{len(aggs)}"))
            if isinstance(e, tuple):
                return tuple(lift(x) for x in e)
            return [lift(x) for x in e] if isinstance(e, list) else e

        project = [(n, lift(e)) for n, e in q.project or []]
        having, order = [lift(e) for e in q.having], [(lift(e), up) for e, up in q.order]
        keys: dict[str, Repr] = {}
        for n, e in q.group or []:
            if not isinstance(e, Var):
                r = self.extend(r, n, e, active)
            elif n not in r.reprs:
                r = Rel(r.df.withColumn(n, F.lit(None).cast(TERM)), r.reprs | {n: TERM_REPR}, r.maybe | {n})
            keys[n] = r.reprs[n]
        cols, reprs = [], {}
        for e, name in aggs.items():
            v = self.aggregate(e, r, active)
            cols.append(v.col.alias(name))
            reprs[name] = IRI_REPR if v.kind == "iri" else Repr(v.kind)
        grouped = r.df.groupBy(*[C(k) for k in keys])
        if cols:
            df = grouped.agg(*cols)
        else:
            df = r.df.select(*[C(k) for k in keys]).distinct() if keys else self.spark.range(1).select(F.lit(1).alias("?unit"))
        out = Rel(df, keys | reprs, {k for k in keys if k in r.maybe} | set(reprs))
        for e in having:
            for n, x in project:
                if x is not None and n in bare_vars(e) and n not in out.reprs:
                    out = self.extend(out, n, x, active)
            out = self.filter(out, e, active)
        return out, Query(q.form, None, project, q.distinct, None, [], order, q.limit, q.offset)

    def aggregate(self, e: tuple, r: Rel, active: Active) -> Val:
        _, name, arg, distinct, sep = e
        if arg is None:
            if distinct:
                return Val("int", F.count_distinct(F.struct(*[r.reprs[v].term(C(v)).alias(str(i)) for i, v in enumerate(r.vars)])) if r.vars else F.count(F.lit(1)))
            return Val("int", F.count(F.lit(1)))
        native = isinstance(arg, Var) and arg.name in r.reprs and r.reprs[arg.name].kind == "iri"
        v = self.expr(arg, r, active)
        if name == "COUNT":
            c = C(arg.name) if native else v.col
            return Val("int", F.count_distinct(c) if distinct else F.count(c))
        if name == "SAMPLE":
            return Val(v.kind, F.min(v.col))
        if name in ("MIN", "MAX"):
            pick = F.min if name == "MIN" else F.max
            if v.kind != "term":
                return Val(v.kind, pick(v.col))
            keyed = F.when(v.col.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order_key(v))], v.col.alias("t")))
            return Val("term", pick(keyed)["t"])
        if name == "GROUP_CONCAT":
            text = fn.str_of(v) if v.kind == "term" else v.col if v.kind in ("iri", "str") else lexical(v)
            if v.kind == "term":
                text = F.when(v.col["k"] == BNODE, "").otherwise(text)
            items = F.array_sort(F.collect_set(text) if distinct else F.collect_list(text))
            return Val("str", F.array_join(items, sep))
        return self._sum(name, v, distinct)

    def _sum(self, name: str, v: Val, distinct: bool) -> Val:
        total = F.sum_distinct if distinct else F.sum
        count = F.count_distinct if distinct else F.count
        if v.kind == "int":
            s = total(v.col)
            if name == "SUM":
                return Val("int", F.coalesce(s, F.lit(0)))
            return Val("dec", F.coalesce(F.try_divide(s.cast("decimal(28,0)"), count(v.col).cast("decimal(18,0)")).cast(DEC), F.lit(0).cast(DEC)))
        if v.kind in ("dec", "dbl", "flt"):
            c = v.col if v.kind == "dec" else v.col.cast("double")
            out = total(c) if name == "SUM" else (F.avg(c) if not distinct else total(c) / count(c))
            zero = F.lit(0).cast("double" if v.kind != "dec" else DEC)
            return Val(v.kind, F.coalesce(out.cast("double") if v.kind != "dec" else out.cast(DEC), zero))
        if v.kind != "term":
            return Val("term", F.when(F.count(v.col) == 0, number_term(F.lit(0), F.lit(0).cast(DEC), F.lit(0.0))))
        t = v.col
        rank, exact, inexact = rank_of(t), as_decimal(t), as_double(t)
        bad = F.count_if(t.isNotNull() & ((t["k"] != LITERAL) | ~F.coalesce(t["dt"].isin(*NUMERIC_DT), F.lit(False)) | inexact.isNull()))
        top = F.coalesce(F.max(rank), F.lit(0))
        if distinct:
            nums = F.array_distinct(F.collect_set(t))
            ex = F.aggregate(F.transform(nums, lambda x: F.coalesce(as_decimal(x), F.lit(0).cast(DEC))), F.lit(0).cast("decimal(38,12)"), lambda a, b: (a + b).cast("decimal(38,12)"))
            ix = F.aggregate(F.transform(nums, lambda x: F.coalesce(as_double(x), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
            n = F.size(nums)
        else:
            ex, ix, n = F.coalesce(F.sum(exact), F.lit(0)).cast(DEC), F.coalesce(F.sum(inexact), F.lit(0.0)), F.count(t)
        if name == "AVG":
            top = F.when(n == 0, 0).otherwise(F.greatest(top, F.lit(1)))
            ex = F.coalesce(F.try_divide(ex.cast("decimal(28,10)"), n.cast("decimal(18,0)")).cast(DEC), F.lit(0).cast(DEC))
            ix = F.coalesce(F.try_divide(ix, n), F.lit(0.0))
        return Val("term", F.when(bad == 0, number_term(top, ex, ix)))

    # queries

    def select(self, q: Query, active: Active) -> Rel:
        if self.mentions is None:
            names = Counter(named(q))
            self.mentions = names if not names[None] else Counter()
        r = self.pattern(q.where, active)
        return self.modify(q, r, active)

    def modify(self, q: Query, r: Rel, active: Active) -> Rel:
        grouped = q.group is not None or bool(q.having) or any(has_aggregate(e) for _, e in q.project or [] if e is not None) or any(has_aggregate(e) for e, _ in q.order)
        values, names = q.values, None
        graph = active.name if active.kind == "var" and active.name in r.reprs else None  # a query within GRAPH ?g has its solutions for each graph
        if graph and grouped and graph not in [g for g, _ in q.group or []]:
            q = replace(q, group=[*(q.group or []), (graph, Var(graph))])
        if q.project is None:
            names = sorted(v for v in r.vars if not v.startswith("?"))
            if values is not None:
                names = sorted({*names, *values.vars})
        if grouped:
            r, q = self.group(q, r, active)
        if values is not None:
            r = R.join(r, self.values(values))
        for n, e in q.project or []:
            if e is not None:
                r = self.extend(r, n, e, active)
            elif n not in r.reprs:
                r = Rel(r.df.withColumn(n, F.lit(None).cast(TERM)), r.reprs | {n: TERM_REPR}, r.maybe | {n})
        names = names if names is not None else [n for n, _ in q.project]
        names += [graph] if graph and graph not in names else []
        keys: list[tuple[Column, bool]] = []
        for e, up in q.order:
            r, v = self.value_in(e, r, active)
            keys += [(c, up) for c in order_key(v)]
        order = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in keys]
        if q.distinct:
            r2 = r.only(names)
            if order and all(isinstance(e, Var) and e.name in names for e, _ in q.order):
                r = Rel(r2.df.distinct().orderBy(*order), r2.reprs, r2.maybe)
            elif order:  # ordered by what is not projected: the first of each solution counts
                r = Rel(_first_of_each(r.df, names, keys), r2.reprs, r2.maybe)
            else:
                r = Rel(r2.df.distinct(), r2.reprs, r2.maybe)
        else:
            if order:
                r = Rel(r.df.orderBy(*order), r.reprs, r.maybe)
            r = r.only(names)
        df = r.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, r.reprs, r.maybe)

    def instantiate(self, template: list[tuple], r: Rel, with_graph: bool = False, scope: str = "") -> DataFrame:
        """The statements of a template for each solution: (g, s, p, o); illegal ones are left out; blank nodes are new for each solution and scope."""
        r = r.as_terms()
        df = r.df
        if any(isinstance(x, Term) and x.k == BNODE for t in template for x in t):
            key = F.concat_ws("|", *[F.coalesce(C(v).cast("string"), F.lit("-")) for v in r.vars])
            copies = Window.partitionBy("?key").orderBy("?key")  # equal solutions are numbered, so that ids do not depend on how tasks run
            df = df.withColumn("?key", F.sha1(key)).withColumn("?id", F.concat(C("?key"), F.lit("_"), F.row_number().over(copies).cast("string")))
        empty = F.lit(None).cast(TERM)

        def one(x: Any) -> Column:
            if x is None:
                return empty
            if isinstance(x, Var):
                return C(x.name) if x.name in r.reprs else empty
            if isinstance(x, TriplePattern):
                s, p, o = one(x.s), one(x.p), one(x.o)
                return term_col(TRIPLE, F.concat(F.lit("<<( "), nt_text(s), F.lit(" "), nt_text(p), F.lit(" "), nt_text(o), F.lit(" )>>")))
            if x.k == BNODE:
                return term_col(BNODE, F.sha1(F.concat(C("?id"), F.lit(x.v + scope))))
            return self.store.const(x).col().cast(TERM)

        rows = []
        for t in template:
            g, s, p, o = t if len(t) == 4 else (None, *t)
            ok = one(s)["k"].isin(IRI, BNODE) & (one(p)["k"] == IRI) & one(o)["k"].isNotNull()
            if g is not None:
                ok = ok & (one(g)["k"] == IRI)
            rows.append(F.when(ok, F.struct(one(g).alias("g"), one(s).alias("s"), one(p)["v"].alias("p"), one(o).alias("o"))))
        if not rows:
            return self.spark.createDataFrame([], f"g {TERM.simpleString()}, s {TERM.simpleString()}, p string, o {TERM.simpleString()}")
        out = df.select(F.explode(F.array(*rows)).alias("q")).where("q is not null")
        return out.select("q.g", "q.s", "q.p", "q.o").distinct()


def _freeze(e: Any) -> Any:
    return tuple(_freeze(x) for x in e) if isinstance(e, (tuple, list)) else e


def _first_of_each(df: DataFrame, names: list[str], keys: list[tuple[Column, bool]]) -> DataFrame:
    """The distinct rows of the named columns, in the order of the least keys that each has."""
    cols = [C(n) for n in names]
    ranked = df.select(*cols, *[c.alias(f"?k{i}") for i, (c, _) in enumerate(keys)])
    directions = {up for _, up in keys}
    made = [C(f"?k{i}") for i in range(len(keys))]
    order = [c.asc_nulls_first() if up else c.desc_nulls_last() for c, (_, up) in zip(made, keys, strict=True)]
    if len(directions) == 1:  # one direction: a partial aggregate, NULL being the least
        best = (F.min if directions == {True} else F.max)(F.struct(*made)).alias("?k")
        first = ranked.groupBy(*cols).agg(best).select(*cols, *[C("?k")[f"?k{i}"].alias(f"?k{i}") for i in range(len(keys))])
    else:
        own = Window.partitionBy(*cols).orderBy(*order)
        first = ranked.distinct().withColumn("?n", F.row_number().over(own)).where(C("?n") == 1)
    return first.orderBy(*order).select(*cols)
