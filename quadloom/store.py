"""Graph data as tables: stored quads, and relational tables seen as a graph through a mapping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.functions.builtins import triple_part
from quadloom.plans.algebra import TriplePattern, Var
from quadloom.plans.rel import IRI_REPR, TERM_REPR, Rel, Repr
from quadloom.terms import IRI, LITERAL, NAMESPACES, RDF, TRIPLE, Term, term_col

TYPE = RDF + "type"


@dataclass(frozen=True)
class Active:
    """The active graph: kind 'default', 'iri' (name), 'var' (name), or 'union' of all."""

    kind: str = "default"
    name: str = ""


def equals(c: Column, t: Term) -> Column:
    """Term equality with a constant."""
    out = (c["k"] == t.k) & (c["v"] == t.v)
    if t.k == LITERAL:
        for f in ("dt", "lang", "dir"):
            x = getattr(t, f)
            out = out & (c[f] == x if x is not None else c[f].isNull())
    return out


def show(quads: DataFrame, rows: int = 10) -> str:
    """A text of the first statements, as N-Quads, and of the number of all."""
    from quadloom.sources.ntriples import line_text

    named = "g" in quads.columns
    lines = [r[0] for r in quads.select(line_text(named).alias("x")).orderBy("x").limit(rows).collect()]
    n = quads.count()
    return "\n".join([f"{n} statement{'' if n == 1 else 's'}", *lines, *(["..."] if n > len(lines) else [])])


class QuadStore:
    """Quads (g, s, p, o) with g NULL for the default graph.

    Statements are a set: with distinct=True (the default) repeated ones are dropped by each scan, below its filters; pass False for tables that are
    already sets. short=True says that vocabulary IRIs stand in the table in their prefixed form, so that constants of queries are shortened likewise.
    """

    def __init__(self, quads: DataFrame, distinct: bool = True, short: bool = False, prefixes: dict[str, str] | None = None):
        self.quads = quads.select("g", "s", "p", "o")
        self.distinct, self.short = distinct, short
        self.counts: dict[str, tuple[int, int, int]] = {}
        self.prefixes = {ns: name for name, ns in (NAMESPACES | (prefixes or {})).items()}

    def __str__(self) -> str:
        return show(self.quads)

    def const(self, t: Term) -> Term:
        if self.short and t.k == IRI:
            for ns, name in self.prefixes.items():
                if t.v.startswith(ns):
                    return Term(IRI, f"{name}:{t.v[len(ns) :]}")
        return t

    def analyse(self, limit: int = 100_000) -> QuadStore:
        """The store with the counts of its predicates, by which queries order their patterns; the driver holds those of at most `limit` predicates."""
        rows = self.statistics().orderBy(F.desc("n")).limit(limit).collect()
        self.counts = {r["p"]: (r["n"], r["subjects"], r["objects"]) for r in rows}
        return self

    def estimate(self, s: Any, p: Any, o: Any) -> float | None:
        """How many solutions a pattern has by the counts of its predicate, or None before `analyse`."""
        if not self.counts:
            return None
        n, subjects, objects = self.counts.get(self.const(p).v, (1, 1, 1)) if isinstance(p, Term) else [sum(x) for x in zip(*self.counts.values(), strict=True)]
        return n / (max(1, subjects) if isinstance(s, Term) else 1) / (max(1, objects) if isinstance(o, Term) else 1)

    def with_quads(self, quads: DataFrame, distinct: bool = True) -> QuadStore:
        out = QuadStore(quads, distinct, self.short)
        out.prefixes, out.counts = self.prefixes, self.counts
        return out

    def _graph(self, active: Active) -> DataFrame:
        q = self.quads
        if active.kind == "default":
            return q.where(q["g"].isNull())
        if active.kind == "iri":
            return q.where((F.col("g.k") == IRI) & (F.col("g.v") == self.const(Term(IRI, active.name)).v))
        if active.kind == "var":
            return q.where(q["g"].isNotNull())
        return q

    def scan(self, s: Any, p: Any, o: Any, active: Active) -> Rel:
        """The solutions of one triple pattern."""
        df = self._graph(active)
        if isinstance(p, Term):
            df = df.where(F.col("p") == self.const(p).v)
        names: dict[str, list[Column]] = {}
        reprs: dict[str, Repr] = {}
        conds: list[Column] = []

        def bind(x: Any, c: Column, r: Repr) -> None:
            if isinstance(x, Var):
                if x.name in names:
                    conds.append(names[x.name][1] == (r.term(c) if r.kind != "term" else c))
                else:
                    names[x.name] = [c, r.term(c) if r.kind != "term" else c]
                    reprs[x.name] = r
            elif isinstance(x, TriplePattern):
                conds.append(c["k"] == TRIPLE)
                for i, part in enumerate((x.s, x.p, x.o)):
                    bind(part, triple_part(c, i), TERM_REPR)
            else:
                conds.append(equals(c, self.const(x)))

        bind(s, F.col("s"), TERM_REPR)
        if isinstance(p, Var):
            bind(p, F.col("p"), IRI_REPR)
        bind(o, F.col("o"), TERM_REPR)
        for c in conds:
            df = df.where(c)
        keep_g = active.kind == "var"
        if self.distinct:
            df = df.select("g", "s", "p", "o").distinct() if keep_g or active.kind != "union" else df.select("s", "p", "o").distinct()
        cols = [c[0].alias(n) for n, c in names.items()]
        if keep_g:
            if active.name in names:
                df = df.where(names[active.name][1] == F.col("g"))
            else:
                cols.append(F.col("g").alias(active.name))
                reprs[active.name] = TERM_REPR
        return Rel(df.select(*cols) if cols else df.select(F.lit(1).alias("?unit")), reprs)

    def star(self, s: Any, pos: list[tuple[Any, Any]], active: Active, allowed: dict[str, set[str]] | None = None, unused: bool = False) -> Rel | None:
        return None

    def restrict(self, stars: dict[Any, list[tuple]]) -> dict[str, set[str]]:
        return {}

    def edges(self, active: Active, forward: list[str] | None = None, but: list[str] | None = None) -> DataFrame:
        """(s, o[, g]) of the statements of given predicates, or of all but given ones."""
        df = self._graph(active)
        if forward is not None:
            df = df.where(F.col("p").isin([self.const(Term(IRI, x)).v for x in forward]))
        if but:
            df = df.where(~F.col("p").isin([self.const(Term(IRI, x)).v for x in but]))
        cols = ["s", "o"] + (["g"] if active.kind == "var" else [])
        return df.select("p", *cols).distinct().select(*cols) if self.distinct else df.select(*cols)

    def triples(self, active: Active | None = None) -> DataFrame:
        """(s, p, o) of a graph, as a set."""
        return self._graph(active or Active()).select("s", "p", "o").distinct()

    def dataset(self, default: list[str], named: list[str]) -> QuadStore:
        """The store as a FROM clause sees it: the named graphs of default merged, those of named kept."""
        q, name = self.quads, F.col("g.v")
        d = q.where(name.isin([self.const(Term(IRI, x)).v for x in default])).withColumn("g", F.lit(None).cast(q.schema["g"].dataType)) if default else q.limit(0)
        n = q.where(name.isin([self.const(Term(IRI, x)).v for x in named])) if named else q.limit(0)
        return self.with_quads(d.unionByName(n))

    # pattern scans outside of queries

    def match(self, subject: Term | None = None, predicate: Term | None = None, object: Term | None = None, graph: str | None = "default") -> DataFrame:
        """Rows (g, s, p, o) of a pattern; None is a wildcard; graph is 'default', an IRI, or None for all graphs."""
        active = Active("union") if graph is None else Active() if graph == "default" else Active("iri", graph)
        df = self._graph(active)
        if subject is not None:
            df = df.where(equals(F.col("s"), self.const(subject)))
        if predicate is not None:
            df = df.where(F.col("p") == self.const(predicate).v)
        if object is not None:
            df = df.where(equals(F.col("o"), self.const(object)))
        return df.select("g", "s", "p", "o").distinct() if self.distinct else df

    def subjects(self, **pattern: Any) -> DataFrame:
        return self.match(**pattern).select("s")

    def predicates(self, **pattern: Any) -> DataFrame:
        return self.match(**pattern).select("p")

    def objects(self, **pattern: Any) -> DataFrame:
        return self.match(**pattern).select("o")

    def contains(self, s: Term, p: Term, o: Term, graph: str | None = "default") -> bool:
        return not self.match(s, p, o, graph).limit(1).isEmpty()

    def statistics(self) -> DataFrame:
        """(p, n, subjects, objects) of each predicate."""
        return self.quads.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


@dataclass
class TableMap:
    """A table as subjects of one class: key gives the rest of the subject's IRI; properties map predicates to columns.

    A property is ('lit', column, kind) with a native kind, ('tag', column, language column), or ('ref', column, template) for an IRI.
    """

    name: str
    load: Callable[[], DataFrame]
    template: str
    key: str
    cls: str
    properties: dict[str, tuple]

    @cached_property
    def df(self) -> DataFrame:
        """The table, opened when a pattern first needs it."""
        return self.load()


def _native(kind: str, c: Column, t: Term) -> Column:
    """Equality of a native column with a constant."""
    if t.k != LITERAL:
        return F.lit(False)
    if kind == "str":
        return (c == t.v) if t.dt == "xsd:string" else F.lit(False)
    wanted = {"int": "xsd:integer", "dbl": "xsd:double", "dec": "xsd:decimal", "bool": "xsd:boolean", "date": "xsd:date", "time": "xsd:dateTime"}[kind]
    if t.dt != wanted:
        return F.lit(False)
    target = {"int": "bigint", "dbl": "double", "dec": "decimal(38,12)", "bool": "boolean", "date": "date", "time": "timestamp_ntz"}[kind]
    return c == F.lit(t.v).try_cast(target)


class MappedStore:
    """Relational tables as a virtual graph: star-shaped patterns over one table become one scan, links become joins of keys."""

    distinct = False

    def __init__(self, tables: list[TableMap]):
        self.tables = tables

    def const(self, t: Term) -> Term:
        return t

    def estimate(self, s: Any, p: Any, o: Any) -> float | None:
        return None

    def _has(self, t: TableMap, p: str, o: Any) -> bool:
        if p == TYPE:
            return isinstance(o, Var) or (o.k == IRI and o.v == t.cls)
        if p not in t.properties:
            return False
        kind, _, x = t.properties[p]
        return not (kind == "ref" and isinstance(o, Term) and not (o.k == IRI and o.v.startswith(x)))

    def _fits(self, s: Any, pos: list[tuple[Any, Any]], allowed: dict[str, set[str]]) -> list[TableMap]:
        """The tables that have all (predicate, object) of a subject, as far as the kinds of its variables allow."""

        def fit(t: TableMap) -> bool:
            if isinstance(s, Term):
                if not s.v.startswith(t.template):
                    return False
            elif t.template not in allowed.get(s.name, {t.template}):
                return False
            for p, o in pos:
                if not self._has(t, p.v, o):
                    return False
                if isinstance(o, Var) and (k := self._kind(t, p.v)) not in allowed.get(o.name, {k}):
                    return False
            return True

        return [t for t in self.tables if fit(t)]

    @staticmethod
    def _kind(t: TableMap, p: str) -> str:
        """What a property's objects are: the template of its IRIs, or a mark for classes and literals."""
        if p == TYPE:
            return "?class"
        kind, _, x = t.properties[p]
        return x if kind == "ref" else "?literal"

    def restrict(self, stars: dict[Any, list[tuple]]) -> dict[str, set[str]]:
        """The templates each variable can stand for, narrowed until all stars agree: a link's target settles which tables its end can be in."""
        allowed: dict[str, set[str]] = {}
        while True:
            before = {v: set(k) for v, k in allowed.items()}
            for s, group in stars.items():
                pos = [(p, o) for _, p, o in group]
                fits = self._fits(s, pos, allowed)
                if isinstance(s, Var):
                    allowed[s.name] = {t.template for t in fits}
                for p, o in pos:
                    if isinstance(o, Var):
                        allowed[o.name] = {self._kind(t, p.v) for t in fits}
            if allowed == before:
                return allowed

    def star(self, s: Any, pos: list[tuple[Any, Any]], active: Active, allowed: dict[str, set[str]] | None = None, unused: bool = False) -> Rel | None:
        """One scan for all (predicate, object) of a subject; a union over the tables that have them all; None if a predicate is a variable. The key of a
        subject that nothing else names (unused) is left out."""
        if active.kind != "default" or any(not isinstance(p, Term) for p, _ in pos):
            return None
        fits = self._fits(s, pos, allowed or {}) or self._fits(s, pos, {})
        rels = [self._one(t, s, pos, unused) for t in fits]
        if not rels:
            return None
        from quadloom.plans.rel import union

        return reduce(union, rels)

    def _one(self, t: TableMap, s: Any, pos: list[tuple[Any, Any]], unused: bool = False) -> Rel:
        df, cols, reprs, conds = t.df, {}, {}, []
        key = F.expr(t.key)

        def put(v: Var, c: Column, r: Repr) -> None:
            if v.name in cols:
                a, b = (cols[v.name], c) if reprs[v.name] == r else (reprs[v.name].term(cols[v.name]), r.term(c))
                conds.append(a == b)
            else:
                cols[v.name], reprs[v.name] = c, r

        if isinstance(s, Var):
            if not unused:
                put(s, key, Repr("iri", t.template))
        else:
            conds.append(key.cast("string") == s.v[len(t.template) :])
        for p, o in pos:
            if p.v == TYPE:
                if isinstance(o, Var):
                    put(o, F.lit(t.cls), IRI_REPR)
                continue
            kind, column, x = t.properties[p.v]
            c = F.expr(column)
            if isinstance(o, Term):
                if kind == "ref":
                    conds.append(c.cast("string") == o.v[len(x) :])
                elif kind == "tag":
                    conds.append((c == o.v) & (F.lower(F.expr(x)) == o.lang) if o.lang else F.lit(False))
                else:
                    conds.append(_native(x, c, o))
                continue
            conds.append(c.isNotNull())
            if kind == "ref":
                put(o, c, Repr("iri", x))
            elif kind == "tag":
                put(o, term_col(LITERAL, c, F.lit("rdf:langString"), F.lower(F.expr(x))), TERM_REPR)
            else:
                put(o, c, Repr(x))
        for c in conds:
            df = df.where(c)
        out = [c.alias(n) for n, c in cols.items()]
        return Rel(df.select(*out) if out else df.select(F.lit(1).alias("?unit")), reprs)

    def scan(self, s: Any, p: Any, o: Any, active: Active) -> Rel:
        if isinstance(p, Term):
            if (got := self.star(s, [(p, o)], active)) is not None:
                return got
        return QuadStore(self.quads, distinct=False).scan(s, p, o, active)

    @property
    def quads(self) -> DataFrame:
        """All statements, materialised from one pass over each table."""
        parts = []
        for t in self.tables:
            subject = term_col(IRI, F.concat(F.lit(t.template), F.expr(t.key).cast("string")))
            rows = [F.struct(F.lit(TYPE).alias("p"), Term(IRI, t.cls).col().alias("o"))]
            for p, (kind, column, x) in t.properties.items():
                c = F.expr(column)
                r = Repr("iri", x) if kind == "ref" else None
                o = r.term(c) if r else term_col(LITERAL, c, F.lit("rdf:langString"), F.lower(F.expr(x))) if kind == "tag" else Repr(x).term(c)
                rows.append(F.struct(F.lit(p).alias("p"), o.alias("o")))
            got = t.df.select(subject.alias("s"), F.explode(F.array(*rows)).alias("x")).select("s", F.col("x.p").alias("p"), F.col("x.o").alias("o")).where("o is not null")
            parts.append(got.select(F.lit(None).cast("struct<k:tinyint,v:string,dt:string,lang:string,dir:string>").alias("g"), "s", "p", "o"))
        return reduce(DataFrame.unionByName, parts)

    def edges(self, active: Active, forward: list[str] | None = None, but: list[str] | None = None) -> DataFrame:
        if forward is not None and len(forward) == 1 and (r := self.star(Var("s"), [(Term(IRI, forward[0]), Var("o"))], active)) is not None:
            return r.as_terms().df.select("s", "o")
        return QuadStore(self.quads, distinct=False).edges(active, forward, but)

    def triples(self, active: Active | None = None) -> DataFrame:
        return self.quads.select("s", "p", "o")

    def dataset(self, default: list[str], named: list[str]) -> QuadStore:
        return QuadStore(self.quads.limit(0))
