"""The query engine: text in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.errors import QueryError
from quadloom.functions.values import lexical
from quadloom.plans.algebra import Query, Unit, Var
from quadloom.plans.compile import Compiler
from quadloom.plans.parser import parse_query
from quadloom.plans.rel import C, Rel, Repr
from quadloom.session import ship_code
from quadloom.store import Active, QuadStore
from quadloom.terms import IRI, NAMESPACES, TERM, term_col


@dataclass
class Solutions:
    """The result of SELECT: a relation and its variables in order."""

    rel: Rel
    vars: list[str]

    @property
    def terms(self) -> DataFrame:
        """One TERM column per variable; NULL where unbound."""
        return self.rel.as_terms().df.select(*[C(v) for v in self.vars])

    @property
    def df(self) -> DataFrame:
        """Native columns: typed where the type is known without looking at data, else the text of the term."""
        cols = []
        for v in self.vars:
            r = self.rel.reprs[v]
            if r.kind == "term":
                cols.append(C(v)["v"].alias(v))
            else:
                cols.append(r.val(C(v)).col.alias(v))
        return self.rel.df.select(*cols)

    def typed(self) -> DataFrame:
        """Native columns with the types that the data has: looks once at the datatypes of each dynamic variable."""
        dynamic = [v for v in self.vars if self.rel.reprs[v].kind == "term"]
        if not dynamic:
            return self.df
        seen = self.rel.df.agg(*[F.collect_set(F.coalesce(C(v)["dt"], F.lit("-"))).alias(f"d{i}") for i, v in enumerate(dynamic)]).first()
        types = {}
        for i, v in enumerate(dynamic):
            kinds = set(seen[f"d{i}"])
            ints = {x for x in kinds if x in ("xsd:integer", "xsd:int", "xsd:long")}
            if kinds and kinds == ints:
                types[v] = "bigint"
            elif kinds and kinds <= ints | {"xsd:double", "xsd:float", "xsd:decimal"}:
                types[v] = "double"
            elif kinds == {"xsd:boolean"}:
                types[v] = "boolean"
            elif kinds == {"xsd:date"}:
                types[v] = "date"
            else:
                types[v] = "string"
        cols = [C(v)["v"].try_cast(types[v]).alias(v) if v in types else self.rel.reprs[v].val(C(v)).col.alias(v) for v in self.vars]
        return self.rel.df.select(*cols)


class Engine:
    """Queries over one store. functions maps IRIs to Python callables from value columns to a value (see register_function)."""

    def __init__(self, spark: SparkSession, store, base: str | None = None, prefixes: dict[str, str] | None = None, transport=None, load_files: bool = False):
        """load_files lets FROM and FROM NAMED read graphs from file: IRIs."""
        ship_code(spark)
        self.load_files = load_files
        self.spark, self.store, self.base, self.transport = spark, store, base, transport
        self.prefixes = NAMESPACES | (prefixes or {})
        self.functions: dict = {}

    def register_function(self, iri: str, builder) -> None:
        """Make <iri>(...) call builder with the arguments' values (quadloom.functions.values.Val); it returns a Val or a TERM column."""
        self.functions[iri] = builder

    def parse(self, text: str) -> Query:
        return parse_query(text, self.base, self.prefixes)

    def _with_files(self, files: list[str]) -> QuadStore:
        from quadloom.sources.io import read_graph

        parts = [read_graph(self.spark, x).withColumn("g", term_col(IRI, F.lit(x)).cast(TERM)) for x in files]
        return QuadStore(reduce(DataFrame.unionByName, parts, self.store.quads))

    def _compiler(self, q: Query) -> Compiler:
        from quadloom.sources.remote import service_join

        store = self.store
        if q.default_graphs or q.named_graphs:
            files = [x for x in dict.fromkeys([*q.default_graphs, *q.named_graphs]) if self.load_files and x.startswith("file:")]
            store = (self._with_files(files) if files else store).dataset(q.default_graphs, q.named_graphs)
        service = None if self.transport is None else lambda c, n, a, left=None: service_join(c, n, a, self.transport, left)
        return Compiler(self.spark, store, self.functions, service, q.base or self.base)

    def sparql(self, text: str):
        """SELECT gives Solutions, ASK a bool, CONSTRUCT and DESCRIBE a DataFrame of (s, p, o)."""
        q = self.parse(text)
        return {"select": self._select, "ask": self._ask, "construct": self._construct, "describe": self._describe}[q.form](q)

    def select(self, text: str) -> DataFrame:
        """The native columns of a SELECT."""
        out = self.sparql(text)
        if not isinstance(out, Solutions):
            raise QueryError("not a SELECT query")
        return out.df

    def _select(self, q: Query) -> Solutions:
        r = self._compiler(q).select(q, Active())
        names = [n for n, _ in q.project] if q.project is not None else r.vars
        return Solutions(r, names)

    def _rows(self, q: Query) -> tuple[Compiler, Rel]:
        c = self._compiler(q)
        where = q.where if q.where is not None else Unit()
        star = Query("select", where, None, False, q.group, q.having, q.order, q.limit, q.offset, q.values)
        if q.group is not None:
            star.project = [(n, None) for n, _ in q.group]
            return c, c.select(star, Active())
        r = c.pattern(where, Active())
        if q.values is not None or q.order or q.limit is not None or q.offset:
            star.project = [(n, None) for n in r.vars]
            r = c.modify(star, r, Active())
        return c, r

    def _ask(self, q: Query) -> bool:
        return not self._rows(q)[1].df.limit(1).isEmpty()

    def _construct(self, q: Query) -> DataFrame:
        c, r = self._rows(q)
        return c.instantiate(q.template, r).select("s", "p", "o")

    def _describe(self, q: Query) -> DataFrame:
        c, r = self._rows(q)
        asked = q.describe if q.describe is not None else [Var(v) for v in r.vars if not v.startswith("?")]
        r = r.as_terms()
        parts = [r.df.select(C(x.name).alias("t")) for x in asked if isinstance(x, Var) and x.name in r.reprs]
        parts += [self.spark.range(1).select(c.store.const(x).col().cast(TERM).alias("t")) for x in asked if not isinstance(x, Var)]
        if not parts:
            return c.store.triples().limit(0)
        names = parts[0]
        for p in parts[1:]:
            names = names.unionByName(p)
        names = names.where("t is not null").where(F.col("t.k") == IRI if q.describe is None else F.lit(True)).distinct()
        triples = c.store.triples()
        return triples.join(names, triples["s"] == names["t"], "left_semi")


def as_solutions(df: DataFrame, names: list[str] | None = None) -> Solutions:
    """Solutions over a DataFrame of TERM columns."""
    names = names or df.columns
    return Solutions(Rel(df, {n: Repr("term") for n in names}, set(names)), names)


__all__ = ["Engine", "Solutions", "as_solutions", "lexical"]
