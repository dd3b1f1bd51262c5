"""Updates: each operation makes a new version of the quads; nothing is changed in place.

A version is the base and two small tables beside it, the quads that updates took away and those they added. An operation finds its own quads, writes
them, and adjusts the small tables; the base is not written again before they have grown to `COMPACT_ROWS` or to a tenth of it, or after `COMPACT_STEPS`
operations, when all is brought together. Whole graphs are cleared by a filter and copied by writing the copy alone. Every table is checkpointed, so a
chain of updates never replays its history. Graphs that exist without statements are kept by name beside the quads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadloom.errors import QueryError
from quadloom.plans.algebra import Unit, Update
from quadloom.plans.compile import Compiler
from quadloom.plans.parser import parse_update
from quadloom.session import BROADCAST_ROWS, cut
from quadloom.store import Active, QuadStore
from quadloom.terms import IRI, QUAD, TERM, Term


#: Rows of the small tables, and operations, after which they are brought into the base.
COMPACT_ROWS, COMPACT_STEPS = 1_000_000, 32


class Dataset:
    """A versioned set of quads. loader(iri) reads the statements of LOAD as (s, p, o); without one LOAD is refused."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, short: bool = False, prefixes: dict[str, str] | None = None, loader: Callable[[str], DataFrame] | None = None):
        self.spark, self.prefixes, self.loader = spark, prefixes or {}, loader
        self.version = 0
        self.names: set[str] = set()
        self._base = spark.createDataFrame([], QUAD) if quads is None else quads.select("g", "s", "p", "o").distinct()
        self._written = quads is None  # the given quads are made distinct and written before the first change
        self._gone: DataFrame | None = None
        self._added: DataFrame | None = None
        self._rows, self._steps = 0, 0
        self.store = QuadStore(self._base, distinct=False, short=short)

    @property
    def quads(self) -> DataFrame:
        return self.store.quads

    def _start(self) -> None:
        if not self._written:
            self._base, self._written = cut(self._base), True
            self._publish()

    def _publish(self) -> None:
        quads = self._base if self._gone is None else self._without(self._base, self._gone)
        if self._added is not None:
            quads = quads.unionByName(self._added)
        self.store = self.store.with_quads(quads, distinct=False)

    def _done(self) -> None:
        self.version, self._steps = self.version + 1, self._steps + 1
        self._publish()
        if self._steps >= COMPACT_STEPS or self._rows > COMPACT_ROWS:
            self.compact()

    def compact(self) -> None:
        """Bring the small tables into the base."""
        self._base, self._gone, self._added, self._rows, self._steps = cut(self.quads), None, None, 0, 0
        self._publish()

    def update(self, text: str, base: str | None = None) -> Dataset:
        for op in parse_update(text, base, self.prefixes):
            self.apply(op)
        return self

    def add(self, quads: DataFrame) -> None:
        self._change(None, quads)

    def remove(self, quads: DataFrame) -> None:
        self._change(quads, None)

    def _change(self, gone: DataFrame | None, new: DataFrame | None) -> None:
        """A version without the quads of gone and with those of new."""
        self._start()
        if gone is not None:
            gone = cut(gone.select("g", "s", "p", "o").distinct())
            self._rows += gone.count()
        if new is not None:  # those that are there already, and stay, are not added again
            new = cut(new.select("g", "s", "p", "o").distinct())
            there = self._among(self.quads, new)
            if gone is not None:
                there = self._without(there, gone)
            new = cut(self._without(new, there))
            self._rows += new.count()
        if gone is not None:
            self._gone = gone if self._gone is None else cut(self._gone.unionByName(gone).distinct())
            if self._added is not None:
                self._added = self._without(self._added, gone)
        if new is not None:
            self._added = new if self._added is None else self._added.unionByName(new)
        if self._added is not None:
            self._added = cut(self._added)
        self._done()

    def _on(self, other: DataFrame) -> tuple[DataFrame, Column]:
        other = other.select(*[F.col(c).alias(f"{c}2") for c in "gspo"])
        on = F.col("g").eqNullSafe(F.col("g2"))
        for c in "spo":
            on = on & (F.col(c) == F.col(f"{c}2"))
        return other, on

    def _small(self, df: DataFrame) -> DataFrame:
        """df, to be copied to the executors if it has few rows; it is a written table."""
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

    def _without(self, quads: DataFrame, gone: DataFrame) -> DataFrame:
        other, on = self._on(gone)
        return quads.join(self._small(other), on, "left_anti")

    def _among(self, quads: DataFrame, asked: DataFrame) -> DataFrame:
        other, on = self._on(asked)
        return quads.join(self._small(other), on, "left_semi")

    def apply(self, op: Update) -> None:
        a = op.args
        match op.op:
            case "insert_data" | "delete_data":
                c = Compiler(self.spark, self.store)
                quads = c.instantiate(a["quads"], c.unit(Active()), with_graph=True, scope=f"@{self.version}")
                (self.add if op.op == "insert_data" else self.remove)(quads)
            case "modify":
                self._modify(a)
            case "load":
                if self.loader is None:
                    if a["silent"]:
                        return
                    raise QueryError("LOAD needs a loader")
                try:
                    got = self.loader(a["source"])
                except Exception:
                    if a["silent"]:
                        return
                    raise
                self.add(got.withColumn("g", self._name(a["into"])))
            case "clear" | "drop":
                kind, name = a["target"]
                if op.op == "drop" and kind == "graph":
                    self.names.discard(name)
                self._filter(~self._in(kind, name))
                self._done()
            case "create":
                if not a["silent"] and (a["graph"] in self.names or not self.quads.where(self._in("graph", a["graph"])).limit(1).isEmpty()):
                    raise QueryError(f"graph <{a['graph']}> exists")
                self.names.add(a["graph"])
            case "add" | "move" | "copy":
                self._transfer(op.op, a["source"], a["dest"])
            case _:
                raise QueryError(f"unknown update {op.op}")

    def _name(self, name: str | None):
        return F.lit(None).cast(TERM) if name is None else self.store.const(Term(IRI, name)).col().cast(TERM)

    def _in(self, kind: str, name: str | None):
        if kind == "all":
            return F.lit(True)
        if kind == "default":
            return F.col("g").isNull()
        if kind == "named":
            return F.col("g").isNotNull()
        return F.coalesce(F.col("g.v") == self.store.const(Term(IRI, name)).v, F.lit(False))

    def _filter(self, keep: Column) -> None:
        """Keep a part of the quads; nothing is written."""
        self._start()
        self._base, self._added = self._base.where(keep), None if self._added is None else self._added.where(keep)

    def _transfer(self, how: str, source: tuple, dest: tuple) -> None:
        if source == dest:
            return
        self._start()
        moved = self.quads.where(self._in(*source)).withColumn("g", self._name(dest[1]))
        if how == "add":
            self._change(None, moved)
            return
        moved = cut(moved)  # the copy alone
        self._filter(~self._in(*dest) & (~self._in(*source) if how == "move" else F.lit(True)))
        self._base = self._base if self._gone is None else self._without(self._base, self._gone)  # what was taken away before does not meet the copy
        self._gone = None
        self._added = moved if self._added is None else self._added.unionByName(moved)
        self._rows += moved.count()
        self._done()

    def _modify(self, a: dict) -> None:
        active = Active("iri", a["with"]) if a["with"] else Active()
        store = before = self.store
        if a["using"] or a["named"]:
            store, active = store.dataset(a["using"], a["named"]), Active()
        self._start()
        store = self.store if store is before else store
        c = Compiler(self.spark, store)
        r = c.pattern(a["where"], active) if not isinstance(a["where"], Unit) else c.unit(active)
        r.df = cut(r.df)  # the solutions are found once, before anything changes
        graph = None if a["with"] is None else Term(IRI, a["with"])

        def named(template: list[tuple]) -> list[tuple]:
            return [(graph if t[0] is None else t[0], *t[1:]) for t in template or []]

        gone = c.instantiate(named(a["delete"]), r, with_graph=True) if a["delete"] else None
        self._change(gone, c.instantiate(named(a["insert"]), r, with_graph=True, scope=f"@{self.version}") if a["insert"] else None)
