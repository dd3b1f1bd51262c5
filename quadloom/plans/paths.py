"""Property paths as DataFrames of (s, o[, g]) pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.plans.algebra import Path
from quadloom.session import cut
from quadloom.store import Active, equals
from quadloom.terms import Term


class PathCompiler:
    """Pairs connected by a path; start or end can be fixed to a constant, from which closures are then grown."""

    def __init__(self, store, active: Active, constants: tuple[Term, ...] = ()):
        self.store, self.active = store, active
        self.keys = ["g"] if active.kind == "var" else []
        self.constants = constants

    def seeded(self, p: Path, seeds: DataFrame) -> DataFrame:
        """The pairs of a closure or optional path whose start is among seeds (t), which are nodes of the graph: nothing else is visited."""
        same = seeds.select(F.col("t").alias("s"), F.col("t").alias("o"))
        if p.op == "opt":
            return same.unionByName(self.pairs(p.args[0]).join(seeds, F.col("s") == F.col("t"), "left_semi").select("s", "o")).distinct()
        grown = self._closure(p.args[0], None, None, seeds)
        return grown if p.op == "plus" else same.unionByName(grown).distinct()

    def _on(self, pairs: list[tuple[Column, Column]]) -> Column:
        return reduce(lambda a, b: a & b, [x == y for x, y in pairs])

    def pairs(self, p: Path, start: Term | None = None, end: Term | None = None) -> DataFrame:
        out = self._pairs(p, start, end)
        if start is not None:
            out = out.where(equals(F.col("s"), start))
        if end is not None:
            out = out.where(equals(F.col("o"), end))
        return out

    def _pairs(self, p: Path, start: Term | None, end: Term | None) -> DataFrame:
        cols = ["s", "o", *self.keys]
        match p.op:
            case "iri":
                return self.store.edges(self.active, [p.args[0]])
            case "inv":
                return self._swap(self.pairs(p.args[0], end, start))
            case "alt":
                return self.pairs(p.args[0], start, end).unionByName(self.pairs(p.args[1], start, end))
            case "seq":
                a, b = self.pairs(p.args[0], start, None), self.pairs(p.args[1], None, end)
                return self._compose(a, b)
            case "neg":
                forward, inverse = p.args
                parts = []
                if forward or not inverse:
                    parts.append(self.store.edges(self.active, but=list(forward)))
                if inverse:
                    parts.append(self._swap(self.store.edges(self.active, but=list(inverse))))
                return reduce(DataFrame.unionByName, parts)
            case "opt":
                return self._identity(start, end).unionByName(self.pairs(p.args[0], start, end)).distinct()
            case "star":
                return self._identity(start, end).unionByName(self._closure(p.args[0], start, end)).distinct()
            case "plus":
                return self._closure(p.args[0], start, end)
            case "rep":
                inner, lo, hi = p.args
                step = self.pairs(inner)
                levels, at = [], self._identity(start, None) if lo == 0 else self.pairs(inner, start).select(*cols).distinct()
                for n in range(0 if lo == 0 else 1, (hi if hi is not None else max(lo, 1)) + 1):
                    if n > (0 if lo == 0 else 1):
                        at = self._compose(at, step).distinct()
                    if n >= lo:
                        levels.append(at)
                if hi is None:
                    levels.append(self._compose(at, self._closure(inner, None, None)))
                return reduce(DataFrame.unionByName, levels).distinct()
        raise ValueError(p.op)

    def _swap(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("o").alias("s"), F.col("s").alias("o"), *self.keys)

    def _compose(self, a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("s").alias("s2"), F.col("o").alias("o2"), *[F.col(k).alias(f"{k}2") for k in self.keys])
        on = self._on([(F.col("o"), F.col("s2"))] + [(F.col(k), F.col(f"{k}2")) for k in self.keys])
        return a.join(b, on).select("s", F.col("o2").alias("o"), *self.keys)

    def _identity(self, start: Term | None, end: Term | None) -> DataFrame:
        """Zero-length paths: the nodes of the graph and the constants of the pattern."""
        fixed = start or end
        edges = self.store.edges(self.active)
        nodes = edges.select(F.col("s").alias("n"), *self.keys).unionByName(edges.select(F.col("o").alias("n"), *self.keys))
        if fixed is not None:
            if not self.keys:
                one = edges.sparkSession.range(1).select(fixed.col().alias("n"))
                return one.select(F.col("n").alias("s"), F.col("n").alias("o"))
            nodes = nodes.where(equals(F.col("n"), fixed))
        for t in self.constants:
            if not self.keys:
                nodes = nodes.unionByName(edges.sparkSession.range(1).select(t.col().alias("n")))
        return nodes.distinct().select(F.col("n").alias("s"), F.col("n").alias("o"), *self.keys)

    def _closure(self, inner: Path, start: Term | None, end: Term | None, seeds: DataFrame | None = None) -> DataFrame:
        """Semi-naive transitive closure from the bound end, from seeds, or of all pairs; each round joins only the new pairs and is checkpointed."""
        if start is None and end is not None:
            return self._swap(self._closure(Path("inv", (inner,)), end, None))
        cols = ["s", "o", *self.keys]
        step = cut(self.pairs(inner).select(*cols).distinct())
        first = step if start is None else step.where(equals(F.col("s"), start))
        if seeds is not None:
            first = step.join(seeds, F.col("s") == F.col("t"), "left_semi")
        seen = new = cut(first)
        while not new.isEmpty():
            reached = self._compose(new, step).distinct()
            other = seen.select(F.col("s").alias("s2"), F.col("o").alias("o2"), *[F.col(k).alias(f"{k}2") for k in self.keys])
            on = self._on([(F.col(c), F.col(f"{c}2")) for c in cols])
            new = cut(reached.join(other, on, "left_anti"))
            seen = seen.unionByName(new)
        return seen
