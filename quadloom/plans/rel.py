"""Relations of solutions: a DataFrame with one column per variable and what is known of each column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.functions.values import Val
from quadloom.terms import IRI, term_col


@dataclass(frozen=True)
class Repr:
    """How a column stands for terms: 'term' (TERM struct), 'iri' (template followed by a native key) or a native literal kind."""

    kind: str
    template: str = ""

    def val(self, c: Column) -> Val:
        if self.kind == "iri":
            return Val("iri", F.concat(F.lit(self.template), c.cast("string")) if self.template else c)
        return Val(self.kind, c)

    def term(self, c: Column) -> Column:
        return c if self.kind == "term" else self.val(c).term()


TERM_REPR = Repr("term")
IRI_REPR = Repr("iri")


def C(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Rel:
    """df holds a column per variable in reprs; maybe names those that can be unbound (NULL). A relation without variables keeps one dummy column."""

    df: DataFrame
    reprs: dict[str, Repr]
    maybe: set[str] = field(default_factory=set)

    @property
    def vars(self) -> list[str]:
        return list(self.reprs)

    def val(self, name: str) -> Val:
        return self.reprs[name].val(C(name))

    def as_terms(self, names: list[str] | None = None) -> Rel:
        """The same with the named columns (all by default) as TERM structs."""
        change = {n: self.reprs[n].term(C(n)) for n in (names if names is not None else self.vars) if self.reprs[n].kind != "term"}
        return Rel(self.df.withColumns(change) if change else self.df, self.reprs | dict.fromkeys(change, TERM_REPR), set(self.maybe))

    def only(self, names: list[str]) -> Rel:
        names = [n for n in names if n in self.reprs]
        df = self.df.select(*[C(n) for n in names]) if names else self.df.select(F.lit(1).alias("?unit"))
        return Rel(df, {n: self.reprs[n] for n in names}, self.maybe & set(names))


def _align(a: Rel, b: Rel, shared: list[str]) -> tuple[Rel, Rel]:
    """Shared columns in one representation on both sides."""
    differ = [v for v in shared if a.reprs[v] != b.reprs[v] or a.reprs[v].kind in ("dbl", "flt", "dec")]
    plain = [v for v in differ if a.reprs[v].kind == b.reprs[v].kind == "iri"]
    rest = [v for v in differ if v not in plain and a.reprs[v] != b.reprs[v]]

    def texts(r: Rel) -> Rel:
        if not plain:
            return r
        return Rel(r.df.withColumns({v: r.val(v).col for v in plain}), r.reprs | dict.fromkeys(plain, IRI_REPR), r.maybe)

    return texts(a).as_terms(rest), texts(b).as_terms(rest)


def _renamed(b: Rel, shared: list[str]) -> DataFrame:
    return b.df.select(*[C(v).alias(f"?r:{v}" if v in shared else v) for v in b.vars]) if b.vars else b.df.select(F.lit(1).alias("?r:unit"))


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def join(a: Rel, b: Rel) -> Rel:
    """Compatible join. Variables bound on both sides are equi-join keys; one that can be unbound matches anything where it is."""
    shared = [v for v in a.vars if v in b.reprs]
    a, b = _align(a, b, shared)
    sure = [v for v in shared if v not in a.maybe and v not in b.maybe]
    open_ = [v for v in shared if v not in sure]
    right = _renamed(b, shared)
    reprs = a.reprs | {v: r for v, r in b.reprs.items() if v not in shared}
    maybe = {v for v in reprs if (v in shared and v in a.maybe and v in b.maybe) or (v not in shared and v in a.maybe | b.maybe)}
    rc = lambda v: C(f"?r:{v}")
    keys = [C(v) == rc(v) for v in sure]
    cols = [(F.coalesce(C(v), rc(v)) if v in open_ else C(v)).alias(v) for v in reprs] or [F.lit(1).alias("?unit")]
    if not shared:
        out = a.df.crossJoin(right)  # the patterns have no variable in common
    elif not open_:
        out = a.df.join(right, _all(keys))
    elif sure:
        out = a.df.join(right, _all(keys + [C(v).isNull() | rc(v).isNull() | (C(v) == rc(v)) for v in open_]))
    else:  # rows bound on both sides meet by key; only rows with an unbound variable are compared with all
        full_a, full_b = _all([C(v).isNotNull() for v in open_]), _all([rc(v).isNotNull() for v in open_])
        loose = _all([C(v).isNull() | rc(v).isNull() | (C(v) == rc(v)) for v in open_])
        out = a.df.where(full_a).join(right.where(full_b), _all([C(v) == rc(v) for v in open_]))
        out = out.unionByName(a.df.where(~full_a).join(right, loose)).unionByName(a.df.where(full_a).join(right.where(~full_b), loose))
    return Rel(out.select(*cols), reprs, maybe)


def _rc(v: str) -> Column:
    return C(f"?r:{v}")


def _compatible(a: Rel, b: Rel, shared: list[str]) -> Column:
    return _all([C(v) == _rc(v) if v not in a.maybe | b.maybe else C(v).isNull() | _rc(v).isNull() | (C(v) == _rc(v)) for v in shared])


def _split(a: Rel, right: DataFrame, b: Rel, shared: list[str]) -> list[tuple[DataFrame, list[tuple[DataFrame, Column]]]]:
    """The rows of a in parts, each with the parts of right that can match them and the condition under which they do.

    Where some shared variable is bound on both sides it is the key, and there is one part. Otherwise rows with all shared variables bound on both sides
    meet by key, and only rows with an unbound one are compared with all. The parts of a row's right side are disjoint."""
    open_ = [v for v in shared if v in a.maybe | b.maybe]
    if not open_ or len(open_) < len(shared):
        return [(a.df, [(right, _compatible(a, b, shared))])]
    keys, loose = _all([C(v) == _rc(v) for v in shared]), _compatible(a, b, shared)
    full_a, full_b = _all([C(v).isNotNull() for v in shared]), _all([_rc(v).isNotNull() for v in shared])
    with_a, with_b = any(v in a.maybe for v in shared), any(v in b.maybe for v in shared)
    parts = [(right.where(full_b) if with_b else right, keys)] + ([(right.where(~full_b), loose)] if with_b else [])
    out = [(a.df.where(full_a) if with_a else a.df, parts)]
    return out + ([(a.df.where(~full_a), [(right, loose)])] if with_a else [])


def _unite(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def left_join(a: Rel, b: Rel, condition=None) -> Rel:
    """OPTIONAL; condition is a function of a relation over both sides' variables giving a boolean column."""
    shared = [v for v in a.vars if v in b.reprs]
    a, b = _align(a, b, shared)
    right = _renamed(b, shared).withColumn("?hit", F.lit(True))
    own = {v: r for v, r in b.reprs.items() if v not in shared}
    more = F.lit(True)
    if condition is not None:
        more = F.coalesce(condition(Rel(a.df, a.reprs | own, a.maybe | b.maybe)), F.lit(False))
    split = _split(a, right, b, shared)
    if len(split) == 1 and len(split[0][1]) == 1:
        out = a.df.join(right, split[0][1][0][1] & more, "left")
    else:  # the matches of each part, and the rows that no part matches
        rows, lone = [], []
        for left, parts in split:
            rest = left
            for part, on in parts:
                rows.append(left.join(part, on & more))
                rest = rest.join(part, on & more, "left_anti")
            lone.append(rest)
        rows = _unite(rows)
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]
        out = rows.unionByName(_unite(lone).select("*", *empty))
    cols = [(F.coalesce(C(v), _rc(v)) if v in shared and v in a.maybe else C(v)).alias(v) for v in a.reprs | own] or [F.lit(1).alias("?unit")]
    maybe = {v for v in a.maybe if not (v in shared and v not in b.maybe)} | {v for v in a.maybe if v in shared} | set(own)
    return Rel(out.select(*cols), a.reprs | own, maybe)


def _semi(a: Rel, right: DataFrame, b: Rel, shared: list[str], anti: bool, more: Column) -> DataFrame:
    """Rows of a with (without) a compatible row of right; the rows that a keyed part matches are not compared with the rest."""
    out = []
    for left, parts in _split(a, right, b, shared):
        rest = left
        for part, on in parts:
            if not anti:
                out.append(rest.join(part, on & more, "left_semi"))
            if anti or len(parts) > 1:
                rest = rest.join(part, on & more, "left_anti")
        if anti:
            out.append(rest)
    return _unite(out)


def semi(a: Rel, b: Rel, anti: bool = False, condition=None) -> Rel:
    """Rows of a with (without) a compatible row of b; condition as for left_join."""
    shared = [v for v in a.vars if v in b.reprs]
    a2, b2 = _align(a, b, shared)
    own = {v: r for v, r in b2.reprs.items() if v not in shared}
    if condition is None:
        own = {}
    b2 = b2.only(shared + list(own))
    right = _renamed(b2, shared)
    more = F.lit(True)
    if condition is not None:
        more = F.coalesce(condition(Rel(a2.df, a2.reprs | own, a2.maybe | b2.maybe)), F.lit(False))
    elif not shared:
        right = right.limit(1)
    return Rel(_semi(a2, right, b2, shared, anti, more), a2.reprs, a2.maybe)


def minus(a: Rel, b: Rel, fixed: frozenset[str] = frozenset()) -> Rel:
    """MINUS: drop rows with a compatible row of b that shares a bound variable. Variables in fixed stand for constants: they must agree but are not shared."""
    shared = [v for v in a.vars if v in b.reprs]
    free = [v for v in shared if v not in fixed]
    if not free:
        return a
    a2, b2 = _align(a, b, shared)
    right = _renamed(b2.only(shared), shared)
    some = F.lit(True)
    if all(v in a2.maybe | b2.maybe for v in free):
        some = reduce(lambda x, y: x | y, [C(v).isNotNull() & _rc(v).isNotNull() for v in free])
    if len(shared) == 1 and shared[0] in a2.maybe | b2.maybe:  # rows with the one variable unbound share nothing
        v = shared[0]
        return Rel(a2.df.join(right.where(_rc(v).isNotNull()), C(v) == _rc(v), "left_anti"), a2.reprs, a2.maybe)
    return Rel(_semi(a2, right, b2, shared, True, some), a2.reprs, a2.maybe)


def union(a: Rel, b: Rel) -> Rel:
    """Bag union; a variable missing on one side is unbound there."""
    names = [*a.vars, *[v for v in b.vars if v not in a.reprs]]
    both = [v for v in names if v in a.reprs and v in b.reprs]
    a, b = _align(a, b, both)
    reprs = {v: (a.reprs if v in a.reprs else b.reprs)[v] for v in names}

    def side(r: Rel, other: Rel) -> DataFrame:
        cols = [(C(v) if v in r.reprs else F.lit(None).cast(other.df.schema[v].dataType)).alias(v) for v in names]
        return r.df.select(*cols) if cols else r.df.select(F.lit(1).alias("?unit"))

    maybe = a.maybe | b.maybe | {v for v in names if v not in both}
    return Rel(side(a, b).unionByName(side(b, a)), reprs, maybe)


def iri_or_null(c: Column) -> Column:
    return term_col(IRI, c)
