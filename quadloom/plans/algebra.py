"""The algebra that queries are translated to; a node holds its inputs and nothing about execution."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quadloom.terms import Term


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class TriplePattern:
    """A triple term with variables in it."""

    s: Any
    p: Any
    o: Any

    def __str__(self) -> str:
        return f"<<( {self.s} {self.p} {self.o} )>>"


@dataclass(frozen=True)
class Path:
    """op: iri, seq, alt, inv, star, plus, opt, neg, rep; args as the operator needs."""

    op: str
    args: tuple


@dataclass
class BGP:
    triples: list[tuple]


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    expr: Any = None


@dataclass
class Filter:
    expr: Any
    inner: Any


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Graph:
    name: Any
    inner: Any


@dataclass
class Extend:
    inner: Any
    var: str
    expr: Any


@dataclass
class Values:
    vars: list[str]
    rows: list[tuple[Term | None, ...]]


@dataclass
class Service:
    name: Any
    inner: Any
    silent: bool
    text: str


@dataclass
class Unit:
    pass


@dataclass
class Query:
    """form: select, ask, construct, describe."""

    form: str
    where: Any = None
    project: list[tuple[str, Any]] | None = None
    distinct: bool = False
    group: list[tuple[str, Any]] | None = None
    having: list[Any] = field(default_factory=list)
    order: list[tuple[Any, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    values: Values | None = None
    template: list[tuple] | None = None
    describe: list[Any] | None = None
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    base: str | None = None


@dataclass
class Update:
    """One operation: op names it, args hold what it needs."""

    op: str
    args: dict[str, Any]


def pattern_vars(node: Any) -> list[str]:
    """The variables in scope of a pattern, in order of appearance."""
    out: dict[str, None] = {}

    def term(t: Any) -> None:
        if isinstance(t, Var):
            out[t.name] = None
        elif isinstance(t, TriplePattern):
            for x in (t.s, t.p, t.o):
                term(x)

    def walk(n: Any) -> None:
        if isinstance(n, BGP):
            for t in n.triples:
                for x in t:
                    term(x)
        elif isinstance(n, (Join, LeftJoin, Union)):
            walk(n.left)
            walk(n.right)
        elif isinstance(n, Minus):
            walk(n.left)
        elif isinstance(n, Filter):
            walk(n.inner)
        elif isinstance(n, (Graph, Service)):
            term(n.name)
            walk(n.inner)
        elif isinstance(n, Extend):
            walk(n.inner)
            out[n.var] = None
        elif isinstance(n, Values):
            out.update(dict.fromkeys(n.vars))
        elif isinstance(n, Query):
            if n.project is None:
                walk(n.where)
            else:
                out.update((v, None) for v, _ in n.project)

    walk(node)
    return [v for v in out if not v.startswith("?")]  # names from blank nodes begin with '?'
