"""Remote endpoints: SPARQL over an injectable transport, bind joins in batches, and a read-only graph view."""

from __future__ import annotations

import base64
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame

from quadloom.engine import Solutions, as_solutions
from quadloom.errors import EndpointError, QueryError
from quadloom.plans import rel as R
from quadloom.plans.algebra import Var, pattern_vars
from quadloom.plans.rel import C, Rel, Repr
from quadloom.plans.render import group_text
from quadloom.sources.results import read_json
from quadloom.terms import BNODE, TERM, TRIPLE, Term

#: A transport takes (url, query text) and returns the body of a SPARQL JSON result.
Transport = Callable[[str, str], str]


def http_transport(
    timeout: float = 60, retries: int = 2, headers: dict[str, str] | None = None, default_graph: str | None = None, method: str = "auto",
    auth: tuple[str, str] | str | None = None, named_graphs: tuple[str, ...] = (), prefixes: dict[str, str] | None = None,
) -> Transport:
    """GET for short queries, POST for others; server errors are tried again after a pause, client errors are not. auth is a name and password, or a token."""
    if auth is not None:
        text = auth if isinstance(auth, str) else base64.b64encode(":".join(auth).encode()).decode()
        headers = (headers or {}) | {"Authorization": f"{'Bearer' if isinstance(auth, str) else 'Basic'} {text}"}
    declared = "".join(f"PREFIX {k}: <{v}> " for k, v in (prefixes or {}).items())

    def send(url: str, query: str) -> str:
        form = [("query", declared + query), *([("default-graph-uri", default_graph)] if default_graph else []), *[("named-graph-uri", x) for x in named_graphs]]
        data = urllib.parse.urlencode(form)
        full = f"{url}{'&' if '?' in url else '?'}{data}"
        get = method == "get" or (method == "auto" and len(full) <= 2048)
        head = {"Accept": "application/sparql-results+json"} | (headers or {})
        for attempt in range(retries + 1):
            try:
                request = urllib.request.Request(full, headers=head) if get else urllib.request.Request(url, data.encode(), head | {"Content-Type": "application/x-www-form-urlencoded"})
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return answer.read().decode()
            except urllib.error.HTTPError as e:
                if e.code < 500 or attempt == retries:
                    raise EndpointError(f"{url}: status {e.code}") from e
            except OSError as e:
                if attempt == retries:
                    raise EndpointError(f"{url}: {e}") from e
            time.sleep(0.5 * 2**attempt)
        raise EndpointError(url)

    return send


def remote_select(spark, url: str, query: str, transport: Transport) -> Solutions | bool:
    """The result of a query sent to an endpoint."""
    out = read_json(transport(url, query))
    if isinstance(out, bool):
        return out
    names, rows = out
    return as_solutions(_frame(spark, names, rows), names)


def _frame(spark, names: list[str], rows: list[dict[str, Term]]) -> DataFrame:
    data = [tuple(None if (t := row.get(n)) is None else (t.k, t.v, t.dt, t.lang, t.dir) for n in names) for row in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {TERM.simpleString()}" for n in names) or "`?unit` int")


def service_join(compiler, node, active, transport: Transport, left: Rel | None = None, batch: int = 200) -> Rel:
    """SERVICE: joined with the solutions before it by shipping their keys; sent as it stands only where they share no variable."""
    if isinstance(node.name, Var):
        raise QueryError("SERVICE with a variable endpoint")
    names, text = pattern_vars(node.inner), group_text(node.inner)
    if left is not None and any(n in left.reprs for n in names):
        return bind_join(compiler.spark, left, node.name.v, text, names, transport, batch, node.silent)
    try:
        out = read_json(transport(node.name.v, f"SELECT * {text}"))
        assert not isinstance(out, bool)
    except EndpointError:
        if not node.silent:
            raise
        return compiler.unit(active) if left is None else left
    got = Rel(_frame(compiler.spark, names, out[1]), {n: Repr("term") for n in names}, {n for n in names if any(n not in r for r in out[1])})
    return got if left is None else R.join(left, got)


def bind_join(spark, left: Rel, url: str, pattern: str, names: list[str], transport: Transport, batch: int = 200, silent: bool = False) -> Rel:
    """Join with a remote pattern by shipping the distinct bound keys of left in batches of VALUES, grouped by which of them are bound.

    Keys are streamed to the driver partition by partition, never gathered; blank nodes and triple terms, which mean nothing remotely, are not sent.
    The rows of a silent batch that fails pass without being joined.
    """
    shared = [n for n in names if n in left.reprs]
    left = left.as_terms(shared)
    keys = left.df.select(*[C(n) for n in shared]).distinct()
    for n in shared:
        keys = keys.where(C(n).isNull() | ~C(n)["k"].isin(BNODE, TRIPLE))
    parts: list[DataFrame] = []
    failed: list[dict[str, Term]] = []

    def flush(bound: tuple[str, ...], rows: list[tuple[Term, ...]]) -> None:
        values = " ".join("(" + " ".join(t.nt() for t in row) + ")" for row in rows)
        head = f"VALUES ({' '.join('?' + n for n in bound)}) {{ {values} }}" if bound else ""
        try:
            out = read_json(transport(url, f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {head} {pattern} }}"))
        except EndpointError:
            if not silent:
                raise
            failed.extend(dict(zip(bound, row, strict=True)) for row in rows)
            return
        parts.append(_frame(spark, names, out[1]))

    groups: dict[tuple[str, ...], list] = {}
    for row in keys.toLocalIterator():
        terms = {n: Term(*row[n]) for n in shared if row[n] is not None}
        bound = tuple(terms)
        groups.setdefault(bound, []).append(tuple(terms.values()))
        if len(groups[bound]) == batch:
            flush(bound, groups.pop(bound))
    for bound, rows in groups.items():
        flush(bound, rows)
    got = reduce(DataFrame.unionByName, parts) if parts else _frame(spark, names, [])
    right = Rel(got.distinct(), {n: Repr("term") for n in names}, set(names) - set(shared))
    if not failed:
        return R.join(left, right)
    lost = _frame(spark, shared, failed).select(*[C(n).alias(f"?l:{n}") for n in shared])
    on = reduce(lambda x, y: x & y, [C(n).eqNullSafe(C(f"?l:{n}")) for n in shared])
    sent, passed = (Rel(left.df.join(lost, on, how), left.reprs, left.maybe) for how in ("left_anti", "left_semi"))
    return R.union(R.join(sent, right), passed)


class RemoteGraph:
    """A read-only view of an endpoint's graph."""

    def __init__(self, spark, url: str, transport: Transport, graph: str | None = None):
        self.spark, self.url, self.transport, self.graph = spark, url, transport, graph

    def _pattern(self, s: Term | None, p: Term | None, o: Term | None) -> str:
        if any(t is not None and t.k == BNODE for t in (s, p, o)):
            raise QueryError("a blank node means nothing to a remote endpoint")
        text = " ".join(t.nt() if t is not None else f"?{n}" for n, t in zip("spo", (s, p, o), strict=True))
        return f"GRAPH <{self.graph}> {{ {text} }}" if self.graph else text

    def match(self, subject: Term | None = None, predicate: Term | None = None, object: Term | None = None) -> DataFrame:
        out = remote_select(self.spark, self.url, f"SELECT * WHERE {{ {self._pattern(subject, predicate, object)} }}", self.transport).terms
        for n, t in zip("spo", (subject, predicate, object), strict=True):
            if t is not None:
                out = out.withColumn(n, t.col().cast(TERM))
        return out.select("s", "p", "o")

    def __len__(self) -> int:
        out = read_json(self.transport(self.url, f"SELECT (COUNT(*) AS ?n) WHERE {{ {self._pattern(None, None, None)} }}"))
        return int(out[1][0]["n"].v)

    def __contains__(self, triple: tuple[Term, Term, Term]) -> bool:
        return bool(read_json(self.transport(self.url, f"ASK {{ {self._pattern(*triple)} }}")))

    def __iter__(self) -> Iterator[tuple[Term, Term, Term]]:
        for r in self.match().toLocalIterator():
            yield Term(*r["s"]), Term(*r["p"]), Term(*r["o"])

    def add(self, *_: Term) -> None:
        raise EndpointError("a remote graph is read-only")

    remove = add
