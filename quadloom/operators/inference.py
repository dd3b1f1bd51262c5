"""RDFS inference by rules, as semi-naive fixpoints over DataFrames of (s, p, o)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.session import BROADCAST_ROWS, cut
from quadloom.terms import BNODE, IRI, RDF, RDFS, Term, term_col

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, MEMBER = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range", RDFS + "member"
#: Short names of the rules.
RULES = ("domain", "range", "subclass", "subproperty", "container")


def _iri(c: Column) -> Column:
    return term_col(IRI, c)


def _pairs(df: DataFrame, p: str) -> DataFrame:
    """(a, b): the IRIs a statement of schema relates."""
    return df.where((F.col("p") == p) & (F.col("o.k") == IRI) & (F.col("s.k") == IRI)).select(F.col("s.v").alias("a"), F.col("o.v").alias("b")).distinct()


def transitive(pairs: DataFrame) -> DataFrame:
    """The transitive closure of (a, b) by doubling: its rounds grow with the logarithm of the longest chain."""
    seen = cut(pairs.distinct())
    n = seen.count()
    while True:
        again = seen.select(F.col("a").alias("a2"), F.col("b").alias("b2"))
        seen = cut(seen.unionByName(seen.join(again, F.col("b") == F.col("a2")).select("a", F.col("b2").alias("b"))).distinct())
        if (m := seen.count()) == n:
            return seen
        n = m


def _new(rows: DataFrame, *known: DataFrame) -> DataFrame:
    for k in known:
        k = k.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
        rows = rows.join(k, (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2")) & (F.col("o") == F.col("o2")), "left_anti")
    return rows


SCHEMA = (SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be copied to the executors up to a checked size."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _schema(known: DataFrame) -> dict[str, DataFrame]:
    """(a, b) of each relation of the schema: closed for classes and properties."""
    rows = cut(known.where(F.col("p").isin(*SCHEMA)))
    out = {p: transitive(_pairs(rows, p)) for p in (SUBCLASS, SUBPROPERTY)}
    return out | {p: cut(_pairs(rows, p)) for p in (DOMAIN, RANGE)}


def infer_rdfs(triples: DataFrame, rules: tuple[str, ...] = RULES, reflexive: bool = False) -> DataFrame:
    """The statements that follow from triples under the rules, without those already there.

    The closures of the schema are made once, and again only when a round finds schema statements beyond them; then the rules go over all statements once
    more. Otherwise a round joins only the statements that the last one found. What is known is a list of parts, none of which is written twice.
    reflexive adds `C subClassOf C` for each class.
    """
    empty = triples.select("s", "p", "o").limit(0)
    delta = cut(triples.select("s", "p", "o").distinct())
    parts, out, schema = [delta], [], None
    while True:
        if schema is None or any(not _pairs(delta, p).join(schema[p], ["a", "b"], "left_anti").isEmpty() for p in SCHEMA):
            schema, rows, fresh = _schema(reduce(DataFrame.unionByName, parts)), reduce(DataFrame.unionByName, parts), True
        else:
            rows, fresh = delta, False
        classes, props = schema[SUBCLASS], schema[SUBPROPERTY]
        link = lambda pairs, p: pairs.select(_iri(F.col("a")).alias("s"), F.lit(p).alias("p"), _iri(F.col("b")).alias("o"))
        got: list[DataFrame] = []
        if "subclass" in rules:
            if fresh:
                got.append(link(classes, SUBCLASS))
            if fresh and reflexive:
                got.append(link(classes.select("a").union(classes.select("b")).distinct().select("a", F.col("a").alias("b")), SUBCLASS))
            types = rows.where((F.col("p") == TYPE) & (F.col("o.k") == IRI))
            got.append(types.join(_small(classes), F.col("o.v") == F.col("a")).select("s", "p", _iri(F.col("b")).alias("o")))
        if "subproperty" in rules:
            if fresh:
                got.append(link(props, SUBPROPERTY))
            got.append(rows.join(_small(props), F.col("p") == F.col("a")).select("s", F.col("b").alias("p"), "o"))
        if "domain" in rules:
            got.append(rows.join(_small(schema[DOMAIN]), F.col("p") == F.col("a")).select("s", F.lit(TYPE).alias("p"), _iri(F.col("b")).alias("o")))
        if "range" in rules:
            resources = rows.where(F.col("o.k").isin(IRI, BNODE))
            got.append(resources.join(_small(schema[RANGE]), F.col("p") == F.col("a")).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), _iri(F.col("b")).alias("o")))
        if "container" in rules:
            got.append(rows.where(F.col("p").rlike("^" + RDF.replace(".", r"\.") + r"_[1-9][0-9]*$")).select("s", F.lit(MEMBER).alias("p"), "o"))
        delta = cut(_new(reduce(DataFrame.unionByName, got, empty).distinct(), reduce(DataFrame.unionByName, parts)))
        if delta.isEmpty():
            return reduce(DataFrame.unionByName, out, empty)
        out.append(delta)
        parts.append(delta)


def entails(triples: DataFrame, s: Term, p: Term, o: Term, regime: str = "rdfs") -> bool:
    """Whether a statement holds, simply or under RDFS."""
    from quadloom.store import equals

    def there(df: DataFrame) -> bool:
        return not df.where(equals(F.col("s"), s) & (F.col("p") == p.v) & equals(F.col("o"), o)).limit(1).isEmpty()

    return there(triples) or (regime == "rdfs" and there(infer_rdfs(triples)))
