"""Vocabularies: the terms of a namespace with their labels and comments."""

from __future__ import annotations

import urllib.request

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.sources.io import graph_of_text, read_graph
from quadloom.terms import IRI, RDFS


def load_vocabulary(spark: SparkSession, source: str, base: str, format: str | None = None) -> Vocabulary:
    """The vocabulary below base of a file, or of a document behind an http address."""
    if source.startswith(("http://", "https://")):
        request = urllib.request.Request(source, headers={"Accept": "text/turtle, application/n-triples, application/rdf+xml"})
        with urllib.request.urlopen(request, timeout=60) as answer:
            kind = format or answer.headers.get_content_type()
            triples = graph_of_text(spark, answer.read().decode(), kind, source)
    else:
        triples = read_graph(spark, source, format)
    return Vocabulary(triples.select("s", "p", "o"), base)


class Vocabulary:
    """Terms below a base IRI that a graph describes; a vocabulary is small, so its index is held by the driver up to `limit` terms."""

    def __init__(self, triples: DataFrame, base: str, limit: int = 100_000):
        self.base = base
        about = triples.where((F.col("s.k") == IRI) & F.col("s.v").startswith(base)).select(F.col("s.v").alias("t"), "p", "o")
        rows = about.where(F.col("p").isin(RDFS + "label", RDFS + "comment")).collect() if about.select("t").distinct().limit(limit + 1).count() <= limit else None
        if rows is None:
            raise ValueError(f"more than {limit} terms")
        self.terms = sorted(r["t"] for r in about.select("t").distinct().collect())
        self._texts: dict[tuple[str, str], list[tuple[str | None, str]]] = {}
        for r in rows:
            self._texts.setdefault((r["t"], r["p"]), []).append((r["o"]["lang"], r["o"]["v"]))
        self._names = {t[len(base) :]: t for t in self.terms}

    def __getattr__(self, name: str) -> str:
        if name.startswith("_") or name not in self.__dict__.get("_names", {}):
            raise AttributeError(name)
        return self._names[name]

    def __getitem__(self, name: str) -> str:
        return self._names[name]

    def __contains__(self, name: str) -> bool:
        return name in self._names

    def _text(self, term: str, p: str, lang: str | None) -> str | None:
        texts = sorted(self._texts.get((term, p), []), key=lambda x: (x[0] != lang, x[0] is not None, x[0] or "", x[1]))
        return texts[0][1] if texts else None

    def label(self, term: str, lang: str | None = None) -> str | None:
        return self._text(term, RDFS + "label", lang)

    def comment(self, term: str, lang: str | None = None) -> str | None:
        return self._text(term, RDFS + "comment", lang)
