"""Registered queries of readers, writers, remote endpoints and streams, as round trips over the driver's tables, with their SQL."""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.catalog import BASE, PREFIXES, mapped_engine, quad_engine, quad_store
from quadloom.engine import Engine
from quadloom.session import scratch, table
from quadloom.sources import results as RS
from quadloom.sources.io import graph_of_text, read_graph, read_store, write_graph, write_parts
from quadloom.sources.ntriples import write_lines
from quadloom.sources.remote import RemoteGraph, remote_select
from quadloom.store import QuadStore, show
from quadloom.streaming import statements, stream_lines
from quadloom.terms import IRI, TERM, iri, term_col
from quadloom.vocabulary import load_vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Tags are read in small letters.
_READ = "SELECT DISTINCT g.v AS g, s.v AS s, p, o.k AS k, o.v AS v, o.dt AS dt, lower(o.lang) AS lang FROM quads"


def _by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*[F.col(c).alias(c.split(".")[0]) for c in cols]).agg(F.count(F.lit(1)).alias("n"))


def _customers(spark, d) -> DataFrame:
    return mapped_engine(spark, d).sparql("CONSTRUCT { ?c a :Customer ; :name ?m ; :nation ?n ; :balance ?b } WHERE { ?c a :Customer ; :name ?m ; :nation ?n ; :balance ?b }")


_CUSTOMER_ROWS = (
    f"SELECT '{BASE}customer/' || c_custkey AS s, '{RDF_TYPE}' AS p, '{BASE}v#Customer' AS o, CAST(NULL AS VARCHAR) AS dt FROM customer UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}v#name', c_name, 'xsd:string' FROM customer "
    f"UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}v#nation', '{BASE}nation/' || c_nationkey, NULL FROM customer"
)


def _text(df: DataFrame) -> DataFrame:
    return df.where(F.col("p") != f"{BASE}v#balance").select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"), F.col("o.dt").alias("dt"))


# graph formats


@register(f"SELECT p, count(*) AS n FROM ({_READ} WHERE g IS NULL) GROUP BY 1")
def ntriples_round_trip(spark, d):
    path = scratch(spark, "nt")
    write_graph(quad_store(spark, d).triples(), path)
    return _by(read_graph(spark, path, "nt", shared_labels=True), "p")


@register(f"SELECT g, count(*) AS n FROM ({_READ}) GROUP BY 1")
def nquads_round_trip(spark, d):
    path = scratch(spark, "nq")
    write_graph(table(spark, d, "quads"), path, "application/n-quads")
    return _by(read_store(spark, path, "nq", shared_labels=True).quads, "g.v")


@register(_CUSTOMER_ROWS)
def turtle_round_trip(spark, d):
    path = scratch(spark, "ttl")
    write_parts(_customers(spark, d), path, "turtle", {"": f"{BASE}v#", "xsd": "http://www.w3.org/2001/XMLSchema#"})
    return _text(read_graph(spark, path, "text/turtle"))


@register(f"SELECT g, p, count(*) AS n FROM ({_READ}) GROUP BY 1, 2")
def trig_round_trip(spark, d):
    path = scratch(spark, "trig")
    write_parts(table(spark, d, "quads").select("g", "s", "p", "o"), path, "trig", {"m": "http://parl.example/member/"})
    return _by(read_graph(spark, path, "trig", shared_labels=True), "g.v", "p")


@register(_CUSTOMER_ROWS)
def jsonld_round_trip(spark, d):
    path = scratch(spark, "jsonld")
    write_parts(_customers(spark, d), path, "jsonld", context={"v": f"{BASE}v#", "name": f"{BASE}v#name"})
    return _text(read_graph(spark, path, "jsonld"))


@register(f"SELECT g, count(*) AS n FROM ({_READ}) GROUP BY 1")
def jsonld_graphs_round_trip(spark, d):
    path = scratch(spark, "jsonld")
    write_parts(table(spark, d, "quads").select("g", "s", "p", "o"), path, "application/ld+json")
    return _by(read_graph(spark, path, "jsonld", shared_labels=True), "g.v")


def _wrapped(lines: DataFrame, head: str, foot: str) -> DataFrame:
    """A document per partition: its lines between a first and a last one."""

    def wrap(batches: Iterator[pd.DataFrame], head: str, foot: str) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        yield from batches
        yield pd.DataFrame({"value": [foot]})

    return lines.toDF("value").mapInPandas(partial(wrap, head=head, foot=foot), "value string")


@register(_CUSTOMER_ROWS)
def rdfxml_read(spark, d):
    c = table(spark, d, "customer")
    node = F.format_string(f'<v:Customer rdf:about="customer/%d"><v:name>%s</v:name><v:nation rdf:resource="{BASE}nation/%d"/></v:Customer>', "c_custkey", "c_name", "c_nationkey")
    path = scratch(spark, "rdf")
    _wrapped(c.select(node), f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:v="{BASE}v#" xml:base="{BASE}">', "</rdf:RDF>").write.text(path)
    return _text(read_graph(spark, path, "application/rdf+xml"))


@register(f"SELECT p, count(*) AS n FROM ({_READ} WHERE g IS NULL) GROUP BY 1")
def stream_round_trip(spark, d):
    source, sink, progress = (scratch(spark, x) for x in ("lines", "statements", "progress"))
    write_lines(quad_store(spark, d).triples(), source)
    query = statements(stream_lines(spark, source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return _by(spark.read.parquet(sink).distinct(), "p")


# query results

_ASKED = "SELECT ?n ?b ?p { ?c a :Customer ; :name ?n ; :balance ?b OPTIONAL { ?c :segment ?p FILTER(?p = 'BUILDING') } }"
_ANSWER = "SELECT c_name AS n, c_acctbal AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment END AS p FROM customer"


def _documents(spark, d, fmt: str) -> DataFrame:
    path = scratch(spark, fmt)
    RS.write_results_dir(mapped_engine(spark, d).sparql(_ASKED), path, fmt)
    return spark.read.text(path, wholetext=True)


def _json_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text in batch["value"]:
            names, rows = RS.read_json(text)
            yield pd.DataFrame([[r[n].v if n in r else None for n in names] for r in rows], columns=names, dtype=object)


@register(_ANSWER)
def results_json(spark, d):
    return _documents(spark, d, "json").mapInPandas(_json_rows, "n string, b string, p string").withColumn("b", F.col("b").cast("double"))


def _xml_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ns = "{http://www.w3.org/2005/sparql-results#}"
    for batch in batches:
        for text in batch["value"]:
            rows = [{b.get("name"): b[0].text for b in r} for r in ET.fromstring(text).iter(f"{ns}result")]
            yield pd.DataFrame([[r.get(n) for n in "nbp"] for r in rows], columns=list("nbp"), dtype=object)


@register(_ANSWER)
def results_xml(spark, d):
    return _documents(spark, d, "xml").mapInPandas(_xml_rows, "n string, b string, p string").withColumn("b", F.col("b").cast("double"))


@register(_ANSWER)
def results_csv(spark, d):
    path = scratch(spark, "csv")
    RS.write_results_dir(mapped_engine(spark, d).sparql(_ASKED), path, "text/csv")
    return spark.read.csv(path, header=True, schema="n string, b double, p string")


@register(_ANSWER)
def results_tsv(spark, d):
    path = scratch(spark, "tsv")
    RS.write_results_dir(mapped_engine(spark, d).sparql(_ASKED), path, "tsv")
    parts = F.split("value", "\t", -1)
    plain = lambda i: F.regexp_extract(parts[i], r'^"(.*?)"', 1)
    return spark.read.text(path).select(plain(0).alias("n"), plain(1).cast("double").alias("b"), F.nullif(plain(2), F.lit("")).alias("p"))


@register("SELECT 'json' AS format, count(*) > 0 AS answer FROM customer UNION ALL SELECT 'xml', count(*) > 0 FROM customer UNION ALL SELECT 'csv', NULL UNION ALL SELECT 'tsv', NULL")
def results_ask(spark, d):
    answer, rows = mapped_engine(spark, d).sparql("ASK { ?c a :Customer }"), []
    for fmt in ("json", "xml", "csv", "tsv"):
        out = io.StringIO()
        try:
            RS.write_results(out, answer, fmt)
            rows.append((fmt, json.loads(out.getvalue())["boolean"] if fmt == "json" else "<boolean>true</boolean>" in out.getvalue()))
        except RS.QueryError:  # a yes or no has no table
            rows.append((fmt, None))
    return spark.createDataFrame(rows, "format string, answer boolean")


@register("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def results_read(spark, d):
    out = io.StringIO()
    RS.write_results(out, mapped_engine(spark, d).sparql("SELECT ?n ?r { ?x a :Nation ; :name ?n ; :region/:name ?r }"), "application/sparql-results+json")
    return RS.read_solutions(spark, out.getvalue()).df


@register("SELECT c_custkey AS k, c_acctbal AS b, c_name AS n FROM customer")
def typed_columns(spark, d):
    """Columns whose types are found in the data: the terms are stored ones."""
    store = QuadStore(_customers(spark, d).withColumn("g", F.lit(None).cast(TERM)), distinct=False)
    found = Engine(spark, store, prefixes=PREFIXES).sparql("SELECT (xsd:integer(STRAFTER(STR(?c), 'customer/')) AS ?k) ?b ?n { ?c :balance ?b ; :name ?n }")
    return found.typed()


# endpoints, answered by an engine over the same tables


def _transport(spark, d):
    def send(url: str, query: str) -> str:
        out = io.StringIO()
        RS.write_results(out, mapped_engine(spark, d).sparql(query), "json")
        return out.getvalue()

    return send


@register("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 12")
def service_bind_join(spark, d):
    engine = mapped_engine(spark, d)
    engine.transport = _transport(spark, d)
    return engine.select(f"SELECT ?n ?r {{ ?x a :Nation ; :name ?n ; :region ?g FILTER(xsd:integer(STRAFTER(STR(?x), 'nation/')) < 12) SERVICE <http://remote.example/> {{ ?g <{BASE}v#name> ?r }} }}")


@register("SELECT count(*) AS n FROM nation, region")
def service_whole(spark, d):
    engine = mapped_engine(spark, d)
    engine.transport = _transport(spark, d)
    return engine.select(f"SELECT (COUNT(*) AS ?n) {{ ?x a :Nation SERVICE SILENT <http://remote.example/> {{ ?g a <{BASE}v#Region> }} }}")


@register("SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
def remote_query(spark, d):
    return remote_select(spark, "http://remote.example/", f"SELECT ?n {{ ?x <{BASE}v#region> <{BASE}region/1> ; <{BASE}v#name> ?n }}", _transport(spark, d)).df


@register("SELECT 3 * count(*) AS size, 2 AS types, true AS has FROM nation")
def remote_graph(spark, d):
    nations = mapped_engine(spark, d).sparql("CONSTRUCT { ?x a :Nation ; :name ?n ; :region ?r } WHERE { ?x a :Nation ; :name ?n ; :region ?r }").withColumn("g", F.lit(None).cast(TERM))
    far = Engine(spark, QuadStore(nations, distinct=False))

    def send(url: str, query: str) -> str:
        out = io.StringIO()
        RS.write_results(out, far.sparql(query), "json")
        return out.getvalue()

    g, third = RemoteGraph(spark, "http://remote.example/", send), iri(f"{BASE}nation/3")
    links = g.match(subject=third).where(F.col("o.k") == IRI).count()
    return spark.createDataFrame([(len(g), links, (third, iri(RDF_TYPE), iri(f"{BASE}v#Nation")) in g)], "size long, types int, has boolean")


# vocabularies, dataset clauses by path, text of graphs


@register(f"SELECT '{BASE}v#' || r_name AS term, r_name AS label FROM region WHERE NOT contains(r_name, ' ')")
def vocabulary_terms(spark, d):
    path = scratch(spark, "vocabulary")
    named = table(spark, d, "region").where("r_name not like '% %'").select(F.format_string(f'<{BASE}v#%s> <http://www.w3.org/2000/01/rdf-schema#label> "%s"@en .', "r_name", "r_name"))
    named.write.text(path)
    v = load_vocabulary(spark, path, f"{BASE}v#", "nt")
    return spark.createDataFrame([(v[t[len(v.base) :]], v.label(t, "en")) for t in v.terms], "term string, label string")


@register(f"SELECT p, count(*) AS n FROM ({_READ} WHERE g.v = 'http://parl.example/desk/west') GROUP BY 1")
def from_files(spark, d):
    path = scratch(spark, "west") + ".nt"
    write_graph(table(spark, d, "quads").where("g.v = 'http://parl.example/desk/west'").select("s", "p", "o"), path)
    at = path if path.startswith("file:") else f"file://{path}"
    engine = quad_engine(spark, d)
    engine.load_files = True
    return engine.select(f"SELECT ?p (COUNT(*) AS ?n) FROM <{at}> {{ ?s ?p ?o }} GROUP BY ?p")


@register("SELECT count(*) || ' statements' AS head, 7 AS lines FROM (SELECT DISTINCT s, p, o FROM quads WHERE g IS NULL)")
def shown_graph(spark, d):
    text = show(quad_store(spark, d).triples(), 5).split("\n")
    return spark.createDataFrame([(text[0], len(text))], "head string, lines int")


@register("SELECT a AS name, b AS next FROM (SELECT n_name AS a, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL")
def collections_read(spark, d):
    """Lists written in Turtle and matched as such: the nations of a region in order."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))  # a region's nations
    lines = n.select(F.format_string(":region%d :members ( %s ) .", "n_regionkey", F.array_join(F.transform("x", lambda v: F.concat(F.lit('"'), v["n_name"], F.lit('"'))), " ")).alias("value"))
    path = scratch(spark, "lists")
    _wrapped(lines, f"@prefix : <{BASE}v#> .", "").write.text(path)
    engine = Engine(spark, read_store(spark, path, "turtle"), prefixes=PREFIXES)
    return engine.select("SELECT ?name ?next { ?r :members/rdf:rest* ?l . ?l rdf:first ?name ; rdf:rest/rdf:first ?next }")


@register("SELECT c_name AS n, 'b' AS kind FROM customer WHERE c_custkey = 1")
def embedded_text(spark, d):
    """A statement of a text joined with a mapped one."""
    note = graph_of_text(spark, f"<{BASE}customer/1> <{BASE}v#kind> \"b\" .", "turtle").withColumn("g", term_col(IRI, F.lit(f"{BASE}notes")).cast(TERM))
    kinds = Engine(spark, QuadStore(note)).select(f"SELECT ?c ?kind {{ GRAPH ?g {{ ?c <{BASE}v#kind> ?kind }} }}")
    names = mapped_engine(spark, d).select("SELECT ?c ?n { ?c a :Customer ; :name ?n }")
    return names.join(kinds, "c").select("n", "kind")
