"""Registered queries of the operations on whole graphs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.catalog import BASE, PREFIXES, mapped_engine, quad_engine, quad_store
from quadloom.engine import Engine
from quadloom.errors import QueryError
from quadloom.functions.values import Val
from quadloom.operators import context as C, graphs as G, inference as I, shacl, validation as V
from quadloom.plans.update import Dataset
from quadloom.session import scratch, table
from quadloom.sources.io import graph_of_text, read_graph, write_graph
from quadloom.sources.turtle import subject_blocks
from quadloom.store import Active, QuadStore
from quadloom.streaming import session_counts, windowed_counts
from quadloom.terms import IRI, TERM, Term, iri, literal, term_col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
WEST, PRESS = "http://parl.example/desk/west", "http://parl.example/desk/press"
COPY = "http://parl.example/desk/copy"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _text(df: DataFrame) -> DataFrame:
    """(s, p, o, dt) texts of statements."""
    return df.select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"), F.col("o.dt").alias("dt"))


@register(f"SELECT '{BASE}customer/' || c_custkey AS s, '{BASE}v#inRegion' AS p, '{BASE}region/' || n_regionkey AS o, CAST(NULL AS VARCHAR) AS dt FROM customer JOIN nation ON c_nationkey = n_nationkey")
def construct(spark, d):
    return _text(mapped_engine(spark, d).sparql("CONSTRUCT { ?c :inRegion ?r } WHERE { ?c a :Customer ; :nation/:region ?r }"))


@register(f"SELECT '{BASE}nation/3' AS s, '{RDF_TYPE}' AS p, '{BASE}v#Nation' AS o, CAST(NULL AS VARCHAR) AS dt UNION ALL SELECT '{BASE}nation/3', '{BASE}v#name', n_name, 'xsd:string' FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{BASE}nation/3', '{BASE}v#region', '{BASE}region/' || n_regionkey, NULL FROM nation WHERE n_nationkey = 3")
def describe(spark, d):
    return _text(mapped_engine(spark, d).sparql(f"DESCRIBE <{BASE}nation/3>"))


@register("SELECT count(*) > 0 AS answer FROM orders WHERE o_orderstatus = 'P'")
def ask(spark, d):
    return spark.createDataFrame([(mapped_engine(spark, d).sparql("ASK { ?o :status 'P' ; :customer ?c }"),)], "answer boolean")


def _graph(spark, d, name: str) -> DataFrame:
    return quad_store(spark, d).triples(Active("iri", name))


def _set_sql(op: str) -> str:
    part = "SELECT DISTINCT s, p, o FROM quads WHERE g.v = '{}'"
    return f"SELECT s.v AS s, p, o.v AS o, o.dt AS dt FROM ({part.format(WEST)} {op} {part.format(PRESS)})"


@register(_set_sql("UNION"))
def set_union(spark, d):
    return _text(G.union(_graph(spark, d, WEST), _graph(spark, d, PRESS), rename=False))


@register(_set_sql("INTERSECT"))
def set_intersect(spark, d):
    return _text(G.intersect(_graph(spark, d, WEST), _graph(spark, d, PRESS)))


@register(_set_sql("EXCEPT"))
def set_difference(spark, d):
    return _text(G.difference(_graph(spark, d, WEST), _graph(spark, d, PRESS)))


@register("SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o FROM quads WHERE g IS NULL AND s.v = 'http://parl.example/speech/1')")
def match_subject(spark, d):
    return quad_store(spark, d).match(subject=iri("http://parl.example/speech/1")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT DISTINCT s.v AS s FROM quads WHERE g IS NULL AND p = 'rdf:type' AND o.k = 1 AND o.v = 'parl:Speech'")
def match_predicate_object(spark, d):
    return quad_store(spark, d).subjects(predicate=iri(RDF_TYPE), object=iri("parl:Speech")).select("s.v").withColumnRenamed("v", "s")


@register("SELECT g.v AS g, p, count(*) AS n FROM (SELECT DISTINCT g, s, p, o FROM quads WHERE o.v = 'http://parl.example/member/1' AND o.k = 1) GROUP BY 1, 2")
def match_object_all_graphs(spark, d):
    return quad_store(spark, d).match(object=iri("http://parl.example/member/1"), graph=None).groupBy(F.col("g.v").alias("g"), "p").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM quads GROUP BY 1")
def predicate_statistics(spark, d):
    return quad_store(spark, d).statistics()


@register("SELECT count(*) AS n FROM (SELECT DISTINCT s, o FROM quads WHERE g IS NULL AND p = 'parl:keyword') a JOIN (SELECT DISTINCT s FROM quads WHERE g IS NULL AND p = 'rdf:type' AND o.v = 'parl:Speech') b ON a.s = b.s JOIN (SELECT DISTINCT s, o FROM quads WHERE g IS NULL AND p = 'parl:inSitting') c ON a.s = c.s")
def statistics_order(spark, d):
    """A star whose patterns are ordered by the counts of their predicates."""
    store = quad_store(spark, d).analyse()
    return Engine(spark, store, BASE, PREFIXES).select("SELECT (COUNT(*) AS ?n) { ?s a parl:Speech ; parl:inSitting ?t ; parl:keyword ?k }")


_SCHEMA = "@prefix : <http://data.example/v#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :Nation rdfs:subClassOf :Place . :Region rdfs:subClassOf :Place . :Place rdfs:subClassOf :Thing . :region rdfs:domain :Member ; rdfs:range :Group ; rdfs:subPropertyOf :within ."


@register(
    f"WITH t AS (SELECT '{BASE}v#Place' AS c UNION ALL SELECT '{BASE}v#Thing') "
    f"SELECT '{BASE}nation/' || n_nationkey AS s, '{RDF_TYPE}' AS p, c AS o FROM nation, t UNION ALL SELECT '{BASE}region/' || r_regionkey, '{RDF_TYPE}', c FROM region, t "
    f"UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{RDF_TYPE}', '{BASE}v#Member' FROM nation UNION ALL SELECT DISTINCT '{BASE}region/' || n_regionkey, '{RDF_TYPE}', '{BASE}v#Group' FROM nation "
    f"UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{BASE}v#within', '{BASE}region/' || n_regionkey FROM nation "
    f"UNION ALL SELECT '{BASE}v#' || x, 'http://www.w3.org/2000/01/rdf-schema#subClassOf', '{BASE}v#Thing' FROM (VALUES ('Nation'), ('Region')) v(x)"
)
def rdfs_inference(spark, d):
    engine = mapped_engine(spark, d)
    data = engine.sparql("CONSTRUCT { ?n a :Nation ; :region ?r } WHERE { ?n a :Nation ; :region ?r }").unionByName(engine.sparql("CONSTRUCT { ?r a :Region } WHERE { ?r a :Region }"))
    schema = graph_of_text(spark, _SCHEMA, "turtle").select("s", "p", "o")
    return I.infer_rdfs(data.unionByName(schema)).select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


_CUSTOMER_SCHEMA = "@prefix : <http://data.example/v#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :Customer rdfs:subClassOf :Party . :Party rdfs:subClassOf :Agent . :nation rdfs:domain :Resident ; rdfs:range :Place ; rdfs:subPropertyOf :within ."


@register(
    f"SELECT '{BASE}customer/' || c_custkey AS s, '{RDF_TYPE}' AS p, '{BASE}v#' || c AS o FROM customer, (VALUES ('Party'), ('Agent'), ('Resident')) t(c) "
    f"UNION ALL SELECT DISTINCT '{BASE}nation/' || c_nationkey, '{RDF_TYPE}', '{BASE}v#Place' FROM customer "
    f"UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}v#within', '{BASE}nation/' || c_nationkey FROM customer "
    f"UNION ALL SELECT '{BASE}v#Customer', 'http://www.w3.org/2000/01/rdf-schema#subClassOf', '{BASE}v#Agent'"
)
def rdfs_inference_customers(spark, d):
    data = mapped_engine(spark, d).sparql("CONSTRUCT { ?c a :Customer ; :nation ?n } WHERE { ?c a :Customer ; :nation ?n }")
    schema = graph_of_text(spark, _CUSTOMER_SCHEMA, "turtle").select("s", "p", "o")
    return I.infer_rdfs(data.unionByName(schema)).select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"))


_SHAPES = """@prefix : <http://data.example/v#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:S a sh:NodeShape ; sh:targetClass :Supplier ; sh:property [ sh:path :balance ; sh:datatype xsd:double ; sh:minInclusive 0.0 ; sh:minCount 1 ] ,
 [ sh:path :name ; sh:maxLength 30 ; sh:pattern "[02468]$" ] , [ sh:path ( :nation :name ) ; sh:in ( "FRANCE" "GERMANY" "JAPAN" "CHINA" ) ] ."""


@register(
    f"SELECT '{BASE}supplier/' || s_suppkey AS focus, 'MinInclusiveConstraintComponent' AS component FROM supplier WHERE s_acctbal < 0 "
    f"UNION ALL SELECT '{BASE}supplier/' || s_suppkey, 'PatternConstraintComponent' FROM supplier WHERE NOT regexp_matches(s_name, '[02468]$') "
    f"UNION ALL SELECT '{BASE}supplier/' || s_suppkey, 'InConstraintComponent' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT IN ('FRANCE', 'GERMANY', 'JAPAN', 'CHINA')"
)
def shacl_report(spark, d):
    engine = mapped_engine(spark, d)
    data = engine.sparql("CONSTRUCT { ?s a :Supplier ; :balance ?b ; :name ?n ; :nation ?t . ?t :name ?m } WHERE { ?s a :Supplier ; :balance ?b ; :name ?n ; :nation ?t . ?t :name ?m }")
    report = shacl.validate_shapes(spark, data, graph_of_text(spark, _SHAPES, "turtle"))
    return report.select(F.col("focus.v").alias("focus"), "component")


@register(
    "SELECT DISTINCT s.v AS s, p, o.v AS o FROM quads WHERE o.k = 2 AND ("
    + " OR ".join(f"(o.dt = 'xsd:{k}' AND NOT regexp_matches(o.v, '{V.LEXICAL[k]}'))" for k in ("integer", "decimal", "double", "boolean", "date", "dateTime", "dateTimeStamp"))
    + " OR (o.dt IN ('xsd:long', 'xsd:int') AND NOT regexp_matches(o.v, '^[+-]?[0-9]+$')))"
)
def literal_warnings(spark, d):
    return V.literal_warnings(table(spark, d, "quads")).where("warning = 'ill_typed_literal'").select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o")).distinct()


@register("SELECT DISTINCT s.v AS src, o.v AS dst FROM quads WHERE p = 'parl:mentions' AND o.k IN (0, 1)")
def edge_projection(spark, d):
    return G.edges(table(spark, d, "quads"), "parl:mentions").select(F.col("src.v").alias("src"), F.col("dst.v").alias("dst"))


@register("SELECT t.v AS t, count(*) AS degree FROM (SELECT s AS t FROM (SELECT DISTINCT s, p, o FROM quads WHERE g IS NULL) UNION ALL SELECT o FROM (SELECT DISTINCT s, p, o FROM quads WHERE g IS NULL)) WHERE t.k IN (0, 1) GROUP BY t ORDER BY 2 DESC, 1 LIMIT 20")
def degree_top(spark, d):
    return G.degrees(quad_store(spark, d).triples()).select(F.col("t.v").alias("t"), "degree").orderBy(F.desc("degree"), "t").limit(20)


@register("SELECT count(*) AS triples, (SELECT count(*) FROM (SELECT s AS t FROM quads WHERE g IS NULL UNION SELECT o FROM quads WHERE g IS NULL)) AS nodes, (SELECT count(DISTINCT p) FROM quads WHERE g IS NULL) AS predicates FROM (SELECT DISTINCT s, p, o FROM quads WHERE g IS NULL)")
def indexed_triples(spark, d):
    t, n, p = G.indexed_triples(quad_store(spark, d).triples())
    whole = t.agg(F.count(F.lit(1)).alias("triples"))
    return whole.crossJoin(n.agg(F.max("id").alias("nodes"))).crossJoin(p.agg(F.max("id").alias("predicates")))  # one row each


@register("WITH RECURSIVE e AS (SELECT doc_id AS a, reissue_of AS b FROM documents WHERE reissue_of IS NOT NULL UNION SELECT reissue_of, doc_id FROM documents WHERE reissue_of IS NOT NULL), r AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a) SELECT v, min(w) AS component FROM r GROUP BY 1")
def connected_components(spark, d):
    docs = table(spark, d, "documents").where("reissue_of is not null")
    return G.components(docs.select(F.col("doc_id").alias("src"), F.col("reissue_of").alias("dst")))


@register()
def pagerank(spark, d):
    r = G.pagerank(G.edges(table(spark, d, "quads"), "parl:mentions"), tolerance=1e-6)
    return r.select(F.col("v.v").alias("v"), F.round("rank", 9).alias("rank"))


@register("WITH t AS (SELECT DISTINCT s, p, o FROM quads WHERE g IS NULL) SELECT s.v AS s, p, o.v AS o, o.dt AS dt FROM t WHERE (s.k = 1 AND s.v = 'http://parl.example/member/1') OR (o.k = 1 AND o.v = 'http://parl.example/member/1' AND p <> 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type')")
def ego_graph_1hop(spark, d):
    seed = spark.range(1).select(iri("http://parl.example/member/1").col().cast(TERM).alias("t"))
    return _text(C.ego_graph(quad_store(spark, d).triples(), seed, 1))


@register("SELECT DISTINCT s.v AS s, p, o.v AS o, o.dt AS dt FROM quads WHERE g IS NULL AND s.v = 'http://parl.example/speech/1'")
def concise_description(spark, d):
    seed = spark.range(1).select(iri("http://parl.example/speech/1").col().cast(TERM).alias("t"))
    return _text(C.concise_description(quad_store(spark, d).triples(), seed))


@register("SELECT p, count(*) AS statements, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, max(n) > 1 AS multi FROM (SELECT *, count(*) OVER (PARTITION BY s, p) AS n FROM (SELECT DISTINCT s, p, o FROM quads WHERE g IS NULL)) GROUP BY 1")
def describe_schema(spark, d):
    return C.describe_schema(quad_store(spark, d).triples())["properties"].drop("datatypes")


_VEC = "embedding::DOUBLE[]"


@register(f"SELECT vec_id AS key, round(list_cosine_similarity({_VEC}, (SELECT {_VEC} FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity({_VEC}, (SELECT {_VEC} FROM embeddings WHERE vec_id = 1)) DESC, vec_id LIMIT 10")
def knn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 1").select("embedding").first()[0]
    return C.EmbeddingIndex(e, "vec_id", "embedding").knn(query, 10).select("key", F.round("score", 6).alias("score"))


@register(f"SELECT query, key, round(score, 6) AS score FROM (SELECT a.vec_id AS query, b.vec_id AS key, list_cosine_similarity(a.{_VEC}, b.{_VEC}) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, key) <= 5")
def knn_join(spark, d):
    e = table(spark, d, "embeddings")
    index = C.EmbeddingIndex(e, "vec_id", "embedding")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return index.knn_join(queries, 5).select("query", "key", F.round("score", 6).alias("score"))


@register(f"WITH w AS (SELECT DISTINCT s, p, o FROM quads WHERE g.v = '{WEST}') SELECT s.v AS s, CASE WHEN p = 'parl:keyword' THEN 'parl:tag' ELSE p END AS p, count(*) AS n FROM w WHERE p <> 'dcterms:subject' GROUP BY 1, 2")
def update_modify(spark, d):
    west = _modified(spark, d).quads.where(F.col("g.v") == WEST)
    return west.groupBy(F.col("s.v").alias("s"), "p").agg(F.count(F.lit(1)).alias("n"))


def _modified(spark, d) -> Dataset:
    """All quads after the updates of one graph."""
    ds = Dataset(spark, table(spark, d, "quads"), short=True, prefixes=PREFIXES | {"dcterms": "http://purl.org/dc/terms/"})
    ds.update(f"WITH <{WEST}> DELETE {{ ?s parl:keyword ?o }} INSERT {{ ?s parl:tag ?o }} WHERE {{ ?s parl:keyword ?o }}")
    return ds.update(f"DELETE WHERE {{ GRAPH <{WEST}> {{ ?s dcterms:subject ?o }} }}")


@register(
    f"WITH t AS (SELECT g, s, p, o, coalesce(g.v = '{WEST}', false) AS west FROM quads) "
    "SELECT g.v AS g, p, count(*) AS n FROM (SELECT DISTINCT g, s, CASE WHEN west AND p = 'parl:keyword' THEN 'parl:tag' ELSE p END AS p, o FROM t WHERE NOT (west AND p = 'dcterms:subject')) GROUP BY 1, 2"
)
def update_modify_all(spark, d):
    return _modified(spark, d).quads.groupBy(F.col("g.v").alias("g"), "p").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT g.v AS g, count(*) AS n FROM (SELECT g, s, p, o FROM quads WHERE g.v IN ('{WEST}', '{PRESS}') UNION SELECT {{'k': 1::TINYINT, 'v': 'http://parl.example/desk/copy', 'dt': NULL, 'lang': NULL, 'dir': NULL}}, s, p, o FROM quads WHERE g.v = '{WEST}') WHERE g.v <> '{PRESS}' GROUP BY 1")
def update_graphs(spark, d):
    return _by_graph(_copied(spark, d).quads.where(F.col("g.v").isin(WEST, COPY)))


def _copied(spark, d) -> Dataset:
    """All quads after one graph is copied and one dropped."""
    return Dataset(spark, table(spark, d, "quads"), short=True).update(f"COPY <{WEST}> TO <{COPY}> ; DROP GRAPH <{PRESS}>")


def _by_graph(quads: DataFrame) -> DataFrame:
    return quads.groupBy(F.col("g.v").alias("g")).agg(F.count(F.lit(1)).alias("n"))


@register(
    f"WITH t AS (SELECT DISTINCT g.v AS g, s, p, o FROM quads WHERE coalesce(g.v, '') <> '{COPY}') "
    f"SELECT g, count(*) AS n FROM (SELECT * FROM t UNION ALL SELECT '{COPY}', s, p, o FROM t WHERE g = '{WEST}') WHERE coalesce(g, '') <> '{PRESS}' GROUP BY 1"
)
def update_graphs_all(spark, d):
    return _by_graph(_copied(spark, d).quads)


@register("SELECT event_type AS key, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour").select("key", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@register("SELECT user_id AS key, count(*) AS sessions FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events) WHERE fresh = 1 GROUP BY 1")
def session_windows(spark, d):
    s = session_counts(table(spark, d, "events"), "ts", "user_id", "30 minutes")
    return s.groupBy("key").agg(F.count(F.lit(1)).alias("sessions"))


@register(f"""SELECT '<{BASE}customer/' || c_custkey || '> a :Customer ;' || chr(10) || '    :name "' || c_name || '" ;' || chr(10) || '    :nation <{BASE}nation/' || c_nationkey || '> .' AS text FROM customer""")
def turtle_blocks(spark, d):
    return subject_blocks(mapped_engine(spark, d).sparql("CONSTRUCT { ?c a :Customer ; :name ?m ; :nation ?n } WHERE { ?c a :Customer ; :name ?m ; :nation ?n }"), {"": f"{BASE}v#"}).select("text")


@register("SELECT s.v AS s, o.v AS o FROM (SELECT DISTINCT s, o FROM quads WHERE g IS NULL AND p = 'parl:inSitting' AND s.v <> 'http://parl.example/speech/1')")
def path_neg_filter(spark, d):
    return quad_engine(spark, d).select("SELECT ?s ?o { ?s parl:inSitting ?o FILTER(?s != <http://parl.example/speech/1>) }")



# parts of matches, term ids, membership

_DEFAULT = "(SELECT DISTINCT s, p, o FROM quads WHERE g IS NULL)"
SPEECH = "http://parl.example/speech/1"


@register(f"SELECT 'p' AS part, p AS v, count(*) AS n FROM {_DEFAULT} WHERE o.k = 1 AND o.v = 'http://parl.example/member/1' GROUP BY 2 UNION ALL SELECT 'o', o.v, count(*) FROM {_DEFAULT} WHERE p = 'rdf:type' GROUP BY 2")
def match_parts(spark, d):
    store = quad_store(spark, d)
    p = store.predicates(object=iri("http://parl.example/member/1")).select(F.lit("p").alias("part"), F.col("p").alias("v"))
    o = store.objects(predicate=iri(RDF_TYPE)).select(F.lit("o").alias("part"), F.col("o.v").alias("v"))
    return p.unionByName(o).groupBy("part", "v").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT 'keyword' AS pattern, count(*) AS n FROM {_DEFAULT} WHERE p = 'parl:keyword' UNION ALL SELECT 'object', count(*) FROM {_DEFAULT} WHERE o.k = 1 AND o.v = 'http://parl.example/member/1' UNION ALL SELECT 'absent', 0")
def match_by_ids(spark, d):
    ids, nodes, predicates = G.indexed_triples(quad_store(spark, d).triples())
    member, absent = (G.id_of(nodes, iri(f"http://parl.example/{x}")) for x in ("member/1", "no/such"))
    asked = {"keyword": G.match_ids(ids, p=G.id_of(predicates, "parl:keyword")), "object": G.match_ids(ids, o=member), "absent": G.match_ids(ids, s=absent)}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("pattern"), "n") for name, df in asked.items()])


@register(f"SELECT count(*) AS n, true AS ordered FROM {_DEFAULT}")
def each_id_in_order(spark, d):
    """The scan by ids, with whether each row's subject is at least that of any row of an earlier partition."""
    ids = G.each_id(G.indexed_triples(quad_store(spark, d).triples())[0])
    parts = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("s_id").alias("lo"), F.max("s_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    pairs = parts.join(parts.select(F.col("part").alias("p2"), F.col("hi").alias("h2")), F.col("p2") == F.col("part") - 1, "left")  # a row a partition
    return pairs.agg(F.sum("n").alias("n"), F.min(F.coalesce(F.col("h2") <= F.col("lo"), F.lit(True))).alias("ordered"))


@register(f"SELECT true AS has, false AS lacks, (SELECT count(*) FROM {_DEFAULT}) AS size, false AS empty")
def membership(spark, d):
    store = quad_store(spark, d)
    one = store.triples().where("o.k = 1").orderBy("s.v", "p", "o.v").first()
    has = store.contains(Term(*one["s"]), iri(one["p"]), Term(*one["o"]))
    lacks = store.contains(iri("http://parl.example/none"), iri(one["p"]), Term(*one["o"]))
    return store.match().agg(F.lit(has).alias("has"), F.lit(lacks).alias("lacks"), F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) == 0).alias("empty"))


# whole graphs


@register(f"SELECT count(*) AS n FROM (SELECT s, p, o FROM quads WHERE g.v = '{WEST}' UNION SELECT s, p, o FROM quads WHERE g.v = '{PRESS}')")
def merge_graphs(spark, d):
    ds = Dataset(spark, _graph(spark, d, WEST).withColumn("g", F.lit(None).cast(TERM)), short=True)
    ds.add(_graph(spark, d, PRESS).withColumn("g", F.lit(None).cast(TERM)))
    return ds.quads.agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT true AS part, false AS whole, true AS same, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM quads WHERE g.v = '{WEST}')) AS n")
def compare_graphs(spark, d):
    west, few = _graph(spark, d, WEST), _graph(spark, d, WEST).where("p = 'parl:keyword'")
    return west.agg(F.lit(G.is_subgraph(few, west)).alias("part"), F.lit(G.equal(few, west)).alias("whole"), F.lit(G.equal(west, west)).alias("same"), F.count(F.lit(1)).alias("n"))


@register("SELECT true AS renamed, false AS changed, true AS datasets")
def isomorphic_graphs(spark, d):
    """Graphs that differ in the names of their blank nodes, or also in one statement."""
    quads = table(spark, d, "quads").select("g", "s", "p", "o")
    blank = quads.where("s.k = 0 or o.k = 0").distinct()
    other = blank.withColumn("o", F.when(F.col("p") == "parl:rel001", iri("http://parl.example/other").col().cast(TERM)).otherwise(F.col("o")))
    same = G.isomorphic(blank, G.relabel(blank, "x"))
    return spark.createDataFrame([(same, G.isomorphic(blank, other), G.isomorphic_datasets(blank, G.relabel(blank, "y")))], "renamed boolean, changed boolean, datasets boolean")


@register("SELECT count(*) AS n, (SELECT count(DISTINCT o) FROM quads WHERE o.k = 0) AS blank, 0 AS after, count(*) AS back FROM (SELECT DISTINCT g, s, p, o FROM quads)")
def skolem_round_trip(spark, d):
    quads = table(spark, d, "quads").select("g", "s", "p", "o").distinct()
    named = G.skolemize(quads)
    back = G.deskolemize(named).intersect(quads).agg(F.count(F.lit(1)).alias("back"))
    counts = quads.agg(F.count(F.lit(1)).alias("n")).crossJoin(G.blank_nodes(quads).agg(F.count(F.lit(1)).alias("blank")))
    return counts.crossJoin(G.blank_nodes(named).agg(F.count(F.lit(1)).alias("after"))).crossJoin(back)  # one row each


# updates


def _dataset(spark, d) -> Dataset:
    return Dataset(spark, table(spark, d, "quads"), short=True, prefixes=PREFIXES | {"dcterms": "http://purl.org/dc/terms/"})


_COUNTS = "SELECT g.v AS g, count(*) AS n FROM (SELECT DISTINCT g, s, p, o FROM quads) GROUP BY 1"


@register(f"SELECT g, CASE WHEN g IS NULL THEN n + 2 WHEN g = '{WEST}' THEN n + 1 ELSE n END AS n FROM ({_COUNTS})")
def update_data(spark, d):
    ds = _dataset(spark, d)
    ds.update(f"INSERT DATA {{ <{BASE}new/1> parl:keyword 'a' , 'b' , 'c' . GRAPH <{WEST}> {{ <{BASE}new/1> parl:keyword 'a' , 'd' }} }}")
    ds.update(f"INSERT DATA {{ <{BASE}new/1> parl:keyword 'a' }} ; DELETE DATA {{ <{BASE}new/1> parl:keyword 'c' , 'never' . GRAPH <{WEST}> {{ <{BASE}new/1> parl:keyword 'd' }} }}")
    return _by_graph(ds.quads)


@register(f"SELECT g, n FROM ({_COUNTS}) UNION ALL SELECT 'http://data.example/loaded', count(*) FROM (SELECT DISTINCT s, p, o FROM quads WHERE g.v = '{PRESS}')")
def update_load(spark, d):
    path = scratch(spark, "load") + ".nt"
    write_graph(table(spark, d, "quads").where(F.col("g.v") == PRESS).select("s", "p", "o"), path)
    at = path if path.startswith("file:") else f"file://{path}"
    ds = _dataset(spark, d)
    ds.loader = lambda source: read_graph(spark, source, "nt").select("s", "p", "o")
    return _by_graph(ds.update(f"LOAD <{at}> INTO GRAPH d:loaded ; LOAD SILENT <file:///none> INTO GRAPH d:none").quads)


@register("SELECT 'created' AS what, true AS ok UNION ALL SELECT 'again', false UNION ALL SELECT 'silent', true UNION ALL SELECT 'existing', false")
def update_create(spark, d):
    rows, ds = [], _dataset(spark, d)
    for what, text in (("created", "CREATE GRAPH d:fresh"), ("again", "CREATE GRAPH d:fresh"), ("silent", "CREATE SILENT GRAPH d:fresh"), ("existing", f"CREATE GRAPH <{WEST}>")):
        try:
            ds.update(text)
            rows.append((what, True))
        except QueryError:
            rows.append((what, False))
    return spark.createDataFrame(rows, "what string, ok boolean")


@register(f"SELECT CASE WHEN g IS NULL THEN 'default' WHEN g = '{COPY}' THEN 'copy' ELSE 'other' END AS kind, sum(n)::BIGINT AS n FROM (SELECT '{COPY}' AS g, count(*) AS n FROM (SELECT s, p, o FROM quads WHERE g.v = '{WEST}' UNION SELECT s, p, o FROM quads WHERE g.v = '{PRESS}') UNION ALL SELECT g, n FROM ({_COUNTS}) WHERE coalesce(g, '') NOT IN ('{WEST}', '')) GROUP BY 1")
def update_move_add_clear(spark, d):
    q = _dataset(spark, d).update(f"MOVE <{WEST}> TO <{COPY}> ; ADD <{PRESS}> TO <{COPY}> ; CLEAR DEFAULT").quads
    kind = F.when(F.col("g").isNull(), "default").when(F.col("g.v") == COPY, "copy").otherwise("other")
    return q.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register(_COUNTS)
def dataset_add_remove(spark, d):
    """Half of the quads added to the others, some of them removed and added again."""
    quads = table(spark, d, "quads")
    ds = Dataset(spark, quads.where("quad_id % 2 = 0"), short=True)
    ds.add(quads)
    some = quads.where("p = 'parl:keyword'")
    ds.remove(some)
    ds.add(some)
    return _by_graph(ds.quads)


# inference, shapes


@register(f"SELECT '{BASE}nation/' || n_regionkey AS s, '{BASE}customer/' || n_nationkey AS o FROM nation")
def container_members(spark, d):
    n = table(spark, d, "nation")
    number = F.concat(F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#_"), (F.col("n_nationkey") + 1).cast("string"))
    data = n.select(term_col(IRI, F.concat(F.lit(f"{BASE}nation/"), "n_regionkey")).cast(TERM).alias("s"), number.alias("p"), term_col(IRI, F.concat(F.lit(f"{BASE}customer/"), "n_nationkey")).cast(TERM).alias("o"))
    out = I.infer_rdfs(data, ("container",))
    return out.where(F.col("p") == I.MEMBER).select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


@register("SELECT true AS stated, false AS simple, true AS inferred, false AS never")
def entailment(spark, d):
    schema = graph_of_text(spark, _CUSTOMER_SCHEMA, "turtle").select("s", "p", "o")
    data = mapped_engine(spark, d).sparql("CONSTRUCT { ?c a :Customer ; :nation ?n } WHERE { ?c a :Customer ; :nation ?n }").unionByName(schema)
    ask = lambda o, regime: I.entails(data, iri(f"{BASE}customer/1"), iri(RDF_TYPE), iri(f"{BASE}v#{o}"), regime)
    return spark.createDataFrame([(ask("Customer", "simple"), ask("Agent", "simple"), ask("Agent", "rdfs"), ask("Place", "rdfs"))], "stated boolean, simple boolean, inferred boolean, never boolean")


_SH = "@prefix : <http://data.example/v#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix d: <http://data.example/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . "


def _orders(spark, d) -> DataFrame:
    return mapped_engine(spark, d).sparql("CONSTRUCT { ?c a :Customer ; :name ?n ; :balance ?b ; :segment ?s ; :nation ?t . ?o :customer ?c ; :status ?st ; :priority ?p } WHERE { ?c a :Customer ; :name ?n ; :balance ?b ; :segment ?s ; :nation ?t OPTIONAL { ?o a :Order ; :customer ?c ; :status ?st ; :priority ?p } }")


def _report(spark, d, shapes: str, data=_orders) -> DataFrame:
    report = shacl.validate_shapes(spark, data(spark, d), graph_of_text(spark, _SH + shapes, "turtle"))
    return report.groupBy("component", "severity").agg(F.count(F.lit(1)).alias("n"))


def _expected(**counts: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}ConstraintComponent' AS component, 'Violation' AS severity, ({sql}) AS n) WHERE n > 0" for name, sql in counts.items())


_N_ORDERS = "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


@register(_expected(
    MinCount=f"SELECT count(*) FROM ({_N_ORDERS}) WHERE n < 5", MaxCount=f"SELECT count(*) FROM ({_N_ORDERS}) WHERE n > 12", Datatype="SELECT count(*) FROM customer",
    Class="SELECT count(*) FROM customer", NodeKind="SELECT count(*) FROM customer",
))
def shacl_counts_and_kinds(spark, d):
    return _report(spark, d, ":S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path [ sh:inversePath :customer ] ; sh:minCount 5 ; sh:maxCount 12 ] , [ sh:path :balance ; sh:datatype xsd:integer ] , [ sh:path :nation ; sh:class :Nation ; sh:nodeKind sh:Literal ] .")


@register(_expected(
    MinExclusive="SELECT count(*) FROM customer WHERE NOT (c_acctbal > 0)", MaxInclusive="SELECT count(*) FROM customer WHERE c_acctbal > 9000", MaxExclusive="SELECT count(*) FROM customer WHERE NOT (c_acctbal < 9500)", MinInclusive="SELECT count(*) FROM customer WHERE c_acctbal < -500",
    MinLength="SELECT count(*) FROM customer WHERE length(c_mktsegment) < 9", MaxLength="SELECT count(*) FROM customer WHERE length(c_mktsegment) > 9", Pattern="SELECT count(*) FROM customer WHERE NOT regexp_matches(c_mktsegment, '^b|y$', 'i')",
    HasValue="SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING'", LanguageIn="SELECT count(*) FROM customer",
))
def shacl_values(spark, d):
    return _report(spark, d, ':S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :balance ; sh:minExclusive 0.0 ; sh:maxInclusive 9000.0 ; sh:maxExclusive 9500.0 ; sh:minInclusive -500.0 ] , [ sh:path :segment ; sh:minLength 9 ; sh:maxLength 9 ; sh:pattern "^b|y$" ; sh:flags "i" ; sh:hasValue "BUILDING" ] , [ sh:path :name ; sh:languageIn ( "en" ) ] .')


@register(_expected(
    Not="SELECT count(*) FROM customer WHERE c_acctbal > 5000", And="SELECT count(*) FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING')", Or="SELECT count(*) FROM customer WHERE NOT (c_acctbal > 0 OR c_mktsegment = 'BUILDING')",
    Xone="SELECT count(*) FROM customer WHERE (c_acctbal > 0) = (c_mktsegment = 'BUILDING')", Node="SELECT count(*) FROM customer WHERE NOT (c_acctbal > 0)",
    QualifiedMinCount="SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", Closed="SELECT 2 * count(*) FROM customer",
))
def shacl_logic(spark, d):
    return _report(spark, d, (
        ':Positive a sh:NodeShape ; sh:property [ sh:path :balance ; sh:minExclusive 0.0 ] . :Building a sh:NodeShape ; sh:property [ sh:path :segment ; sh:in ( "BUILDING" ) ] . :Final a sh:NodeShape ; sh:property [ sh:path :status ; sh:in ( "F" ) ; sh:minCount 1 ] . '
        ":S a sh:NodeShape ; sh:targetClass :Customer ; sh:not [ sh:property [ sh:path :balance ; sh:minExclusive 5000.0 ] ] ; sh:and ( :Positive :Building ) ; sh:or ( :Positive :Building ) ; sh:xone ( :Positive :Building ) ; sh:node :Positive ; "
        "sh:property [ sh:path [ sh:inversePath :customer ] ; sh:qualifiedValueShape :Final ; sh:qualifiedMinCount 1 ] ; sh:closed true ; sh:ignoredProperties ( rdf:type :name :balance ) ."
    ).replace(" rdf:type", " <http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"))


@register(_expected(
    Equals="SELECT 2 * count(*) FROM customer", Disjoint="SELECT 0", LessThan="SELECT count(*) FROM customer WHERE NOT (c_acctbal < 2 * c_acctbal)", LessThanOrEquals="SELECT count(*) FROM customer WHERE NOT (c_acctbal <= 2 * c_acctbal)",
))
def shacl_pairs(spark, d):
    data = lambda spark, d: mapped_engine(spark, d).sparql("CONSTRUCT { ?c a :Customer ; :low ?b ; :high ?h ; :name ?n ; :segment ?s } WHERE { ?c a :Customer ; :balance ?b ; :name ?n ; :segment ?s BIND(2 * ?b AS ?h) }")
    return _report(spark, d, ":S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :low ; sh:lessThan :high ; sh:lessThanOrEquals :high ] , [ sh:path :name ; sh:equals :segment ; sh:disjoint :segment ] .", data)


@register("SELECT severity, message, path, count(*) AS n FROM (SELECT 'Warning' AS severity, 'poor' AS message, 'http://data.example/v#balance' AS path FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'Info', 'urgent', 'http://data.example/v#priority' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'Violation', 'one', 'http://data.example/v#name' FROM customer WHERE c_custkey = 1) GROUP BY 1, 2, 3")
def shacl_targets_and_reports(spark, d):
    """Targets by object, by subject and by node; severities and messages; a deactivated shape."""
    shapes = (
        ':A a sh:NodeShape ; sh:targetObjectsOf :customer , :none ; sh:property [ sh:path :balance ; sh:minInclusive 0.0 ; sh:severity sh:Warning ; sh:message "poor" ] . '
        ':B a sh:NodeShape ; sh:targetSubjectsOf :customer ; sh:property [ sh:path :priority ; sh:not [ sh:in ( "1-URGENT" ) ] ; sh:severity sh:Info ; sh:message "urgent" ] . '
        ':C a sh:NodeShape ; sh:targetNode d:customer\\/1 ; sh:property [ sh:path :name ; sh:maxCount 0 ; sh:message "one" ] . :D a sh:NodeShape ; sh:deactivated true ; sh:targetClass :Customer ; sh:property [ sh:path :name ; sh:maxCount 0 ] .'
    )
    data = mapped_engine(spark, d).sparql("CONSTRUCT { ?c a :Customer ; :name ?n ; :balance ?b . ?o :customer ?c ; :priority ?p . ?x :none ?c } WHERE { ?c a :Customer ; :name ?n ; :balance ?b BIND(?c AS ?x) OPTIONAL { ?o a :Order ; :customer ?c ; :priority ?p } }")
    report = shacl.validate_shapes(spark, data, graph_of_text(spark, _SH + shapes, "turtle"))
    return report.groupBy("severity", "message", F.regexp_replace("path", "^<|>$", "").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS conforming, 'conforms' AS nothing, 7 AS lines FROM customer WHERE c_acctbal >= 0")
def shacl_prompt(spark, d):
    shapes = graph_of_text(spark, _SH + ":S a sh:NodeShape ; sh:targetClass :Customer ; sh:property [ sh:path :balance ; sh:minInclusive 0.0 ] .", "turtle")
    data = _customer_triples(spark, d)
    text, none = shacl.report_prompt(shacl.validate_shapes(spark, data, shapes), 6), shacl.report_prompt(shacl.validate_shapes(spark, data.where("false"), shapes))
    return shacl.conforming(spark, data, shapes).agg(F.count(F.lit(1)).alias("conforming"), F.lit(none).alias("nothing"), F.lit(len(text.split("\n"))).alias("lines"))


def _customer_triples(spark, d) -> DataFrame:
    return mapped_engine(spark, d).sparql("CONSTRUCT { ?c a :Customer ; :name ?n ; :balance ?b ; :nation ?t } WHERE { ?c a :Customer ; :name ?n ; :balance ?b ; :nation ?t }")


# projections, annotations, context


@register("SELECT s.v AS src, o.v AS dst, CAST(length(o.v) AS DOUBLE) AS weight FROM (SELECT DISTINCT s, o FROM quads WHERE p = 'parl:inSitting' AND o.k IN (0, 1))")
def weighted_edge_list(spark, d):
    e = G.edges(table(spark, d, "quads"), "parl:inSitting", F.length("o.v").cast("double"))
    return e.select(F.col("src.v").alias("src"), F.col("dst.v").alias("dst"), "weight")


@register("SELECT predicates, count(*) AS n FROM (SELECT s, o, string_agg(p, ',' ORDER BY p) AS predicates FROM (SELECT DISTINCT s, p, o FROM quads WHERE o.k IN (0, 1)) GROUP BY 1, 2) GROUP BY 1")
def predicates_of_edges(spark, d):
    return G.edge_predicates(table(spark, d, "quads")).groupBy(F.array_join("predicates", ",").alias("predicates")).agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT p, o FROM (VALUES ('{BASE}v#by', 'ann'), ('{BASE}v#on', '2024'), ('{BASE}v#by', 'bob')) t(p, o)")
def annotated_statement(spark, d):
    """Three statements about one; its reifier is made once."""
    data = _customer_triples(spark, d)
    statement = iri(f"{BASE}customer/1"), iri(f"{BASE}v#nation"), Term(*data.where((F.col("s.v") == f"{BASE}customer/1") & (F.col("p") == f"{BASE}v#nation")).first()["o"])
    for p, o in (("by", "ann"), ("on", "2024"), ("by", "bob")):
        data = G.annotate(data, *statement, f"{BASE}v#{p}", literal(o))
    return G.annotations(data, *statement).select("p", F.col("o.v").alias("o"))


@register("SELECT n_name AS a, r_name AS b, CAST(n_nationkey AS BIGINT) AS w FROM nation JOIN region ON n_regionkey = r_regionkey")
def triple_term_pattern(spark, d):
    """Statements about statements, written by CONSTRUCT and matched with variables inside."""
    made = mapped_engine(spark, d).sparql("CONSTRUCT { ?n :name ?a . ?r :name ?b . _:x rdf:reifies <<( ?n :region ?r )>> ; :weight ?w } WHERE { ?n a :Nation ; :name ?a ; :region ?r . ?r :name ?b BIND(xsd:integer(STRAFTER(STR(?n), 'nation/')) AS ?w) }")
    engine = Engine(spark, QuadStore(made.withColumn("g", F.lit(None).cast(TERM)), distinct=False), BASE, PREFIXES)
    return engine.select("SELECT ?a ?b (xsd:integer(?w) AS ?k) { << ?n :region ?r >> :weight ?w . ?n :name ?a . ?r :name ?b }").withColumnRenamed("k", "w").withColumn("w", F.col("w").cast("bigint"))


@register("SELECT true AS fits, true AS whole, count(*) > 0 AS has FROM customer")
def context_text(spark, d):
    text = C.to_context(_customer_triples(spark, d), 500, {"": f"{BASE}v#"})
    body = text.split("\n", 1)[1]
    return spark.createDataFrame([(len(text.encode()) <= 2000, all(b.rstrip().endswith(".") for b in body.split(" .\n<") if b.strip()) or body.rstrip().endswith("."), f"<{BASE}" in body)], "fits boolean, whole boolean, has boolean")


@register("SELECT c_name AS n, 'x' || c_mktsegment AS v FROM customer")
def registered_function(spark, d):
    engine = mapped_engine(spark, d)
    engine.register_function(f"{BASE}f#mark", lambda v: Val("str", F.concat(F.lit("x"), v.col)))
    return engine.select(f"SELECT ?n (<{BASE}f#mark>(?s) AS ?v) {{ ?c a :Customer ; :name ?n ; :segment ?s }}")
