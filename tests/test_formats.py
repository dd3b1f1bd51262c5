"""Formats: reading, writing, round trips, errors."""

from __future__ import annotations

import io
import json

import pytest

from quadloom.engine import Engine
from quadloom.errors import EndpointError, GraphError, ParseError
from quadloom.operators.graphs import isomorphic, isomorphic_datasets
from quadloom.sources.io import graph_of_text, parse_text, read_graph, read_store, write_graph
from quadloom.sources.remote import RemoteGraph, bind_join, remote_select
from quadloom.sources.results import read_json, read_solutions, write_results, write_results_dir
from quadloom.store import QuadStore
from quadloom.terms import Namespace, Term, iri, literal

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def texts(quads):
    return {" ".join(x.nt() for x in q if x is not None) for q in quads}


TURTLE = """@prefix : <http://e/> . @base <http://b/x/> .
:a a :C ; :p 1, 2.5, 1e3, true, "x"@en--ltr, \"\"\"l"q\"\"\"^^:dt ;; :q [ :r (1 [ :z 2 ]) ] .
<../y> :p <<( :a :b :c )>> . << :a :p :o ~ :r1 >> :w 3 . :s :p :o {| :c 1 |} ~ :rr . _:x :p _:x ."""


def test_turtle():
    got = texts(parse_text(TURTLE, "turtle"))
    assert f"<http://e/a> <{RDF}type> <http://e/C>" in got and "<http://b/y> <http://e/p> <<( <http://e/a> <http://e/b> <http://e/c> )>>" in got
    assert f"<http://e/r1> <{RDF}reifies> <<( <http://e/a> <http://e/p> <http://e/o> )>>" in got and f"<http://e/rr> <{RDF}reifies> <<( <http://e/s> <http://e/p> <http://e/o> )>>" in got
    assert '<http://e/a> <http://e/p> "x"@en--ltr' in got and len(got) == 22


@pytest.mark.parametrize("bad", [":a :b :c .", "@prefix : <http://e/> . :a :b", "@prefix : <http://e/> . 'x' :b :c .", "@prefix : <http://e/> . :a :b 1x .", "@prefix : <http://e/> . :a 'b' :c .", "@prefix : <http://e/> . <<( :a :b :c )>> :p :o .", "@prefix : <http://e/> . :a :b 'x'^^<http://www.w3.org/1999/02/22-rdf-syntax-ns#langString> .", "@prefix : <http://e/> . :a :b :c {| |} .", "@prefix : <http://e/> . :a :b 'x'@en--LTR ."])
def test_bad_turtle(bad):
    with pytest.raises(ParseError):
        parse_text(bad, "turtle")


def test_trig():
    q = parse_text("@prefix : <http://e/> . :d :p :o . :g { :a :b :c . :x :y :z } GRAPH <http://g> { _:b :p 'v' } { :k :l :m } [] { :a :b :d }", "trig")
    assert [None if x[0] is None else x[0].k for x in q] == [None, 1, 1, 1, None, 0]


def test_rdfxml():
    doc = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:base="http://b/"><e:C rdf:about="#x" e:a="lit"><e:p rdf:resource="y"/><e:q xml:lang="en">t</e:q>
<e:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:n><e:l rdf:parseType="Collection"><rdf:Description rdf:about="i1"/><e:D/></e:l><e:r rdf:parseType="Resource"><e:s>z</e:s></e:r>
<rdf:li>one</rdf:li><e:k rdf:nodeID="n" /><e:t rdf:ID="st">b</e:t><e:x rdf:parseType="Literal"><b>bold</b></e:x><e:empty/></e:C></rdf:RDF>"""
    got = texts(parse_text(doc, "rdfxml"))
    for want in (f"<http://b/#x> <{RDF}type> <http://e/C>", "<http://b/#x> <http://e/p> <http://b/y>", '<http://b/#x> <http://e/q> "t"@en', f'<http://b/#x> <{RDF}_1> "one"', f'<http://b/#st> <{RDF}object> "b"', '<http://b/#x> <http://e/empty> ""', "<http://b/#x> <http://e/k> _:n"):
        assert want in got
    for bad in ("<x", f'<rdf:RDF xmlns:rdf="{RDF}"><rdf:li/></rdf:RDF>', f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/"><e:A rdf:about="a" rdf:nodeID="b"/></rdf:RDF>'):
        with pytest.raises(ParseError):
            parse_text(bad, "rdfxml")


JSONLD = {
    "@context": {"@vocab": "http://v/", "e": "http://e/", "knows": {"@type": "@id"}, "tags": {"@container": "@list"}, "label": {"@container": "@language"}, "@language": "fr", "parentOf": {"@reverse": "childOf"}, "byId": {"@container": "@id"}, "Typed": {"@context": {"name": "http://typed/name"}}, "data": {"@type": "@json"}},
    "@id": "http://x/1", "@type": ["Person", "Typed"], "name": "Jean", "age": 5, "h": 1.5, "ok": True, "knows": ["http://x/2", "e:y"], "tags": ["a", 2], "label": {"en": "L", "de": ["M", "N"]}, "parentOf": {"@id": "http://x/9"},
    "d": {"@value": "2020-01-01", "@type": "http://www.w3.org/2001/XMLSchema#date"}, "byId": {"http://x/5": {"age": 1}}, "data": {"b": [1, None], "a": 2}, "none": None, "set": {"@set": [1, 1, 2]}, "nested": {"city": {"@value": "P", "@language": "en"}},
}


def test_jsonld():
    got = texts(parse_text(json.dumps(JSONLD), "jsonld"))
    for want in ('<http://x/1> <http://typed/name> "Jean"@fr', '<http://x/1> <http://v/age> "5"^^<http://www.w3.org/2001/XMLSchema#integer>', '<http://x/1> <http://v/h> "1.5E0"^^<http://www.w3.org/2001/XMLSchema#double>', "<http://x/9> <http://v/childOf> <http://x/1>", "<http://x/1> <http://v/knows> <http://e/y>", '<http://x/1> <http://v/label> "N"@de', '<http://x/5> <http://v/age> "1"^^<http://www.w3.org/2001/XMLSchema#integer>', f'<http://x/1> <http://v/data> "{{\\"a\\":2,\\"b\\":[1,null]}}"^^<{RDF}JSON>'):
        assert want in got, want
    ctx = {"http://c/": {"@context": {"n": "http://n/"}}}
    assert texts(parse_text('{"@context": "http://c/", "@id": "http://x", "n": "v"}', "jsonld", contexts=ctx)) == {'<http://x> <http://n/> "v"'}
    for bad in ("{", '{"@context": 5}', '{"@context": "http://c/"}', '{"@context": {"a": "b:c", "b": "a:d"}, "a": 1}'):
        with pytest.raises(ParseError):
            parse_text(bad, "jsonld")
    i18n = texts(parse_text('{"@context": {"@direction": "rtl", "@language": "ar", "p": "http://p"}, "@id": "http://x", "p": "v"}', "jsonld", directions="i18n-datatype"))
    assert i18n == {'<http://x> <http://p> "v"^^<https://www.w3.org/ns/i18n#ar_rtl>'}


@pytest.mark.parametrize("ext", ["nq", "trig", "jsonld", "nt", "ttl"])
def test_round_trip(spark, tmp_path, ext):
    doc = TURTLE.replace("<../y> :p <<( :a :b :c )>> . ", "").replace("<< :a :p :o ~ :r1 >> :w 3 . ", "").replace(" {| :c 1 |} ~ :rr", "")
    if ext in ("nq", "trig", "jsonld"):
        doc += ' :g { :x :y "z\\n\\"\\\\", _:q ; a :C . _:q :p :x }'
    g = graph_of_text(spark, doc, "trig")
    path = str(tmp_path / f"out.{ext}")
    write_graph(g, path, prefixes={"": "http://e/", "xsd": "http://www.w3.org/2001/XMLSchema#"})
    back = read_graph(spark, path)
    assert back.count() == g.count()
    for name in (None, "http://e/g"):
        part = lambda df: df.where("g is null" if name is None else f"g.v = '{name}'").select("s", "p", "o")  # noqa: B023, E731
        assert isomorphic(part(g), part(back))
    if ext in ("nt", "ttl"):
        with pytest.raises(GraphError):
            write_graph(graph_of_text(spark, "<http://a> { <http://b> <http://c> <http://d> }", "trig"), str(tmp_path / f"x.{ext}"))


def test_line_faults(spark, tmp_path):
    f = tmp_path / "x.nt"
    f.write_text('<http://a> <http://b> "c" .\n# c\n<http://a> <http://b> "1x"^^<http://www.w3.org/2001/XMLSchema#integer> .\nbroken\n_:a <http://b> _:a .\n')
    assert read_graph(spark, str(f), faults="drop").count() == 3
    with pytest.raises(Exception, match="faulty line"):
        read_graph(spark, str(f)).collect()
    from quadloom.sources.ntriples import read_lines

    kept = read_lines(spark, str(f), faults="keep")
    assert [r["line"] for r in kept.where("fault is not null").collect()] == ["broken"]
    with pytest.raises(GraphError):
        write_graph(read_store(spark, str(f), faults="drop").quads, str(tmp_path / "x.rdf"))


def test_blank_nodes_of_documents_stay_apart(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.ttl").write_text("_:x <http://p> 1 .")
    assert read_graph(spark, str(tmp_path / "*.ttl")).count() == 2


@pytest.fixture(scope="module")
def people(engine):
    return engine(':a :name "A,\\"1\\"" ; :age 5 . :b :name "B"@en . _:c :name "C" . :d :about <<( :a :p 1 )>> .')


def test_results(spark, people, tmp_path):
    s = people.sparql("SELECT ?s ?n ?a { ?s :name ?n OPTIONAL { ?s :age ?a } }")
    for fmt in ("json", "xml", "csv", "tsv"):
        out = io.StringIO()
        write_results(out, s, fmt)
        text = out.getvalue()
        assert "http://e/a" in text and "5" in text
        if fmt == "csv":
            assert '"A,""1"""' in text and text.startswith("s,n,a\r\n")
        if fmt == "tsv":
            assert text.startswith("?s\t?n\t?a\n") and '"B"@en\t\n' in text
        if fmt == "json":
            back = read_solutions(spark, text)
            assert sorted(map(str, back.terms.collect())) == sorted(map(str, s.terms.collect()))
    out = io.StringIO()
    write_results(out, True, "json")
    assert read_json(out.getvalue()) is True
    out = io.StringIO()
    write_results(out, people.sparql("SELECT ?t { :d :about ?t }"), "json")
    assert read_json(out.getvalue())[1][0]["t"].k == 3
    with pytest.raises(Exception, match="no CSV"):
        write_results(io.StringIO(), True, "csv")
    write_results_dir(s, str(tmp_path / "r"), "tsv")
    assert spark.read.text(str(tmp_path / "r")).count() == 3


def test_remote(spark, engine):
    remote = engine(":a :likes :x . :b :likes :y . :c :likes :z .")
    sent = []

    def transport(url, query):
        sent.append(query)
        out = io.StringIO()
        write_results(out, Engine(spark, remote.store, prefixes={"": "http://e/"}).sparql(query), "json")
        return out.getvalue()

    local = engine(':a :name "A" . :b :name "B" . _:n :name "N" .')
    local.transport = transport
    rows = local.sparql("SELECT ?n ?l { ?s :name ?n SERVICE <http://r/> { ?s :likes ?l } }").terms.collect()
    assert sorted(r["l"]["v"] for r in rows) == ["http://e/x", "http://e/y"]
    assert len(sent) == 1 and "VALUES ( ?s )".replace("( ", "(").replace(" )", ")") in sent[0] and "_:" not in sent[0]  # keys are shipped, the bare pattern is not
    maybe = local.sparql("SELECT ?n ?l { ?s :name ?n OPTIONAL { SERVICE <http://r/> { ?s :likes ?l } } }").terms.collect()
    assert sorted((r["n"]["v"], r["l"] and r["l"]["v"]) for r in maybe) == [("A", "http://e/x"), ("B", "http://e/y"), ("N", None)]
    sent.clear()
    left = local.sparql("SELECT ?s ?n { ?s :name ?n }").rel
    got = bind_join(spark, left, "http://r/", "?s <http://e/likes> ?l", ["s", "l"], transport, batch=1)
    assert sorted(r["l"]["v"] for r in got.df.collect()) == ["http://e/x", "http://e/y"] and sum("VALUES" in q for q in sent) == 2

    def failing(url, query):
        if "http://e/a" in query:
            raise EndpointError("down")
        return transport(url, query)

    got = bind_join(spark, left, "http://r/", "?s <http://e/likes> ?l", ["s", "l"], failing, batch=1, silent=True)
    assert sorted((r["n"], r["l"] and r["l"]["v"]) for r in got.df.select("n.v", "l").toDF("n", "l").collect()) == [("A", None), ("B", "http://e/y")]
    with pytest.raises(EndpointError):
        bind_join(spark, left, "http://r/", "?s <http://e/likes> ?l", ["s", "l"], failing, batch=1)
    g = RemoteGraph(spark, "http://r/", transport)
    assert len(g) == 3 and (iri("http://e/a"), iri("http://e/likes"), iri("http://e/x")) in g and g.match(subject=iri("http://e/a")).count() == 1 and len(list(g)) == 3
    with pytest.raises(Exception, match="read-only"):
        g.add(iri("http://a"))
    assert remote_select(spark, "http://r/", "ASK { ?s ?p ?o }", transport) is True


def test_store_api(spark, engine):
    store = engine(":a :p 1 ; :q 2 . :b :p 1 . :g { :a :p 3 }").store
    assert store.match(subject=iri("http://e/a")).count() == 2 and store.match(graph=None).count() == 4 and store.match(graph="http://e/g").count() == 1
    assert store.subjects(object=literal(1)).count() == 2 and store.contains(iri("http://e/a"), iri("http://e/q"), literal(2)) and not store.contains(iri("http://e/a"), iri("http://e/q"), literal(3))
    assert {r["p"]: r["n"] for r in store.statistics().collect()} == {"http://e/p": 3, "http://e/q": 1}
    twice = QuadStore(store.quads.unionByName(store.quads))
    assert twice.match().count() == 3 and Engine(spark, twice).sparql("SELECT * { ?s <http://e/p> ?o }").terms.count() == 2
    assert Namespace("http://e/").x == "http://e/x" and Namespace("http://e/")["y z"] == "http://e/y z" and Term(1, "http://e/x").nt() == "<http://e/x>"


def test_xml_literals_are_canonical(spark):
    from quadloom.sources.io import graph_of_text

    doc = """<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xmlns:h="http://h/"><e:T r:about="http://e/a">
<e:p r:parseType="Literal">x &lt; y <h:b z="1" h:k="2" a='"'/><i xmlns="http://i/"><j>&gt;</j></i><!-- c --></e:p></e:T></r:RDF>"""
    got = [r["o"]["v"] for r in graph_of_text(spark, doc, "rdfxml").where("p = 'http://e/p'").collect()]
    assert got == ['x &lt; y <h:b xmlns:h="http://h/" a="&quot;" z="1" h:k="2"></h:b><i xmlns="http://i/"><j>&gt;</j></i>']


def test_directions_and_contexts_of_jsonld():
    from quadloom.sources.jsonld import I18N, compact_iris, to_jsonld

    s, b = Term(1, "http://e/s"), Term(0, "b")
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    typed = [(None, s, "http://e/p", Term(2, "x", f"{I18N}ar-EG_rtl"))]
    want = [{"@id": "http://e/s", "http://e/p": [{"@value": "x", "@language": "ar-EG", "@direction": "rtl"}]}]
    assert to_jsonld(typed, direction="i18n-datatype") == want and "@type" in to_jsonld(typed)[0]["http://e/p"][0]
    node = [(None, s, "http://e/p", b), (None, b, f"{rdf}value", literal("x")), (None, b, f"{rdf}language", literal("ar-EG")), (None, b, f"{rdf}direction", literal("rtl"))]
    assert to_jsonld(node, direction="compound-literal") == want and len(to_jsonld(node)) == 2
    got = compact_iris([{"@id": "http://e/s", "@type": ["http://v/T"], "http://e/p": [{"@value": "x"}, {"@id": "http://e/o"}], "http://v/q": [{"@value": "y"}]}], {"e": "http://e/", "@vocab": "http://v/", "q": "http://v/q"})
    assert got == {"@context": {"e": "http://e/", "@vocab": "http://v/", "q": "http://v/q"}, "@graph": [{"@id": "e:s", "@type": "T", "e:p": ["x", {"@id": "e:o"}], "q": "y"}]}


def test_documents_by_partition(spark, tmp_path):
    from quadloom.sources.io import graph_of_text, read_graph, write_parts

    df = graph_of_text(spark, '@prefix : <http://e/> . :a :p ( 1 "x"@en ) ; :q [ :r _:b ] . _:b :s () . :g { :a :p 2.5 }', "trig").repartition(3)
    for fmt in ("trig", "jsonld", "nquads"):
        write_parts(df, str(tmp_path / fmt), fmt, {"": "http://e/"})
        back = read_graph(spark, str(tmp_path / fmt), fmt, shared_labels=True)
        assert back.count() == df.count() and isomorphic_datasets(back, df), fmt
    with pytest.raises(GraphError):
        write_parts(df, str(tmp_path / "t"), "turtle")
    write_parts(df.limit(0), str(tmp_path / "none"), "turtle")
    assert read_graph(spark, str(tmp_path / "none"), "turtle").count() == 0


@pytest.mark.parametrize("fmt", ["jsonld", "trig"])
def test_documents_of_bounded_size(spark, tmp_path, fmt):
    """One partition, with a hot subject, becomes documents that each hold a part, and all statements come back."""
    from pyspark.sql import functions as F

    from quadloom.sources.formats import DOCUMENT_ROWS
    from quadloom.sources.io import read_graph, write_parts
    from quadloom.terms import TERM, iri, term_col

    n = 2 * DOCUMENT_ROWS + 10
    i = F.col("id")
    g = F.when(i % 3 > 0, term_col(1, F.concat(F.lit("http://e/g"), (i % 3).cast("string"))))
    s = F.when(i < n // 2, iri("http://e/hot").col()).otherwise(term_col(0, F.concat(F.lit("b"), (i % 5000).cast("string"))))
    df = spark.range(0, n, 1, 1).select(g.cast(TERM).alias("g"), s.cast(TERM).alias("s"), F.lit("http://e/p").alias("p"), term_col(2, F.concat(F.lit('\\"\n'), i.cast("string")), F.lit("xsd:string")).cast(TERM).alias("o"))
    write_parts(df, str(tmp_path / "out"), fmt)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) > 2 and max(f.read_text().count("http://e/p") for f in files) <= DOCUMENT_ROWS
    back = read_graph(spark, str(tmp_path / "out"), fmt, shared_labels=True)
    assert back.count() == n and back.exceptAll(df).isEmpty()


@pytest.mark.parametrize("fmt", ["jsonld", "trig"])
def test_documents_of_long_texts(fmt):
    """Long texts fill a document before its statements do."""
    from quadloom.sources.formats import DOCUMENT_CHARS
    from quadloom.sources.jsonld import part_documents

    long = ["x" * (DOCUMENT_CHARS // 4) + str(i) for i in range(9)]
    if fmt == "jsonld":
        docs = list(part_documents((None, None, 1, "http://e/s", "http://e/p", 2, x, "xsd:string", None, None) for x in long))
    else:
        from quadloom.sources.turtle import documents

        docs = list(documents(((None, "<http://e/s>", True, "<http://e/p>", f'"{x}"') for x in long), ""))
    assert len(docs) == 3 and {q[3].v for d in docs for q in parse_text(d, fmt, "http://b/")} == set(long)


def test_jsonld_graphs_sets_and_refused_documents():
    parse = lambda doc: sorted(str((*map(str, q),)) for q in parse_text(json.dumps(doc), "jsonld", "http://b/"))
    ctx = {"@vocab": "http://v/", "g": {"@container": "@graph"}, "x": {"@id": "@later"}}
    inner = parse({"@context": ctx, "@id": "http://b/s", "g": {"@id": "http://b/o", "@graph": [{"@id": "http://b/a", "p": 1}]}})
    assert len(inner) == 2 and any("'<http://b/o>', '<http://b/a>', '<http://v/p>'" in q for q in inner)  # the graph o stands in a graph of its own
    assert len(parse({"@context": ctx, "@graph": [{"@set": ["free", {"@id": "http://b/s", "p": []}, {"@id": "http://b/s", "p": "kept"}]}]})) == 1
    got = parse({"@context": ctx, "@id": "http://b/s", "x": "1", "l": {"@list": []}, "q": {"@language": "en"}, "t": {"@value": "v", "@type": "http://e/a b"}, "r": {"@id": "#a:b"}})
    assert [q.split("'")[5] for q in got] == ["<http://v/l>", "<http://v/r>", "<http://v/x>"] and "'<http://b/#a:b>'" in got[1]
    for bad in (
        {"@context": {"a": {"@id": "http://e/a", "@container": "@what"}}}, {"@context": {"a": {"@reverse": "http://e/a", "@id": "http://e/b"}}}, {"@context": {"a": "@context"}}, {"@context": {"a": {"@id": "http://e/a", "@type": "rel"}}},
        {"@context": {"i": "@id"}, "i": "http://e/a", "@id": "http://e/b"}, {"http://e/p": {"@value": [1]}}, {"@reverse": "http://e/a"}, {"@context": {"@version": 1.2}}, {"@context": {"n": "@nest"}, "n": "text"}, {"@included": "text"},
    ):
        with pytest.raises(ParseError):
            parse(bad)


def test_scoped_contexts_of_jsonld():
    parse = lambda doc: sorted(" ".join(map(str, q[2:])) for q in parse_text(json.dumps(doc), "jsonld", "http://b/"))
    own = {"@vocab": "http://v/", "T": {"@context": {"foo": {"@context": {"p": "http://v/foo-p"}}, "p": "http://v/t-p"}}}
    got = parse({"@context": own, "@type": "T", "p": "1", "foo": {"p": "2"}, "bar": {"p": "3"}})
    assert [x for x in got if '"' in x] == ['<http://v/foo-p> "2"', '<http://v/p> "3"', '<http://v/t-p> "1"']  # a type's context ends with its node, a property's does not
    kept = {"@version": 1.1, "@vocab": "http://v/", "T": {"@context": {"@propagate": True, "p": "http://v/t-p"}}}
    assert '<http://v/t-p> "3"' in parse({"@context": kept, "@type": "T", "bar": {"p": "3"}})
    assert parse({"@context": {"@vocab": "http://v/", "n": {"@id": "@nest", "@context": {"@vocab": "http://n/"}}}, "n": {"p": "1"}}) == ['<http://n/p> "1"']
    assert parse({"@context": {"i": {"@id": "http://e/i/"}, "i:by": {"@container": "@set"}}, "i:by": "x"}) == ['<http://e/i/by> "x"']
