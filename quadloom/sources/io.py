"""Reading and writing graph data by format.

Line formats are split and read in parallel; the others are parsed a document per task, so their documents must each fit a task. Those that `write_parts`
makes are bounded in size.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.errors import GraphError
from quadloom.session import ship_code
from quadloom.sources.formats import HAS_GRAPHS, LINES, format_name
from quadloom.sources.jsonld import JsonLdParser, compact_iris, part_documents, to_jsonld
from quadloom.sources.ntriples import parse_lines, read_lines, write_lines
from quadloom.sources.rdfxml import RdfXmlParser
from quadloom.sources.turtle import TurtleParser, document_rows, trig_chunks, turtle_chunks
from quadloom.store import QuadStore
from quadloom.terms import QUAD, TERM, Term


def parse_text(text: str, format: str, base: str | None = None, scope: str = "", **options: Any) -> list[tuple[Term | None, Term, Term, Term]]:
    """The quads of one document in a format that is not line-based."""
    fmt = format_name(format)
    if fmt in ("turtle", "trig"):
        return TurtleParser(text, base, scope, fmt == "trig").parse()
    if fmt == "rdfxml":
        return RdfXmlParser(text, base, scope).parse()
    if fmt == "jsonld":
        return JsonLdParser(text, base, scope, **options).parse()
    raise GraphError(f"{fmt} is read by line")


def _row(q: tuple) -> tuple:
    t = lambda x: None if x is None else {"k": x.k, "v": x.v, "dt": x.dt, "lang": x.lang, "dir": x.dir}
    return t(q[0]), t(q[1]), q[2].v, t(q[3])


def _quads(rows: list[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Parsed statements as QUAD batches, column by column."""

    def terms(ts: list[Term | None]) -> pa.Array:
        fields = [pa.array([None if t is None else getattr(t, c) for t in ts], pa.int8() if c == "k" else pa.string()) for c in ("k", "v", "dt", "lang", "dir")]
        return pa.StructArray.from_arrays(fields, ["k", "v", "dt", "lang", "dir"], mask=pa.array([t is None for t in ts], pa.bool_()))

    for i in range(0, len(rows), size):
        g, s, p, o = zip(*rows[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays([terms(g), terms(s), pa.array([t.v for t in p], pa.string()), terms(o)], ["g", "s", "p", "o"])


def _documents(batches: Iterable[pa.RecordBatch], fmt: str, base: str | None, options: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            value, path, scope = (c[i].as_py() for c in batch.columns)
            yield from _quads(parse_text(value, fmt, base or path, scope, **options))


def read_graph(spark: SparkSession, path: str, format: str | None = None, base: str | None = None, faults: str = "raise", shared_labels: bool = False, **options: Any) -> DataFrame:
    """(g, s, p, o) of all files under path; blank nodes are scoped by document, or all together with shared_labels, and statements are a set within each."""
    fmt = format_name(format, path)
    if fmt in LINES:
        return read_lines(spark, path, fmt == "nquads", faults, shared_labels).distinct()
    ship_code(spark)
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    docs = docs.select("value", "path", (F.lit("") if shared_labels else F.concat(F.lit("d"), F.hex(F.xxhash64("path")), F.lit("_"))).alias("scope"))
    return docs.mapInArrow(partial(_documents, fmt=fmt, base=base, options=options), QUAD).distinct()


def graph_of_text(spark: SparkSession, text: str, format: str, base: str | None = None, **options: Any) -> DataFrame:
    """(g, s, p, o) of a document given as text."""
    fmt = format_name(format)
    if fmt in LINES:
        lines = spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
        return parse_lines(lines, "value", fmt == "nquads").where("fault is null").select("g", "s", "p", "o").distinct()
    rows = [tuple(None if x is None else x if isinstance(x, str) else tuple(x.values()) for x in _row(q)) for q in parse_text(text, fmt, base, **options)]
    return spark.createDataFrame(rows, QUAD).distinct()


def read_store(spark: SparkSession, path: str, format: str | None = None, **options: Any) -> QuadStore:
    return QuadStore(read_graph(spark, path, format, **options), distinct=False)


def _texts(batches: Iterable[pa.RecordBatch], documents: Any) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for text in documents(rows):
        yield pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["value"])


def write_parts(df: DataFrame, path: str, format: str | None = None, prefixes: dict[str, str] | None = None, mode: str = "error", native: bool = False, direction: str | None = None, context: dict[str, str] | None = None) -> None:
    """Write (g, s, p, o) rows as a folder of whole documents, each made by the task that holds its statements; no row passes through the driver.

    A task begins another document, a file of its own, whenever one has grown to a bounded size, and takes the statements in order without holding them. A
    blank node keeps its label in all documents of the folder: read them with `shared_labels`. In JSON-LD, lists and directions held by blank nodes stay
    statements, as what else refers to their nodes can lie in another document."""
    fmt = format_name(format, path)
    if "g" not in df.columns:
        df = df.withColumn("g", F.lit(None).cast(TERM))
    if fmt in LINES:
        write_lines(df, path, fmt == "nquads", mode)
        return
    if fmt == "rdfxml":
        raise GraphError("RDF/XML is read only")
    if fmt not in HAS_GRAPHS and not df.where("g is not null").limit(1).isEmpty():
        raise GraphError(f"{fmt} has no named graphs")
    ship_code(df.sparkSession)
    if fmt == "jsonld":
        flat = df.select(*[F.col(f"{c}.{x}").alias(f"{c}{x}") for c in "gs" for x in ("k", "v")], "p", *[F.col(f"o.{x}").alias(f"o{x}") for x in ("k", "v", "dt", "lang", "dir")])
        place, order, documents = ["gk", "gv", "sk", "sv"], ["p", "ok", "ov"], partial(part_documents, native=native, direction=direction, context=context)
    else:
        flat, place, order, documents = document_rows(df, prefixes, fmt == "trig")
    small = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # put together to the advisory size; only what a hot subject fills is divided
    rows = flat.hint("rebalance", small, *place).sortWithinPartitions(*place, *order).mapInArrow(partial(_texts, documents=documents), "value string")
    rows.write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_graph(
    df: DataFrame, path: str, format: str | None = None, prefixes: dict[str, str] | None = None, mode: str = "error", native: bool = False, direction: str | None = None, context: dict[str, str] | None = None
) -> None:
    """Write (g, s, p, o) rows: a folder of line files, or one document streamed through the driver; formats without graphs refuse named ones. Without a
    format and a known extension, N-Quads are written where there are named graphs, else N-Triples."""
    if format is None and "." not in path.rsplit("/", 1)[-1]:
        format = "nquads" if "g" in df.columns and not df.where("g is not null").limit(1).isEmpty() else "ntriples"
    fmt = format_name(format, path)
    if fmt == "rdfxml":
        raise GraphError("RDF/XML is read only")
    if "g" not in df.columns:
        df = df.withColumn("g", F.lit(None).cast(TERM))
    if fmt not in HAS_GRAPHS and not df.where("g is not null").limit(1).isEmpty():
        raise GraphError(f"{fmt} has no named graphs")
    if fmt in LINES:
        write_lines(df, path, fmt == "nquads", mode)
        return
    with open(path, "x" if mode == "error" else "w", encoding="utf-8") as out:
        if fmt == "jsonld":
            term = lambda x: None if x is None else Term(*x)
            rows = [(term(r["g"]), term(r["s"]), r["p"], term(r["o"])) for r in df.toLocalIterator()]
            doc = to_jsonld(rows, native, direction)
            json.dump(compact_iris(doc, context) if context else doc, out, ensure_ascii=False, indent=1)
        else:
            out.writelines(trig_chunks(df, prefixes) if fmt == "trig" else turtle_chunks(df.select("s", "p", "o"), prefixes))
