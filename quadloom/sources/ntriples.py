"""N-Triples and N-Quads, read and written by line in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadloom.errors import ParseError
from quadloom.functions.values import let
from quadloom.operators import quarantine as Q
from quadloom.terms import BNODE, TERM, nt_text

_GRAPH = rf"(?:{Q._WS}*({Q._ANY_IRI}|{Q._BNODE}))?"
_NQ = rf"(?s)^{Q._WS}*({Q._ANY_IRI}|{Q._BNODE}){Q._WS}*({Q._ANY_IRI}){Q._WS}*({Q._ANY_IRI}|{Q._QUOTED}|{Q._BNODE}|{Q._STRING}{Q._SUFFIX}){_GRAPH}{Q._END}"


def _scoped(t: Column, scope: Column) -> Column:
    """Blank node labels under their document's name."""
    return F.when(t["k"] == BNODE, t.withField("v", F.concat(scope, F.lit("_"), t["v"]))).otherwise(t)


def _own_types(fault: Column) -> Column:
    """Readers take ill-typed literals, as formats do."""
    return F.when(fault != "value", fault)


def parse_lines(lines: DataFrame, line: str = "value", quads: bool = False, scope: Column | None = None) -> DataFrame:
    """(g, s, p, o, fault, line): a row per statement or faulty line; works on static and streaming tables alike."""
    t = F.col(line)
    rows = lines.where(t.isNotNull() & ~t.rlike(r"^[ \t]*\r?(?:$|#)"))
    pattern = _NQ if quads else Q._LINE
    part = lambda i: F.regexp_extract(t, pattern, i)
    rows = rows.select(t.alias("line"), (F.lit("d") if scope is None else scope).alias("scope"), t.rlike(pattern).alias("ok"), *[part(i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))], (part(4) if quads else F.lit("")).alias("g"))
    checks = [F.col("s"), F.col("p"), F.col("o")] + ([F.when(F.col("g") != "", F.col("g"))] if quads else [])
    fault = F.when(~F.col("ok"), "terms").otherwise(F.coalesce(*[let(x, lambda r: _own_types(Q.term_fault(r))) for x in checks]))
    rows = rows.withColumn("fault", fault)
    ok, named = F.col("fault").isNull(), F.col("g") != ""
    term = lambda c: let(F.col(c), lambda r: _scoped(Q.decode_term(r), F.col("scope"))).cast(TERM)
    return rows.select(F.when(ok & named, term("g")).alias("g"), F.when(ok, term("s")).alias("s"), F.when(ok, let(F.col("p"), lambda r: Q.decode_term(r)["v"])).alias("p"), F.when(ok, term("o")).alias("o"), "fault", "line")


def read_lines(spark: SparkSession, path: str, quads: bool = False, faults: str = "raise", shared_labels: bool = False) -> DataFrame:
    """(g, s, p, o) of .nt or .nq files, whose blank nodes are scoped by file or, with shared_labels, all together. faults: 'raise' fails the query at the first faulty line, 'drop' leaves such lines out, 'keep' adds the columns fault and line."""
    lines = spark.read.text(path)
    named = lines.select("value", F.col("_metadata.file_path").alias("path"))
    got = parse_lines(named, "value", quads, F.lit("d") if shared_labels else F.concat(F.lit("d"), F.hex(F.xxhash64("path"))))
    if faults == "keep":
        return got
    if faults == "drop":
        return got.where("fault is null").select("g", "s", "p", "o")
    if faults != "raise":
        raise ParseError(f"faults={faults!r}")
    checked = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("faulty line ("), F.col("fault"), F.lit("): "), F.col("line")))).otherwise(F.col("s"))
    return got.select("g", checked.cast(TERM).alias("s"), "p", "o")


def line_text(quads: bool = False) -> Column:
    """The line of a row (g, s, p, o)."""
    parts = [nt_text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), nt_text(F.col("o"))]
    if quads:
        parts.append(F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), nt_text(F.col("g")))).otherwise(""))
    return F.concat(*parts, F.lit(" ."))


def write_lines(df: DataFrame, path: str, quads: bool = False, mode: str = "error") -> None:
    df.select(line_text(quads).alias("value")).write.mode(mode).text(path)
