"""Registered queries of the core operators on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadloom.functions.xsd import LEXICAL
from quadloom.operators.hotkeys import hot_key_report
from quadloom.operators.quarantine import load_lines, reject_lines
from quadloom.operators.timestamps import equal_instants, instant_classes, normalise_timestamps
from quadloom.operators.wide import cast_failures, filled_cells, widen
from quadloom.session import table

TIME_PREDICATES = ["parl:startedAt", "parl:recordedAt", "dcterms:issued"]
MEMBER = "http://parl.example/member/"
MEMBER_TYPES = {
    "parl:birthDate": "date", "parl:swornIn": "date", "parl:seatNo": "integer", "parl:termsServed": "integer", "parl:fullTime": "boolean",
    "parl:speaksLocal": "boolean", "parl:attendance": "decimal", "foaf:name": "string", "parl:constituency": "string", "parl:officePhone": "string",
}
HOT_SHARE = 0.05


def _sitting_times(spark: SparkSession, d: str) -> DataFrame:
    quads = table(spark, d, "quads").where(F.col("p").isin(TIME_PREDICATES))
    rows = quads.select("quad_id", F.col("g.v").alias("graph_iri"), F.col("s.v").alias("subject"), "p", F.col("o.v").alias("lexical"), F.col("o.dt").alias("datatype"))
    graphs = table(spark, d, "graphs").select("graph_iri", "tz_name", "date_order")
    return normalise_timestamps(rows.join(graphs, "graph_iri", "left"), "lexical", "tz_name", "date_order")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return equal_instants(_sitting_times(spark, d), "quad_id", "subject", ["lexical", "datatype"])


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return instant_classes(_sitting_times(spark, d), "quad_id", "subject", ["lexical", "datatype"])


def p1_times(spark: SparkSession, d: str) -> DataFrame:
    return _sitting_times(spark, d).select("quad_id", "ts_status", F.timestamp_micros("ts_instant_us").cast("timestamp_ntz").alias("instant"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return reject_lines(table(spark, d, "nt_lines")).select("line_id", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    out = load_lines(table(spark, d, "nt_lines"))
    return out.select("line_id", F.col("subject.v").alias("s"), "predicate", F.col("object.k").cast("int").alias("o_k"), F.col("object.v").alias("o"), F.col("object.dt").alias("dt"), F.col("object.lang").alias("lang"))


def _predicates(spark: SparkSession, d: str, **distinct: Column) -> DataFrame:
    delay = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("asserted_at").cast("timestamp"))
    return hot_key_report(table(spark, d, "quads"), F.col("p"), distinct, delay, [0.5, 0.9, 0.99])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _predicates(spark, d).where(F.col("share") > HOT_SHARE).select(F.col("key").alias("predicate"))


def p3_predicates(spark: SparkSession, d: str) -> DataFrame:
    r = _predicates(spark, d, subjects=F.struct("s.k", "s.v"), objects=F.col("o"))
    return r.select(F.col("key").alias("predicate"), F.col("n_rows").alias("statements"), F.col("n_subjects").alias("subjects"), F.col("n_objects").alias("objects"), F.col("q")[0].alias("delay_p50"), F.col("q")[1].alias("delay_p90"), F.col("q")[2].alias("delay_p99"))


def _member_rows(spark: SparkSession, d: str) -> tuple:
    quads = table(spark, d, "quads").where(F.col("s.v").startswith(MEMBER) & F.col("p").isin(list(MEMBER_TYPES)))
    return quads, F.col("s.v"), F.col("p"), F.col("o.v"), MEMBER_TYPES


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_cells(widen(*_member_rows(spark, d)))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    wide = widen(*_member_rows(spark, d)).withColumnRenamed("entity", "subject")
    failed = F.aggregate(F.map_values("failures"), F.lit(0).cast("bigint"), lambda n, x: n + x["n_failed"])
    native = {"seatNo": F.col("seatNo").cast("bigint"), "termsServed": F.col("termsServed").cast("bigint"), "attendance": F.col("attendance").cast("double")}
    return wide.withColumns({**native, "n_failed": failed}).drop("cells", "failures")


def p5_failures(spark: SparkSession, d: str) -> DataFrame:
    return cast_failures(*_member_rows(spark, d)).withColumnsRenamed({"entity": "subject", "attribute": "predicate"})


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Quads of the timestamp predicates, and of plain forms with an offset how many are resolved and to which sum of seconds."""
    t = _sitting_times(spark, d)
    plain = F.col("lexical").rlike(_PLAIN_TIME) & (F.col("ts_status") == "resolved")
    return t.agg(F.count(F.lit(1)).alias("quads"), F.count_if(plain).alias("plain"), F.sum(F.when(plain, (F.col("ts_instant_us") / 1_000_000).cast("bigint"))).alias("seconds"))


_PLAIN_TIME = "^20[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|1[0-9]|2[0-8])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-](0[0-9]|1[0-3]):[0-5][0-9])$"


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a statement: loaded and rejected ones together, and how many are both or neither."""
    lines = table(spark, d, "nt_lines")
    both = load_lines(lines).select("line_id").unionByName(reject_lines(lines).select("line_id")).groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
    return both.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("n") != 1).alias("twice"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_times, p2_found, p2_loaded, p3_found, p3_predicates, p5_found, p5_members, p5_failures, p1_counts, p2_counts)}

_DISTINCT = "count(distinct s.k || ' ' || s.v) AS subjects, count(distinct o) AS objects"
_DELAY = "(epoch_us(loaded_at) - epoch_us(asserted_at))"


def _rank(q: float) -> str:
    return f"CAST(list_sort(list({_DELAY}) FILTER (asserted_at IS NOT NULL AND loaded_at IS NOT NULL))[greatest(1, ceil({q} * count({_DELAY})))::INT] AS BIGINT)"


def _canonical_sql() -> str:
    """SQL of the canonical text of a member value by the type of its predicate."""
    v = r"regexp_replace(o.v, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
    digits = f"regexp_replace({v}, '^[+-]?0*', '')"
    dec = f"CASE WHEN contains({digits}, '.') THEN regexp_replace({digits}, '\\.?0*$', '') ELSE {digits} END"
    texts = {
        "boolean": f"CASE WHEN {v} IN ('true', '1') THEN 'true' ELSE 'false' END",
        "date": f"regexp_replace({v}, '(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '')",
        "integer": digits,
        "decimal": f"CASE WHEN starts_with({dec}, '.') THEN '0' || {dec} ELSE {dec} END",
    }
    cases = ["WHEN p IN ('foaf:name', 'parl:constituency', 'parl:officePhone') THEN o.v"]
    for kind, text in texts.items():
        names = ", ".join(f"'{p}'" for p, k in MEMBER_TYPES.items() if k == kind)
        if kind in ("integer", "decimal"):
            body = f"CASE WHEN ({text}) = '' THEN '0' ELSE ({text}) END"
            text = f"CASE WHEN starts_with({v}, '-') AND ({body}) <> '0' THEN '-' || ({body}) ELSE ({body}) END"
        cases.append(f"WHEN p IN ({names}) THEN CASE WHEN regexp_matches({v}, '{LEXICAL[kind]}') THEN {text} END")
    return "CASE " + " ".join(cases) + " END"


_MEMBER_ROWS = f"""SELECT s.v AS subject, p AS predicate, o.v AS raw, {_canonical_sql()} AS c FROM quads
WHERE starts_with(s.v, '{MEMBER}') AND o.v IS NOT NULL AND p IN ({", ".join(f"'{p}'" for p in MEMBER_TYPES)})"""
_CELLS = f"SELECT subject, predicate, min(c) AS val FROM ({_MEMBER_ROWS}) GROUP BY 1, 2"
_NATIVE = {"string": "VARCHAR", "integer": "BIGINT", "decimal": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}

ORACLES = {
    "p1_counts": f"SELECT count(*) AS quads, count(*) FILTER (plain) AS plain, sum(CASE WHEN plain THEN epoch(try_cast(o.v AS TIMESTAMPTZ))::BIGINT END)::BIGINT AS seconds FROM (SELECT o, regexp_matches(o.v, '{_PLAIN_TIME}') AS plain FROM quads WHERE p IN ({', '.join(repr(p) for p in TIME_PREDICATES)}))",
    "p2_counts": "SELECT count(*) AS lines, 0 AS twice FROM nt_lines WHERE NOT regexp_matches(line_text, '^[ \\t]*\\r?($|#)')",
    "p3_found": f"SELECT p AS predicate FROM quads GROUP BY p HAVING count(*) > {HOT_SHARE} * (SELECT count(*) FROM quads)",
    "p3_predicates": f"SELECT p AS predicate, count(*) AS statements, {_DISTINCT}, {_rank(0.5)} AS delay_p50, {_rank(0.9)} AS delay_p90, {_rank(0.99)} AS delay_p99 FROM quads GROUP BY p",
    "p5_found": f"{_CELLS} HAVING count(distinct c) = 1",
    "p5_members": f"WITH c AS ({_CELLS} HAVING count(distinct c) = 1), e AS (SELECT subject, count(*) - count(c) AS n_failed FROM ({_MEMBER_ROWS}) GROUP BY 1) SELECT e.subject, any_value(n_failed) AS n_failed, "
    + ", ".join(f"max(CASE WHEN predicate = '{p}' THEN CAST(val AS {_NATIVE[k]}) END) AS \"{p.split(':')[1]}\"" for p, k in MEMBER_TYPES.items())
    + " FROM e LEFT JOIN c USING (subject) GROUP BY 1",
    "p5_failures": f"SELECT subject, predicate, raw AS failed, count(*) AS n FROM ({_MEMBER_ROWS}) WHERE c IS NULL GROUP BY 1, 2, 3",
}
