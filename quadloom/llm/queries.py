"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.llm import encoding, language, lookalike, mixing, packing, terms, tokens
from quadloom.session import table

KEYWORDS = ["parl:keyword", "dcterms:subject"]
LABEL_CHARS = 80


def _terms(spark: SparkSession, d: str) -> DataFrame:
    quads = table(spark, d, "quads").where(F.col("p").isin(KEYWORDS))
    return terms.term_frequencies(quads, F.col("p"), {"o_v": F.col("o.v"), "o_lang": F.coalesce("o.lang", F.lit(""))}, F.col("s.v"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select(F.col("scope").alias("predicate"), "o_v", "o_lang", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select(F.col("scope").alias("predicate"), "o_v", "o_lang", F.col("n_occurrences").alias("statements"), F.col("n_records").alias("speeches"), "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "literals").where(F.length("lexical_form") < LABEL_CHARS)
    return lookalike.lookalike_pairs(labels, "literal_id", "lexical_form")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "literals").where(F.length("lexical_form") < LABEL_CHARS)
    return lookalike.lookalike_classes(labels, "literal_id", "lexical_form")


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "literals").where(F.length("lexical_form") < LABEL_CHARS)
    return labels.select("literal_id", lookalike.canonical_form(F.col("lexical_form")).alias("label"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "literals")
    model = language.fit_languages(rows, "lexical_form", "language_tag")
    long = rows.where(F.length("lexical_form") >= LABEL_CHARS)
    return long.select("literal_id", "language_tag", language.label_texts(F.col("lexical_form"), model).alias("said"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    said = _languages(spark, d)
    found = said.select("literal_id", language.tag_language(F.col("language_tag")).alias("stated"), F.explode(language.whole_sentence_languages(F.col("said"))).alias("lang"))
    return found.where("stated is null or stated <> lang").select("literal_id", "lang")


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _languages(spark, d).select("literal_id", F.col("said.lang").alias("literal_lang"), F.col("said.confidence").alias("literal_confidence"), F.explode_outer("said.segments").alias("seg"))
    return s.select("literal_id", "literal_lang", "literal_confidence", F.col("seg.start").alias("start"), F.col("seg.end").alias("end"), F.col("seg.lang").alias("lang"), F.col("seg.confidence").alias("confidence"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d).select("doc_id", "tokens"), table(spark, d, "pack_specs"), "doc_id", "tokens", "spec_id", "capacity_tokens")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"), "doc_id", "source", "tokens", "target_weight", "max_repeats")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, d), table(spark, d, "mix_targets"), "source", "target_weight")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.affected(table(spark, d, "documents"), "doc_id", "text")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(table(spark, d, "documents"), "doc_id", "text")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of all long literals: their number, and those whose labels lie outside the text or whose confidence is none."""
    said = _languages(spark, d).join(table(spark, d, "literals").select("literal_id", F.length("lexical_form").alias("size")), "literal_id")
    bad = F.exists("said.segments", lambda s: (s["start"] < 0) | (s["end"] > F.col("size")) | (s["start"] >= s["end"]) | ~s["confidence"].between(0, 1))
    return said.agg(F.count(F.lit(1)).alias("literals"), F.count_if(bad | ~F.col("said.confidence").between(0, 1)).alias("bad"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of container: documents packed, those split without need, pieces that do not follow one another, containers over capacity or less than 99 % full together."""
    out = p8_containers(spark, d).join(table(spark, d, "pack_specs"), "spec_id")
    boxes = out.groupBy("spec_id", "container").agg(F.sum("tokens").alias("load"), F.max("container_tokens").alias("said"), F.max("capacity_tokens").alias("capacity"))
    boxes = boxes.groupBy("spec_id").agg(F.count_if(F.expr("load > capacity or load <> said")).alias("wrong_containers"), (F.sum("load") >= 0.99 * F.sum("capacity") - F.max("capacity")).alias("full"))
    docs = out.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("size"), F.max("capacity_tokens").alias("capacity"), F.max(F.expr("first_token + tokens")).alias("last"))
    docs = docs.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("pieces <> greatest(1, ceil(size / capacity)) or last <> size")).alias("wrong_documents"))
    return docs.join(boxes, "spec_id")


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """For each target whose source has records: whether its share is within a percentage point of its weight among these, and its repeats are within the cap."""
    got = p9_shares(spark, d).where("records > 0")
    total = got.agg(F.sum("target_weight").alias("w"))
    caps = table(spark, d, "mix_targets").select("source", "max_repeats")
    near = F.abs(F.col("share") - F.col("target_weight") / F.col("w")) <= 0.01 + F.lit(20_000) / F.greatest(F.lit(1), F.col("tokens") / F.col("share"))  # a document more or less
    return got.crossJoin(total).join(caps, "source").select("source", near.alias("near"), (F.col("max_repeat") <= F.greatest("max_repeats", F.lit(1))).alias("capped"))


def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents restored, those among them that are not their table's, and those whose plain ASCII words changed."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("before"))
    fixed = p10_restored(spark, d).join(docs, "doc_id", "left")
    plain = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"^[\x21-\x7e]+$"))
    return fixed.agg(F.count_if(F.col("before").isNull()).alias("unknown"), F.count_if(F.size(F.array_except(plain("before"), plain("text"))) > 0).alias("changed"))


QUERIES = {f.__name__: f for f in (p4_found, p4_terms, p6_found, p6_classes, p6_labels, p7_found, p7_segments, p8_containers, p9_mixture, p9_shares, p10_found, p10_restored, p7_counts, p8_counts, p9_counts, p10_counts)}

_TERMS = """SELECT p AS predicate, o.v AS o_v, coalesce(o.lang, '') AS o_lang, count(*) AS statements, count(DISTINCT s.v) AS speeches,
CASE WHEN count(DISTINCT s.v) < 3 THEN 'rare' WHEN count(DISTINCT s.v) > 0.2 * any_value(n) THEN 'common' END AS mark
FROM quads JOIN (SELECT p AS pp, count(DISTINCT s.v) AS n FROM quads GROUP BY 1) ON p = pp WHERE p IN ('parl:keyword', 'dcterms:subject') GROUP BY 1, 2, 3"""

ORACLES = {
    "p4_found": f"SELECT predicate, o_v, o_lang, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p4_terms": _TERMS,
    "p7_counts": "SELECT count(*) AS literals, 0 AS bad FROM literals WHERE length(lexical_form) >= 80",
    "p8_counts": "SELECT spec_id, (SELECT count(*) FROM documents) AS documents, 0 AS wrong_documents, 0 AS wrong_containers, true AS full FROM pack_specs WHERE capacity_tokens > 0",
    "p9_counts": "SELECT source, true AS near, true AS capped FROM mix_targets WHERE target_weight > 0 AND source IN (SELECT source FROM documents WHERE text <> '')",
    "p10_counts": "SELECT 0 AS unknown, 0 AS changed",
}
