"""How often every distinct term occurs and in how many records, with marks on terms too rare or too common.

Occurrences are first counted per (scope, term, record), combined on the map side before the shuffle, so a term that a third of all rows hold is
spread over its records; the counts of terms are sums of those. The records of a scope are counted from its distinct (scope, record) pairs.

Defined results: rows with a NULL scope or record are ignored; a NULL in a term column counts as its own term unless the caller replaces it; repeated
rows count as occurrences but not as records; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def term_frequencies(df: DataFrame, scope: Column, terms: dict[str, Column], record: Column, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """(scope, term columns, n_occurrences, n_records, n_scope_records, mark): mark is 'rare' under min_records, 'common' over max_share, else NULL."""
    names = list(terms)
    rows = df.select(scope.alias("scope"), record.alias("record"), *[c.alias(n) for n, c in terms.items()]).where("scope is not null and record is not null")
    per_record = rows.groupBy("scope", *names, "record").agg(F.count(F.lit(1)).alias("n"))
    per_term = per_record.groupBy("scope", *names).agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))
    scopes = rows.select("scope", "record").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("n_scope_records"))
    out = per_term.join(scopes, "scope")
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") > max_share * F.col("n_scope_records"), "common")
    return out.withColumn("mark", mark)
