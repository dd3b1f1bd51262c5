"""Entity–attribute–value rows as one row per entity with typed columns.

Each value is brought to the one canonical text of its attribute's type. A pair (entity, attribute) is resolved if exactly one canonical value
remains over all its rows; the resolved pairs of an entity go into one map, from which the known attributes are projected into typed columns. Of rows
that fail the cast each row of the wide table keeps the number by attribute and the smallest text; `cast_failures` gives every distinct failed text with
its count, a row each, so that no list grows with the data.

Defined results: NULL entities, attributes or values are ignored; unknown attributes are ignored; an invalid value never empties a cell that valid
values fill; entities whose rows leave no cell filled still come out, with NULL columns; an empty table gives no rows. Numbers of more than 38 digits
stay exact in `cells` and are NULL in their typed column. A typed column has the attribute's local name, or its whole name where two attributes share the
local one or it is the name of another column.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.functions.xsd import canonical

_SQL = {"string": "string", "integer": "decimal(38,0)", "decimal": "decimal(38,12)", "boolean": "boolean", "date": "date"}


def _typed(df: DataFrame, entity: Column, attribute: Column, value: Column, types: dict[str, str]) -> DataFrame:
    """(entity, attribute, raw, text): the rows of known attributes with their canonical text, NULL where the cast fails."""
    rows = df.select(entity.alias("entity"), attribute.alias("attribute"), value.alias("raw")).where(
        F.col("attribute").isin(*types) & F.col("entity").isNotNull() & F.col("raw").isNotNull()
    )
    text = F.lit(None).cast("string")
    for kind in sorted(set(types.values())):
        names = [a for a, k in types.items() if k == kind]
        text = F.when(F.col("attribute").isin(*names), canonical(F.col("raw"), kind)).otherwise(text)
    return rows.withColumn("text", text)


def cast_failures(df: DataFrame, entity: Column, attribute: Column, value: Column, types: dict[str, str]) -> DataFrame:
    """(entity, attribute, failed, n): every distinct text that is no value of its attribute's type, with the number of its rows."""
    failed = _typed(df, entity, attribute, value, types).where("text is null")
    return failed.groupBy("entity", "attribute", F.col("raw").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


def resolved_pairs(df: DataFrame, entity: Column, attribute: Column, value: Column, types: dict[str, str]) -> DataFrame:
    """(entity, attribute, val, n_values, n_failed, failed): one row per pair; val is NULL unless exactly one typed value remains."""
    rows = _typed(df, entity, attribute, value, types)
    lowest, highest = F.min("text"), F.max("text")  # partial aggregates: no value list is held for a hot pair
    return rows.groupBy("entity", "attribute").agg(
        F.when(lowest == highest, lowest).alias("val"),
        F.count("text").alias("n_values"),
        F.count_if(F.col("text").isNull()).alias("n_failed"),
        F.min(F.when(F.col("text").isNull(), F.col("raw"))).alias("failed"),
    )


def widen(df: DataFrame, entity: Column, attribute: Column, value: Column, types: dict[str, str]) -> DataFrame:
    """One row per entity: `entity`, a typed column per attribute, `cells` and `failures` (maps by attribute)."""
    pairs = resolved_pairs(df, entity, attribute, value, types)
    filled = F.collect_list(F.when(F.col("val").isNotNull(), F.struct("attribute", "val")))
    failed = F.collect_list(F.when(F.col("n_failed") > 0, F.struct("attribute", F.struct("n_failed", "failed"))))
    maps = pairs.groupBy("entity").agg(F.map_from_entries(filled).alias("cells"), F.map_from_entries(failed).alias("failures"))  # at most one pair per known attribute
    local = {a: re.split("[:/#]", a)[-1] for a in types}
    taken = Counter(n.lower() for n in [*local.values(), "entity", "cells", "failures"])
    typed = [F.try_element_at("cells", F.lit(a)).try_cast(_SQL[k]).alias(local[a] if taken[local[a].lower()] == 1 else a) for a, k in types.items()]
    return maps.select("entity", *typed, "cells", "failures")


def filled_cells(wide: DataFrame) -> DataFrame:
    """(subject, predicate, val) of every filled cell of a wide table."""
    return wide.select(F.col("entity").alias("subject"), F.explode("cells").alias("predicate", "val"))
