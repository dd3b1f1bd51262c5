"""Warnings on literals: tags and lexical forms that are not valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadloom.functions.values import INTEGER_DT
from quadloom.functions.xsd import LEXICAL, matches

_TAG = r"^[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*$"


def well_formed(t):
    """Whether a literal's text is in the lexical space of its datatype; True for unknown datatypes."""
    ok = F.when(t["dt"].isin(*INTEGER_DT), matches(t["v"], "integer"))
    for kind in LEXICAL:
        if kind != "integer":
            ok = ok.when(t["dt"] == f"xsd:{kind}", matches(t["v"], kind))
    return ok.otherwise(F.lit(True))


def literal_warnings(triples: DataFrame) -> DataFrame:
    """(s, p, o, warning): 'invalid_lang_tag' or 'ill_typed_literal' for each object that has the fault."""
    o = F.col("o")
    warning = F.when(o["lang"].isNotNull() & ~o["lang"].rlike(_TAG), "invalid_lang_tag").when((o["k"] == 2) & ~well_formed(o), "ill_typed_literal")
    return triples.select("s", "p", "o", warning.alias("warning")).where("warning is not null")
