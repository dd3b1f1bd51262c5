"""XSD lexical spaces as regular expressions that Java and RE2 read alike, and typed canonical texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"

_TZ = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_MORE = r"(?:[1-9][0-9]*)?"
_LEAP_YEAR = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
#: Calendar days of the proleptic Gregorian calendar; years of four digits or more, leap days only in leap years.
_DAY = (
    rf"-?{_MORE}(?:[0-9]{{4}}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])"
    r"|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    rf"|{_LEAP_YEAR}-02-29)"
)
_TIME = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
_DEC = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"

#: Local name of a checked XSD type -> pattern of its lexical space.
LEXICAL = {
    "integer": r"^[+-]?[0-9]+$",
    "decimal": rf"^{_DEC}$",
    "double": rf"^(?:{_DEC}(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "float": rf"^(?:{_DEC}(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "boolean": r"^(?:true|false|1|0)$",
    "date": rf"^{_DAY}{_TZ}$",
    "dateTime": rf"^{_DAY}T{_TIME}{_TZ}$",
    "dateTimeStamp": rf"^{_DAY}T{_TIME}(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))$",
}


def matches(value: Column, kind: str) -> Column:
    """True where value lies in the lexical space of the XSD type; a final line break is never part of it."""
    return value.rlike(LEXICAL[kind]) & ~value.contains("\n") & ~value.contains("\r")


def collapse(value: Column) -> Column:
    """value without surrounding XSD white space."""
    return F.regexp_replace(value, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def canonical(value: Column, kind: str) -> Column:
    """One text per typed value of 'string', 'integer', 'decimal', 'boolean' or 'date'; NULL where value is invalid."""
    if kind == "string":
        return value
    v = collapse(value)
    if kind == "boolean":
        out = F.when(v.isin("true", "1"), F.lit("true")).otherwise(F.lit("false"))
    elif kind == "date":
        out = F.regexp_replace(v, r"(?:Z|[+-][0-9]{2}:[0-9]{2})$", "")
    else:
        digits = F.regexp_replace(v, r"^[+-]?0*", "")
        if kind == "decimal":
            digits = F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0*$", "")).otherwise(digits)
            digits = F.when(digits.startswith("."), F.concat(F.lit("0"), digits)).otherwise(digits)
        digits = F.when(digits == "", F.lit("0")).otherwise(digits)
        out = F.when(v.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(matches(v, kind), out)
