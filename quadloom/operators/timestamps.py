"""Timestamps of many notations, precisions and zones as one UTC instant each.

Each text is split into a zone (an offset, an abbreviation, a zone name, or none) and a local part, and the local part into fields. A stated offset
or abbreviation gives the instant by subtraction. A zone name, stated or taken from the row's source, gives it through an as-of join of the local
time to the zone's offset intervals, exploded to local years: exactly one interval that holds the local time gives the offset, two mean that the
clock repeated this time (ambiguous), none that the clock skipped it (nonexistent).

Defined results: NULL, empty or unreadable text gives status 'unparsed' and a NULL instant; impossible fields 'invalid'; a zone that is neither
stated nor known from the source 'no_zone'; an unknown zone name or abbreviation 'unknown_zone'; a local year outside the covered ones
'out_of_range'. Every row comes out once, repeated rows too, with its own columns unchanged; new columns have the prefix `ts_`, existing columns of
these names are replaced. Fractions are kept to the microsecond in ts_instant_us (BIGINT, microseconds since 1970-01-01 UTC); digits beyond the
sixth stand in ts_sub_us, so two instants are equal where both columns are.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quadloom.functions.values import let
from quadloom.session import cut

# Usual abbreviations of zone offsets, in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240,
    "IST": 330, "AEST": 600, "AEDT": 660,
}

# Month names in English, German, French, Spanish and Italian; abbreviations of three letters are added for English.
MONTHS = [
    "january januar jänner janvier enero gennaio", "february februar februar février febrero febbraio", "march märz mars marzo",
    "april avril abril aprile", "may mai mayo maggio", "june juni juin junio giugno", "july juli juillet julio luglio",
    "august août agosto", "september septembre septiembre settembre", "october oktober octobre octubre ottobre",
    "november novembre noviembre", "december dezember décembre diciembre dicembre",
]

_CLOCK = r"(\d\d?)[:h](\d\d)(?::(\d\d)(?:[.,](\d+))?)?"
#: Notations as (name, pattern, year, month, day, ordinal day, hour group); the hour group is followed by minute, second, fraction and AM/PM.
_NOTATIONS = [
    ("iso", rf"^(\d{{4}})([-/])(\d\d?)\2(\d\d?)[Tt ]{_CLOCK}()$", "$1", "$3", "$4", "", 5),
    ("basic", r"^(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)?(?:[.,](\d+))?()$", "$1", "$2", "$3", "", 4),
    ("ordinal", rf"^(\d{{4}})-(\d{{3}})[Tt ]{_CLOCK}()$", "$1", "1", "1", "$2", 3),
    ("dotted", rf"^(\d\d?)\.(\d\d?)\.(\d{{4}}|\d\d),? {_CLOCK}()(?: Uhr)?$", "$3", "$2", "$1", "", 4),
    ("slashed", rf"^(\d\d?)/(\d\d?)/(\d{{4}}|\d\d),? {_CLOCK}(?: ?([AaPp][Mm]))?$", "$3", "$2", "$1", "", 4),
    ("day_month", rf"^(?:\p{{L}}+\.?, ?)?(\d\d?)\.?[ -](?:de )?(\p{{L}}+)\.?[ -](?:de )?(\d{{4}}),?(?: à)? {_CLOCK}(?: ?([AaPp][Mm]))?(?: Uhr)?$", "$3", "$2", "$1", "", 4),
    ("month_day", rf"^(?:\p{{L}}+\.?, ?)?(\p{{L}}+)\.? (\d\d?), (\d{{4}}),? {_CLOCK}(?: ?([AaPp][Mm]))?$", "$3", "$1", "$2", "", 4),
]
_ZONE = (
    r"^(.*?\d(?: ?[AaPp][Mm]| Uhr)?)(?: ?(?:UTC|GMT)?([+-]\d\d(?::?\d\d)?)| ?([Zz])| ((?![AaPp][Mm]$)[A-Z]{2,5}))?"
    r"(?:(?:\[| )([A-Za-z]{1,30}(?:[/_+-][A-Za-z0-9]{1,30}){1,6}|UTC|GMT)\]?)?$"  # bounded, so that a text of any length is read in linear time
)


def _month_map() -> Column:
    pairs = {w: i for i, words in enumerate(MONTHS, 1) for w in words.split()}
    pairs |= {words[:3]: i for i, words in enumerate(MONTHS, 1)} | {"sept": 9}
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def zone_intervals(wanted: DataFrame, years: tuple[int, int] = (1900, 2100)) -> DataFrame:
    """(zone, local_year, spans array<struct<since, until, offset_us>>): the offset intervals of each zone by the local years they touch.

    wanted has rows (zone, local_year); intervals are made from a zone's first to its last wanted year within the given ones. Times are local
    microseconds since 1970. Unknown zones get none. About 600 IANA names by the given years bound the table, whatever the data.
    """
    first, last = years

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us, epoch, day = timedelta(microseconds=1), datetime(1970, 1, 1, tzinfo=UTC), timedelta(days=1)
        for batch in batches:
            for name, lowest, highest in zip(batch["zone"], batch["lo"], batch["hi"], strict=True):
                try:
                    zone = zoneinfo.ZoneInfo(name)
                except (ValueError, KeyError, OSError):
                    continue
                t, end = datetime(lowest, 1, 1, tzinfo=UTC) - 2 * day, datetime(highest + 1, 1, 2, tzinfo=UTC)
                since, offset, out = t, t.astimezone(zone).utcoffset(), []
                while t < end:
                    ahead = min(t + day, end)
                    if (o := ahead.astimezone(zone).utcoffset()) != offset or ahead == end:
                        lo, hi = t, ahead
                        while o != offset and hi - lo > timedelta(seconds=1):
                            mid = (lo + (hi - lo) / 2).replace(microsecond=0)
                            if mid.astimezone(zone).utcoffset() == offset:
                                lo = mid
                            else:
                                hi = mid
                        out.append(((since - epoch + offset) // us, (hi - epoch + offset) // us, offset // us))
                        ahead = since = hi
                        offset = hi.astimezone(zone).utcoffset()
                    t = ahead
                yield pd.DataFrame(out, columns=["since", "until", "offset_us"]).assign(zone=name)

    year_of = "year(timestamp_micros({0}))"
    known = F.col("zone").isin(sorted(zoneinfo.available_timezones())) & F.col("local_year").between(first, last)
    zones = wanted.where(known).groupBy("zone").agg(F.min("local_year").alias("lo"), F.max("local_year").alias("hi"))  # at most the IANA names
    rows = zones.repartition(wanted.sparkSession.sparkContext.defaultParallelism, "zone").mapInPandas(spans, "since bigint, until bigint, offset_us bigint, zone string")
    return (
        rows.withColumn("local_year", F.explode(F.expr(f"sequence({year_of.format('since')}, {year_of.format('until - 1')})")))
        .where(F.col("local_year").between(first, last))
        .groupBy("zone", "local_year")
        .agg(F.collect_list(F.struct("since", "until", "offset_us")).alias("spans"))
    )


def normalise_timestamps(df: DataFrame, text: str = "text", source_zone: str | None = None, date_order: str | None = None, years: tuple[int, int] = (1900, 2100)) -> DataFrame:
    """df with ts_status, ts_instant_us, ts_sub_us and ts_zone; see the module's docstring.

    text, source_zone and date_order name columns; date_order holds 'dmy', 'mdy' or anything else (then slashed dates with the year last are
    unparsed, being undecidable). The parsed rows are written once, to the checkpoint folder: the zones and years they name, among the IANA names,
    decide which offset intervals are made.
    """
    keep = [c for c in df.columns if c not in ("ts_status", "ts_instant_us", "ts_sub_us", "ts_zone")]
    num = lambda i: F.get("__i", F.lit(i))
    t = F.trim(F.col(f"`{text}`"))
    order = F.col(f"`{date_order}`").cast("string") if date_order else F.lit(None).cast("string")
    given = F.col(f"`{source_zone}`").cast("string") if source_zone else F.lit(None).cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")  # the input's names can't meet those used below
    work = df.select(row, t.alias("__t"), order.alias("__order"), given.alias("__given"))
    order, given = F.col("__order"), F.col("__given")
    hit = F.regexp_replace("__t", _ZONE, "\x01$1|$2|$3|$4|$5")
    work = work.withColumn("__z", F.when(~F.col("__t").contains("|") & ~F.col("__t").contains("\x01"), hit))
    work = work.withColumn("__z", F.when(F.col("__z").startswith("\x01"), F.split(F.substring("__z", 2, 1 << 30), r"\|", -1)))
    work = work.withColumn("__b", F.expr("__z[0]"))
    unix = F.length("__t").isin(10, 13, 16) & F.col("__t").rlike(r"^\d+$")
    shape, fields = F.when(unix, "unix"), F.lit(None)
    for name, pattern, *_ in _NOTATIONS:  # the first that fits; its fields are then taken by its pattern alone
        shape = shape.when(F.col("__b").rlike(pattern), name)
    work = work.withColumn("__k", shape)
    for name, pattern, y, m, d, doy, h in _NOTATIONS:
        repl = f"{y}|{m}|{d}|{doy}|${h}|${h + 1}|${h + 2}|${h + 3}|${h + 4}"
        fields = F.when(F.col("__k") == name, F.split(F.regexp_replace("__b", pattern, repl), r"\|", -1)).otherwise(fields)
    work = work.withColumn("__f", fields)
    # Lambdas keep these projections out of whole-stage code, whose one method would be too long for the JVM to compile.
    whole = lambda x: F.when(x.rlike("^[0-9]{1,9}$"), x.cast("int"))
    work = work.withColumn("__i", F.transform(F.slice("__f", 1, 7), whole))
    named = F.col("__k").isin("day_month", "month_day")
    swap = (F.col("__k") == "slashed") & (order == "mdy")
    month = F.when(named, F.try_element_at(_month_map(), F.lower(F.expr("__f[1]")))).otherwise(num(1))
    work = work.withColumns(
        {
            "__y": F.when(F.length(F.expr("__f[0]")) == 2, F.lit(2000) + num(0)).otherwise(num(0)),
            "__m": F.when(swap, num(2)).otherwise(month),
            "__d": F.when(swap, num(1)).otherwise(num(2)),
            "__doy": num(3),
            "__h": num(4),
            "__mi": num(5),
            "__s": F.coalesce(num(6), F.lit(0)),
            "__fr": F.coalesce(F.expr("__f[7]"), F.lit("")),
            "__ap": let(F.expr("__f[8]"), F.lower),
        }
    )
    leap = "((__y % 4 = 0 and __y % 100 <> 0) or __y % 400 = 0)"
    month_len = f"case when __m in (4, 6, 9, 11) then 30 when __m = 2 then if({leap}, 29, 28) else 31 end"
    zero = "__mi = 0 and __s = 0 and rtrim('0', __fr) = ''"
    valid = F.expr(
        f"__y >= 1 and __m between 1 and 12 and __d between 1 and {month_len} and (__doy is null or __doy between 1 and if({leap}, 366, 365))"
        f" and __mi <= 59 and __s <= 59 and case when __ap <> '' then __h between 1 and 12 else __h <= 23 or (__h = 24 and {zero}) end"
    )
    hour = "case when __ap = 'pm' then __h % 12 + 12 when __ap = 'am' then __h % 12 else __h end"
    yy, mm = "(__y - if(__m <= 2, 1, 0))", "(__m + if(__m > 2, -3, 9))"
    days = f"({yy} div 400) * 146097L + ({yy} % 400) * 365 + ({yy} % 400) div 4 - ({yy} % 400) div 100 + (153 * {mm} + 2) div 5 + __d - 1 - 719468 + coalesce(__doy, 1) - 1"
    secs = f"({days}) * 86400L + ({hour}) * 3600 + __mi * 60 + __s"
    scale = F.expr("case length(__t) when 10 then 1000000L when 13 then 1000L else 1L end")
    off = let(F.expr("__z[1]"), lambda x: F.replace(x, F.lit(":"), F.lit("")))
    off_h, off_m = F.expr("try_cast(substr(__o, 2, 2) as int)"), F.expr("coalesce(try_cast(substr(__o, 4, 2) as int), 0)")
    abbr = F.when(F.expr("__z[2]") != "", F.lit("Z")).otherwise(F.expr("__z[3]"))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    work = work.withColumns({"__valid": F.coalesce(valid, F.lit(False)), "__o": off, "__a": abbr, "__n": F.expr("__z[4]")})
    work = work.withColumns(
        {
            "__local": F.when(F.col("__k") == "unix", F.expr("try_cast(__t as bigint)") * scale).when(
                F.col("__valid"), F.expr(f"({secs}) * 1000000L + cast(rpad(substr(__fr, 1, 6), 6, '0') as bigint)")
            ),
            "__off": F.when(F.col("__k") == "unix", F.lit(0))
            .when(F.col("__o") != "", F.when((off_h * 60 + off_m <= 14 * 60) & (off_m <= 59), (off_h * 60 + off_m) * F.when(F.col("__o").startswith("-"), -1).otherwise(1)))
            .when(F.col("__a") != "", F.try_element_at(table, F.col("__a"))),
            "__settled": (F.col("__k") == "unix") | (F.col("__o") != "") | (F.col("__a") != ""),
        }
    )
    zone = F.when(F.col("__n") != "", F.col("__n")).otherwise(given)
    work = work.withColumns(
        {
            "__zone": F.when(~F.coalesce("__settled", F.lit(False)) & F.col("__local").isNotNull(), zone),
        }
    )
    work = work.withColumn("__year", F.when(F.col("__k") != "unix", F.col("__y") + F.when(F.expr(f"__h = 24 and ({'__doy'} >= 365 or (__m = 12 and __d = 31))"), 1).otherwise(0)))
    work = cut(work.select("__row", "__t", "__k", "__order", "__local", "__off", "__settled", "__zone", "__year", "__fr", "__a", "__o"))
    spans = zone_intervals(work.where("__zone is not null").select(F.col("__zone").alias("zone"), F.col("__year").alias("local_year")), years)
    spans = spans.select(F.col("zone").alias("__zone"), F.col("local_year").alias("__year"), "spans")
    work = work.join(F.broadcast(spans), ["__zone", "__year"], "left")  # bounded by the IANA names times the years
    hits = F.filter("spans", lambda x: (x["since"] <= F.col("__local")) & (F.col("__local") < x["until"]))
    work = work.withColumn("__hits", hits)
    undecided = (F.col("__k") == "slashed") & ~F.coalesce(order.isin("dmy", "mdy"), F.lit(False))
    n = F.size("__hits")
    status = (
        F.when(F.col("__t").isNull() | F.col("__k").isNull() | undecided, "unparsed")
        .when(F.col("__local").isNull(), "invalid")
        .when(F.col("__settled"), F.when(F.col("__off").isNull(), "unknown_zone").otherwise("resolved"))
        .when(F.col("__zone").isNull(), "no_zone")
        .when(F.col("__hits").isNull(), F.when(F.col("__year").between(*years), "unknown_zone").otherwise("out_of_range"))
        .when(n == 1, "resolved")
        .when(n > 1, "ambiguous")
        .otherwise("nonexistent")
    )
    work = work.withColumn("ts_status", status)
    offset = F.when(F.col("__settled"), F.col("__off").cast("bigint") * 60_000_000).otherwise(F.expr("__hits[0].offset_us"))
    ok = F.col("ts_status") == "resolved"
    return work.select(
        *[F.col("__row")[c].alias(c) for c in keep],
        "ts_status",
        F.when(ok, F.col("__local") - offset).alias("ts_instant_us"),
        F.when(ok, F.expr("case when __k = 'unix' then '' else rtrim('0', substr(__fr, 7)) end")).alias("ts_sub_us"),
        F.when(F.col("__settled"), F.coalesce(F.nullif(F.col("__a"), F.lit("")), F.nullif(F.col("__o"), F.lit("")), F.lit("UTC"))).otherwise(F.col("__zone")).alias("ts_zone"),
    )


def equal_instants(df: DataFrame, id_col: str, group: str, form: list[str]) -> DataFrame:
    """Pairs (id_a < id_b) of resolved rows of one group at one instant whose form columns are not the same (NULL-safe).

    An equi-join on group and instant; adaptive execution splits a hot key. Rows with a NULL group make no pair.
    """
    a = df.where((F.col("ts_status") == "resolved") & F.col(group).isNotNull()).select(id_col, group, "ts_instant_us", "ts_sub_us", *form)
    b = a.select(*[F.col(c).alias(f"__{c}") for c in a.columns])
    same = F.lit(True)
    for c in form:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    on = (F.col(group) == F.col(f"__{group}")) & (F.col("ts_instant_us") == F.col("__ts_instant_us")) & (F.col("ts_sub_us") == F.col("__ts_sub_us"))
    return a.join(b, on & (F.col(id_col) < F.col(f"__{id_col}")) & ~same).select(F.col(id_col).alias(f"{id_col}_a"), F.col(f"__{id_col}").alias(f"{id_col}_b"))


def instant_classes(df: DataFrame, id_col: str, group: str, form: list[str]) -> DataFrame:
    """(id, class_id, n_links): the rows of equal_instants, each once, with the smallest id of its group at its instant and the number of its links, which
    are the rows there with another form. Nothing grows with the square of a class."""
    key = [group, "ts_instant_us", "ts_sub_us"]
    rows = df.where((F.col("ts_status") == "resolved") & F.col(group).isNotNull()).select(F.col(id_col).alias("__id"), *key, F.struct(*form).alias("__form"))
    forms = rows.groupBy(*key, "__form").agg(F.count(F.lit(1)).alias("own"), F.min("__id").alias("first"))
    classes = forms.groupBy(*key).agg(F.sum("own").alias("n"), F.min("first").alias("class_id"), F.count(F.lit(1)).alias("k")).where("k > 1")
    links = forms.join(classes, key).select(*key, "__form", "class_id", (F.col("n") - F.col("own")).alias("n_links"))
    return rows.join(links, [*key, "__form"]).select(F.col("__id").alias(id_col), "class_id", "n_links")
