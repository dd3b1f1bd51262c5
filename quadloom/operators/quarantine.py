"""Statement lines: valid rows loaded, faulty rows apart with the reason.

Each line is first cut into subject, predicate, object and tail by one loose pattern (the structural check). Terms that a quick exact pattern knows to
be valid need no more. The lines with any other term are written once; of each of their columns every distinct term is checked once, the faulty ones
with their reasons form a dictionary, and that is joined back to the written lines. A column's part of the dictionary is broadcast up to a checked size;
beyond it the join shuffles, lines without structure never take part in it, and adaptive execution splits a hot term. Lines without a fault are loaded
with their terms decoded.

Reasons: 'terms' (not exactly subject, predicate, object and dot), 'quoting', 'iri', 'lang', 'value'. Defined results: NULL lines count as blank;
blank lines and comments are neither loaded nor rejected; an empty table gives two empty results; repeated lines each come out under their own id;
where a line has several faults the first of iri, quoting, lang, value in the order subject, predicate, object is given. Other columns of the input
are carried along unchanged except those named subject, predicate, object or reason, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.functions.values import let
from quadloom.functions.xsd import LEXICAL, XSD
from quadloom.session import BROADCAST_ROWS, cut

_WS = r"[ \t]"
_BNODE = r"_:[\p{L}\p{N}_:](?:[\p{L}\p{N}_:.·̀-ͯ‿⁀-]*[\p{L}\p{N}_:·̀-ͯ‿⁀-])?"
_SUFFIX = r"(?:@[^\s]*|\^\^<[^>]*>)?"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'  # possessive: Java matches it without recursion, however long
_ANY_IRI = r"<(?!<\()[^>]*>"
_QUOTED = r"<<\(.*\)>>"
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
#: A text whose closing quote is missing; a whole literal to the end of the line is none, its dot is missing.
_OPEN = rf"\"(?!{_INSIDE}\"{_SUFFIX}{_WS}*\r?$)(?:[^\"]*|(?={_INSIDE}$).*)"
#: Object terms from the strict to the faulty; the first that lets the line end after it is taken.
_OBJECT = rf"{_ANY_IRI}|{_QUOTED}|{_BNODE}|{_STRING}{_SUFFIX}|\".*\"{_SUFFIX}|'.*'{_SUFFIX}|{_OPEN}|[“”„«»‘’].*[“”„«»‘’]{_SUFFIX}|[^<_\"'\s#.]{_INSIDE}\"{_SUFFIX}"
_END = rf"{_WS}*\.{_WS}*(?:#.*)?\r?\n?$"
_LINE = rf"(?s)^{_WS}*({_ANY_IRI}|{_BNODE}){_WS}*({_ANY_IRI}){_WS}*({_OBJECT}){_END}"
#: Two or more well-formed terms where one object belongs.
_SEVERAL = rf"^(?:{_STRING}{_SUFFIX}|{_ANY_IRI}|{_BNODE})(?:{_WS}+(?:{_STRING}{_SUFFIX}|{_ANY_IRI}|{_BNODE}))++$"

_ESCAPED_IRI = r"\\u[0-9A-Fa-f]{4}|\\U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
_IRI_CHAR = r"[^\x00-\x20<>\"{}|^`\\]"
_IRI_OK = rf"^<[A-Za-z][A-Za-z0-9+.-]*:{_IRI_CHAR}*+(?:(?:{_ESCAPED_IRI}){_IRI_CHAR}*+)*+>$"
#: Escapes that stand for a character an IRI may not hold.
_IRI_ESCAPE_BAD = r"\\(?:u00|U000000)(?:[01][0-9A-Fa-f]|20|22|3[CcEe]|5[CcEe]|60|7[BbCcDd])|\\(?:u|U0000)[Dd][89A-Fa-f][0-9A-Fa-f]{2}"
_TEXT_OK = rf"^[^\"\\\n\r]*+(?:(?:\\[tbnrf\"'\\]|{_ESCAPED_IRI})[^\"\\\n\r]*+)*+$"
_TEXT_ESCAPE_BAD = r"(?<!\\)(?:\\\\)*\\(?:u|U0000)[Dd][89A-Fa-f][0-9A-Fa-f]{2}"
_LANG_OK = r"^[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*(?:--(?:ltr|rtl))?$"
_LITERAL = r'(?s)^"(.*)"(?:@([^\s]*)|\^\^(<[^>]*>))?$'
CHECKED = ("integer", "decimal", "double", "boolean", "date", "dateTime")
_XSD_TYPE = r"^<(?:xsd:|" + XSD.replace(".", r"\.") + r")(.*)>$"
#: The name of a checked type, a blank, and a value of its lexical space.
_VALUES = "^(?:" + "|".join(f"{kind} (?:{LEXICAL[kind][1:-1]})" for kind in CHECKED) + r")\z"


def unescape(text: Column) -> Column:
    """text with N-Triples escapes replaced; texts without a backslash are untouched."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)
    plain = F.create_map(*[F.lit(x) for kv in {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}.items() for x in kv])

    def one(p: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32")
        return F.when(p.rlike(r"^\\[uU]"), code).when(p.startswith("\\"), F.coalesce(F.try_element_at(plain, F.substring(p, 2, 1)), p)).otherwise(p)

    return F.when(text.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _iri_bad(raw: Column) -> Column:
    return ~raw.rlike(_IRI_OK) | raw.rlike(_IRI_ESCAPE_BAD)


def term_fault(raw: Column) -> Column:
    """The fault of one raw term as cut from a line, or NULL; triple terms are looked into at every depth."""
    nested = let(_peeled(raw), lambda x: F.coalesce(x["fault"], _plain_fault(x["rest"])))
    return F.when(raw.startswith("<<("), nested).otherwise(_plain_fault(raw))


def _peeled(raw: Column) -> Column:
    """(rest, fault) of a triple term: its innermost object, or the fault of the outermost level that has one. Only objects nest, so a level goes a round."""
    inner_line = rf"(?s)^<<\({_WS}*({_ANY_IRI}|{_BNODE}){_WS}*({_ANY_IRI}){_WS}*({_OBJECT}){_WS}*\)>>$"

    def level(term: Column) -> Column:
        s, p, o = (F.regexp_extract(term, inner_line, i) for i in (1, 2, 3))
        bad = (s.startswith("<") & _iri_bad(s)) | _iri_bad(p)
        return F.struct(o.alias("rest"), F.when(~term.rlike(inner_line), "terms").when(bad, "iri").alias("fault"))

    levels = F.greatest(F.size(F.split(raw, r"<<\(")) - 1, F.lit(1))  # at least as many as there are
    start = F.struct(raw.alias("rest"), F.lit(None).cast("string").alias("fault"))
    return F.aggregate(F.sequence(F.lit(1), levels), start, lambda x, _: F.when(x["fault"].isNull() & x["rest"].startswith("<<("), level(x["rest"])).otherwise(x))


def _plain_fault(raw: Column) -> Column:
    """The fault of a raw term that is no triple term, or NULL."""
    broken = F.when(raw.rlike(rf"(?s)^{_STRING}\^\^") | raw.rlike(_SEVERAL), "terms").otherwise("quoting")

    def literal(x: Column) -> Column:
        text, tag, dt = (F.get(x, F.lit(i)) for i in range(3))
        kind = F.regexp_replace(dt, _XSD_TYPE, "$1")
        wrong = kind.isin(*CHECKED) & (kind != dt) & ~F.concat(kind, F.lit(" "), unescape(text)).rlike(_VALUES)
        return (
            F.when(~text.rlike(_TEXT_OK) | text.rlike(_TEXT_ESCAPE_BAD), F.when(raw.rlike(_SEVERAL), "terms").otherwise("quoting"))
            .when(raw.rlike(r'"@[^\s"]*$') & ~tag.rlike(_LANG_OK), "lang")
            .when((dt != "") & _iri_bad(dt), "iri")
            .when(wrong, "value")
        )

    slow = F.array(*[F.regexp_extract(raw, _LITERAL, i) for i in (1, 2, 3)])
    parts = F.when(raw.contains("\n"), slow).otherwise(F.split(F.regexp_replace(raw, _LITERAL, "$1\n$2\n$3"), "\n", -1))  # one match for all three
    return (
        F.when(raw.startswith("<"), F.when(_iri_bad(raw), "iri"))
        .when(raw.startswith("_:"), F.lit(None).cast("string"))
        .when(~raw.rlike(_LITERAL), broken)
        .otherwise(let(parts, literal))
    )


def _loose_fault(line: Column) -> Column:
    """The fault of a line that the loose pattern can't cut: a quoting fault where only its object's quotes are amiss, else the terms."""
    odd = rf"(?s)^{_WS}*(?:{_ANY_IRI}|{_BNODE}){_WS}*{_ANY_IRI}{_WS}*(?:\"{_INSIDE}$|'.*'{_SUFFIX}{_END}|{_STRING}[^\s.@^<].*\.{_WS}*(?:#.*)?\r?$)"
    return F.when(line.rlike(odd), "quoting").otherwise("terms")


#: Terms that are valid for sure: IRIs of usual characters, blank nodes, texts without escapes and with a plain tag, if any.
_PLAIN_IRI = r"<[A-Za-z][A-Za-z0-9+.-]*:[A-Za-z0-9/._~#?&=%+,;:@!$*()-]*+>"
_PLAIN = rf"^(?:{_PLAIN_IRI}|{_BNODE}|\"[^\"\\\n\r]*+\"(?:@[A-Za-z]{{1,8}}(?:-[A-Za-z0-9]{{1,8}})*)?)$"


def cut_lines(df: DataFrame, line: str = "line_text") -> DataFrame:
    """The lines of df but blank ones and comments: __row (all its columns), __line, __ok (structure found) and the raw terms __s, __p, __o.

    The pattern runs once a line: its three groups come out as one text, parted by a character that the line does not have."""
    t, nul = F.col(f"`{line}`"), "\x00"
    out = df.where(t.isNotNull() & ~t.rlike(r"^[ \t]*\r?(?:$|#)"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    slow = F.when(t.rlike(_LINE), F.array(*[F.regexp_extract(t, _LINE, i) for i in (1, 2, 3)])).otherwise(F.array(t))
    parts = F.when(t.contains(nul), slow).otherwise(F.split(F.regexp_replace(t, _LINE, f"$1{nul}$2{nul}$3"), nul, -1))
    out = out.select(row, t.alias("__line"), F.explode(F.array(parts)).alias("__parts"))  # filters stay above a generator, so none repeats the pattern
    term = lambda i, name: F.get("__parts", F.lit(i)).alias(name)
    ok = F.size("__parts") == 3
    return out.select("__row", "__line", ok.alias("__ok"), *[F.when(ok, term(i, n)).alias(n) for i, n in enumerate(_TERMS)])


_TERMS = ("__s", "__p", "__o")


def _all_plain() -> Column:
    return F.col("__ok") & F.col("__s").rlike(_PLAIN) & F.col("__p").rlike(_PLAIN) & F.col("__o").rlike(_PLAIN)


def fault_dictionary(cut_rows: DataFrame) -> DataFrame:
    """(__role, __raw, __fault): each distinct faulty raw term of each column, checked once."""
    terms = cut_rows.where("__ok").select(F.explode(F.expr("array(struct(0 as r, __s as v), struct(1 as r, __p as v), struct(2 as r, __o as v))")).alias("x"))
    terms = terms.select(F.col("x.r").alias("__role"), F.col("x.v").alias("__raw")).where(~F.col("__raw").rlike(_PLAIN))
    distinct = terms.groupBy("__role", "__raw").agg(F.first("__raw").alias("__one"))  # a filter on an aggregate stays above it: one check a distinct term
    return distinct.select("__role", "__raw", term_fault(F.col("__one")).alias("__fault")).where("__fault is not null")


#: Characters of dictionary text up to which a column's part of the dictionary is broadcast; beyond it the join shuffles.
BROADCAST_CHARS = 16_000_000


def _with_faults(suspects: DataFrame) -> DataFrame:
    """suspects with __fault0..2 for their three terms. The dictionary is made once and written, so the size of its parts is known before they are joined."""
    faults = cut(fault_dictionary(suspects))
    sizes = {r["__role"]: r for r in faults.groupBy("__role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("__raw")).alias("chars")).collect()}  # at most three rows
    out = suspects.where("__ok")
    for i, c in enumerate(_TERMS):
        if i not in sizes:
            out = out.withColumn(f"__fault{i}", F.lit(None).cast("string"))
            continue
        one = faults.where(F.col("__role") == i).select(F.col("__raw").alias(c), F.col("__fault").alias(f"__fault{i}"))
        small = sizes[i]["n"] <= BROADCAST_ROWS and sizes[i]["chars"] <= BROADCAST_CHARS
        out = out.join(F.broadcast(one) if small else one, c, "left")
    return out


def reject_lines(df: DataFrame, id_col: str = "line_id", line: str = "line_text") -> DataFrame:
    """One row per faulty line: the input's columns and `reason`."""
    kept = [c for c in df.columns if c != "reason"]
    suspects = cut(cut_lines(df, line).where(~_all_plain()))
    broken = suspects.where("not __ok").select("__row", _loose_fault(F.col("__line")).alias("reason"))
    hit = broken.unionByName(_with_faults(suspects).select("__row", F.coalesce("__fault0", "__fault1", "__fault2").alias("reason")))
    return hit.where("reason is not null").select(*[F.col("__row")[c].alias(c) for c in kept], "reason")


def short_datatype(iri: Column) -> Column:
    """A datatype IRI in the short form that terms carry it in."""
    return F.when(iri.startswith(XSD), F.concat(F.lit("xsd:"), F.substr(iri, F.lit(len(XSD) + 1)))).otherwise(iri)


def decode_term(raw: Column) -> Column:
    """A raw valid term as TERM struct (k, v, dt, lang, dir); a triple term keeps its own text with k 3."""
    part = lambda i: F.regexp_extract(raw, _LITERAL, i)
    none, tag = F.lit(None).cast("string"), F.lower(part(2))
    base, direction = F.regexp_replace(tag, "--(ltr|rtl)$", ""), F.nullif(F.regexp_extract(tag, "--(ltr|rtl)$", 1), F.lit(""))
    dt = F.when(tag != "", F.when(direction.isNotNull(), "rdf:dirLangString").otherwise("rdf:langString")).when(part(3) != "", short_datatype(unescape(F.regexp_replace(part(3), "^<|>$", "")))).otherwise("xsd:string")
    term = lambda k, v, dt=none, lang=none, dr=none: F.struct(F.lit(k).cast("tinyint").alias("k"), v.alias("v"), dt.alias("dt"), lang.alias("lang"), dr.alias("dir"))
    return (
        F.when(raw.startswith("<<("), term(3, raw))
        .when(raw.startswith("<"), term(1, unescape(F.regexp_replace(raw, "^<|>$", ""))))
        .when(raw.startswith("_:"), term(0, F.substring(raw, 3, 1 << 30)))
        .otherwise(term(2, unescape(part(1)), dt, F.nullif(base, F.lit("")), direction))
    )


def load_lines(df: DataFrame, id_col: str = "line_id", line: str = "line_text") -> DataFrame:
    """One row per valid statement: the input's columns but the line, and subject, predicate (string) and object as TERM."""
    kept = [c for c in df.columns if c not in (line, "subject", "predicate", "object")]
    rows = cut_lines(df, line)
    suspects = cut(rows.where(F.col("__ok") & ~_all_plain()))
    good = _with_faults(suspects).where("coalesce(__fault0, __fault1, __fault2) is null").select("__row", *_TERMS)
    good = good.unionByName(rows.where(_all_plain()).select("__row", *_TERMS))  # plain lines need no dictionary
    return good.select(*[F.col("__row")[c].alias(c) for c in kept], decode_term(F.col("__s")).alias("subject"), decode_term(F.col("__p"))["v"].alias("predicate"), decode_term(F.col("__o")).alias("object"))


__all__ = ["LEXICAL", "cut_lines", "decode_term", "fault_dictionary", "load_lines", "reject_lines", "term_fault", "unescape"]
