"""Values of expressions: native columns with a static kind, or TERM columns whose type is known only at run time.

An error and an unbound value are both NULL, so Spark's three-valued logic is the error logic of the query language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from quadloom.functions.xsd import LEXICAL
from quadloom.terms import IRI, LITERAL, Term, term_col

#: Kinds of native values and the datatype of the literals they stand for.
NATIVE = {"bool": "xsd:boolean", "int": "xsd:integer", "dec": "xsd:decimal", "flt": "xsd:float", "dbl": "xsd:double", "str": "xsd:string", "time": "xsd:dateTime", "date": "xsd:date"}
RANK = {"int": 0, "dec": 1, "flt": 2, "dbl": 3}
DEC = "decimal(38,12)"
#: Datatypes derived from xsd:integer.
INTEGERS = ["integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger"]
INTEGER_DT = [f"xsd:{x}" for x in INTEGERS]
EXACT_DT = [*INTEGER_DT, "xsd:decimal"]
NUMERIC_DT = [*EXACT_DT, "xsd:float", "xsd:double"]


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, which keeps expressions that use it often small."""
    return F.element_at(F.transform(F.array(x), f), 1)


@dataclass
class Val:
    """kind: a native kind, 'iri' (text of an IRI), or 'term'."""

    kind: str
    col: Column

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind == "iri":
            return term_col(IRI, self.col)
        return term_col(LITERAL, lexical(self), F.lit(NATIVE[self.kind]))

    @property
    def numeric(self) -> bool:
        return self.kind in RANK


def const(t: Term) -> Val:
    """A constant as the most specific kind whose value its text is."""
    if t.k == IRI:
        return Val("iri", F.lit(t.v))
    if t.k == LITERAL and t.dt == "xsd:string":
        return Val("str", F.lit(t.v))
    import re

    if t.k == LITERAL and t.dt in ("xsd:integer", "xsd:decimal", "xsd:double", "xsd:boolean") and re.match(LEXICAL[t.dt[4:]], t.v):
        if t.dt == "xsd:boolean":
            return Val("bool", F.lit(t.v in ("true", "1")))
        if t.dt == "xsd:integer" and str(int(t.v)) == t.v and abs(int(t.v)) < 1 << 62:
            return Val("int", F.lit(int(t.v)).cast("bigint"))
        if t.dt == "xsd:double" and "N" not in t.v:
            return Val("dbl", F.lit(float(t.v)))
        if t.dt == "xsd:decimal" and len(t.v) < 25:
            return Val("dec", F.expr(f"cast('{t.v}' as {DEC})"))
    return Val("term", t.col())


def double_lexical(x: Column) -> Column:
    """Canonical text of a double column."""
    return let(x, _double_lexical)


def _double_lexical(x: Column) -> Column:
    s = F.abs(x).cast("string")
    digits, whole = F.replace(s, F.lit("."), F.lit("")), F.instr(s, ".") - 1
    kept = F.regexp_replace(digits, "^0+", "")
    frac = F.regexp_replace(F.substring(kept, 2, 400), "0+$", "")
    plain = F.concat(F.substring(kept, 1, 1), F.lit("."), F.when(frac == "", "0").otherwise(frac), F.lit("E"), (whole - (F.length(digits) - F.length(kept)) - 1).cast("string"))
    body = F.when(x == 0, "0.0E0").when(s.contains("E"), s).otherwise(plain)
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(x == F.lit(float("inf")), "INF").when(x == F.lit(float("-inf")), "-INF").otherwise(F.concat(sign, body))


def decimal_lexical(x: Column) -> Column:
    """Canonical text of a decimal column: at least one digit on either side of the point."""
    s = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def lexical(v: Val) -> Column:
    """The lexical form of a native value."""
    if v.kind in ("dbl", "flt"):
        return double_lexical(v.col.cast("double"))
    if v.kind == "dec":
        return decimal_lexical(v.col)
    if v.kind == "time":
        return F.replace(v.col.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    return v.col.cast("string")


def is_numeric(t: Column) -> Column:
    """Numeric datatype and well-formed."""
    return F.when(t["k"].isNotNull(), (t["k"] == LITERAL) & F.coalesce(as_double(t).isNotNull(), F.lit(False)))


def as_double(t: Column) -> Column:
    ok = (
        (t["dt"].isin(*INTEGER_DT) & t["v"].rlike(LEXICAL["integer"]))
        | ((t["dt"] == "xsd:decimal") & t["v"].rlike(LEXICAL["decimal"]))
        | (t["dt"].isin("xsd:double", "xsd:float") & t["v"].rlike(LEXICAL["double"]))
    )
    text = F.regexp_replace(t["v"], "INF", "Infinity")
    return F.when((t["k"] == LITERAL) & ok, text.try_cast("double"))


def as_decimal(t: Column) -> Column:
    return F.when((t["k"] == LITERAL) & t["dt"].isin(*EXACT_DT) & t["v"].rlike(LEXICAL["decimal"]), t["v"].try_cast(DEC))


def rank_of(t: Column) -> Column:
    return F.when(t["dt"].isin(*INTEGER_DT), 0).when(t["dt"] == "xsd:decimal", 1).when(t["dt"] == "xsd:float", 2).when(t["dt"] == "xsd:double", 3)


def instant(text: Column) -> Column:
    """The UTC timestamp (NTZ microseconds as text order key) of a dateTime lexical form; without a zone as if UTC."""
    ok = text.rlike(LEXICAL["dateTime"])
    day = F.regexp_replace(text, r"T24:00:00(\.0+)?", "T00:00:00")
    ts = F.when(ok, _zoned(day).try_cast("timestamp"))
    return F.when(text.contains("T24:"), ts + F.expr("interval 1 day")).otherwise(ts)


def _zoned(day: Column) -> Column:
    cut = F.regexp_replace(day, r"(\.\d{6})\d+", "$1")
    return F.when(cut.rlike(r"(Z|[+-]\d\d:\d\d)$"), cut).otherwise(F.concat(cut, F.lit("Z")))


def has_zone(text: Column) -> Column:
    return text.rlike(r"(Z|[+-]\d\d:\d\d)$")


def _cmp(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _double_cmp(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison: NaN equals nothing and is not ordered."""
    out = _cmp(op, a, b)
    nan = F.isnan(a) | F.isnan(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(nan, F.lit(op == "!=")).otherwise(out)


def compare(op: str, a: Val, b: Val) -> Column:
    """A comparison operator on two values."""
    if a.numeric and b.numeric:
        if "dbl" in (a.kind, b.kind) or "flt" in (a.kind, b.kind):
            return _double_cmp(op, a.col.cast("double"), b.col.cast("double"))
        return _cmp(op, a.col, b.col)
    if a.kind == b.kind and a.kind in ("str", "bool", "time", "date") or (a.kind == b.kind == "iri" and op in ("=", "!=")):
        return _cmp(op, a.col, b.col)
    if {a.kind, b.kind} == {"term", "iri"} and op in ("=", "!="):
        t, i = (a.col, b.col) if a.kind == "term" else (b.col, a.col)
        same = F.when(t.isNotNull() & i.isNotNull(), (t["k"] == IRI) & (t["v"] == i))
        return same if op == "=" else ~same
    if (a.numeric and b.kind == "term") or (b.numeric and a.kind == "term"):
        n, t, flip = (a, b.col, False) if a.numeric else (b, a.col, True)
        x, y = n.col.cast("double"), as_double(t)
        x, y = (y, x) if flip else (x, y)
        out = _double_cmp(op, x, y)
        if op in ("=", "!="):  # a term of another known kind is different, of an unknown one an error
            out = F.coalesce(out, F.when((t["k"] != LITERAL) | _known(t), F.lit(op == "!=")))
        return out
    if (a.kind == "str" and b.kind == "term") or (b.kind == "str" and a.kind == "term"):
        s, t, flip = (a.col, b.col, False) if a.kind == "str" else (b.col, a.col, True)
        plain = F.when((t["k"] == LITERAL) & (t["dt"] == "xsd:string"), t["v"])
        x, y = (plain, s) if flip else (s, plain)
        out = _cmp(op, x, y)
        if op in ("=", "!="):
            out = F.coalesce(out, F.when((t["k"] != LITERAL) | _known(t), F.lit(op == "!=")))
        return out
    return let(F.struct(a.term().alias("a"), b.term().alias("b")), lambda x: _dynamic(op, x["a"], x["b"]))


def _known(t: Column) -> Column:
    """A literal of a datatype whose values are known, and well-formed."""
    return (
        t["dt"].isin("xsd:string", "rdf:langString")
        | F.coalesce(as_double(t).isNotNull(), F.lit(False))
        | ((t["dt"] == "xsd:boolean") & t["v"].rlike(LEXICAL["boolean"]))
        | ((t["dt"] == "xsd:dateTime") & t["v"].rlike(LEXICAL["dateTime"]))
        | ((t["dt"] == "xsd:date") & t["v"].rlike(LEXICAL["date"]))
    )


def _dynamic(op: str, a: Column, b: Column) -> Column:
    dt = lambda *x: a["dt"].isin(*x) & b["dt"].isin(*x)
    x, y = as_double(a), as_double(b)
    number = F.when(dt(*EXACT_DT), _cmp(op, as_decimal(a), as_decimal(b))).otherwise(_double_cmp(op, x, y))
    truth = lambda t: F.when(t["v"].isin("true", "1"), 1).when(t["v"].isin("false", "0"), 0)
    ta, tb = instant(a["v"]), instant(b["v"])
    moment = F.when(has_zone(a["v"]) == has_zone(b["v"]), _cmp(op, ta, tb)).when(ta != tb, _cmp(op, ta, tb))
    day = lambda t: F.when(t["v"].rlike(LEXICAL["date"]), F.regexp_replace(t["v"], r"(?:Z|[+-]\d\d:\d\d)$", ""))
    dates = F.when(has_zone(a["v"]) == has_zone(b["v"]), _cmp(op, day(a), day(b))).when(day(a) != day(b), _cmp(op, day(a), day(b)))  # one day with and without a zone: undecided
    lits = (a["k"] == LITERAL) & (b["k"] == LITERAL)
    out = (
        F.when(~lits, F.lit(None).cast("boolean"))
        .when(x.isNotNull() & y.isNotNull(), number)
        .when(dt("xsd:string"), _cmp(op, a["v"], b["v"]))
        .when(dt("xsd:boolean"), _cmp(op, truth(a), truth(b)))
        .when(dt("xsd:dateTime", "xsd:dateTimeStamp"), moment)
        .when(dt("xsd:date"), dates)
    )
    if op not in ("=", "!="):
        return out.when(dt("rdf:langString") & (a["lang"] == b["lang"]), _cmp(op, a["v"], b["v"]))
    same = F.coalesce(a == b, F.lit(False))
    pos = op == "="
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean"))
        .when(same, F.when(x.isNotNull() & F.isnan(x), F.lit(not pos)).otherwise(F.lit(pos)))
        .when(~lits, F.lit(not pos))
        .when(out.isNotNull(), out)
        .when((a["dt"] == "rdf:langString") | (b["dt"] == "rdf:langString"), F.lit(not pos))  # a tagged literal equals only itself
        .when(_known(a) & _known(b) & ~dt("xsd:dateTime") & ~dt("xsd:date"), F.lit(not pos))
    )


def ebv(v: Val) -> Column:
    """The effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind == "str":
        return v.col != ""
    if v.numeric:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "term":
        t = v.col
        n = as_double(t)
        return (
            F.when(t["dt"] == "xsd:boolean", F.when(t["v"].isin("true", "1"), True).when(t["v"].isin("false", "0"), False))
            .when(t["dt"] == "xsd:string", t["v"] != "")
            .when(n.isNotNull(), (n != 0) & ~F.isnan(n))
            .when(t["dt"].isin(*NUMERIC_DT), F.lit(False))
        )
    return F.lit(None).cast("boolean")


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """+ - * / with type promotion; division of exact numbers by zero is an error."""
    if a.numeric and b.numeric:
        kind = max((a.kind, b.kind), key=RANK.__getitem__)
        if kind in ("dbl", "flt"):
            x, y = a.col.cast("double"), b.col.cast("double")
            if op == "/":
                inf = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
                return Val(kind, F.when(y == 0, inf).otherwise(F.try_divide(x, y)))
            return Val(kind, {"+": x + y, "-": x - y, "*": x * y}[op])
        if op == "/":
            return Val("dec", F.try_divide(a.col.cast("decimal(28,10)"), b.col.cast("decimal(20,8)")).try_cast(DEC))
        if kind == "int":
            return Val("int", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col))
        x, y = a.col.cast("decimal(28,10)"), b.col.cast("decimal(28,10)")
        return Val("dec", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y).try_cast(DEC))
    if not all(v.numeric or v.kind == "term" for v in (a, b)):
        return Val("dbl", F.lit(None).cast("double"))
    parts = lambda t: [rank_of(t), as_decimal(t), as_double(t)]
    names = [f"{n}{i}" for i in "ab" for n in ("rank", "dec", "dbl")]
    terms = F.struct(a.term().alias("a"), b.term().alias("b"))  # bound once: a sum of sums would double with each step
    both = let(terms, lambda t: F.struct(*[c.alias(n) for n, c in zip(names, parts(t["a"]) + parts(t["b"]), strict=True)]))

    def compute(x: Column) -> Column:
        rank = F.when(x["ranka"].isNotNull() & x["rankb"].isNotNull(), F.greatest(x["ranka"], x["rankb"], F.lit(1 if op == "/" else 0)))
        exact = arithmetic(op, Val("dec", x["deca"]), Val("dec", x["decb"])).col
        return F.struct(rank.alias("r"), exact.alias("e"), arithmetic(op, Val("dbl", x["dbla"]), Val("dbl", x["dblb"])).col.alias("i"))

    return Val("term", let(let(both, compute), lambda x: number_term(x["r"], x["e"], x["i"])))


def number_term(rank: Column, exact: Column, inexact: Column) -> Column:
    """A numeric TERM of the datatype of a rank, from its exact or inexact value."""
    text = F.when(rank == 0, exact.cast("decimal(38,0)").cast("string")).when(rank == 1, decimal_lexical(exact)).otherwise(double_lexical(inexact))
    dt = F.when(rank == 0, "xsd:integer").when(rank == 1, "xsd:decimal").when(rank == 2, "xsd:float").otherwise("xsd:double")
    return term_col(LITERAL, F.when(rank.isNotNull(), text), dt)


def order_key(v: Val) -> list[Column]:
    """Columns that sort values: unbound, blank nodes, IRIs, literals by value within a class."""
    if v.kind != "term":
        return [v.col]
    t = v.col
    n = as_double(t)
    cls = F.when(t.isNull(), -1).when(n.isNotNull(), 0).when(t["dt"] == "xsd:boolean", 1).when(t["dt"].isin("xsd:dateTime", "xsd:date"), 2).otherwise(3)
    moment = F.when(t["dt"] == "xsd:dateTime", instant(t["v"]))
    return [F.coalesce(t["k"].cast("int"), F.lit(-1)), cls, n, moment, t["v"], t["dt"], t["lang"]]
