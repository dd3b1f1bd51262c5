"""RDF terms: the column type of a term, constants, namespaces and N-Triples text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ByteType, StringType, StructField, StructType

#: k: 0 blank node, 1 IRI, 2 literal, 3 triple term (its canonical N-Triples text in v).
TERM = StructType([StructField("k", ByteType())] + [StructField(n, StringType()) for n in ("v", "dt", "lang", "dir")])
QUAD = StructType([StructField("g", TERM), StructField("s", TERM), StructField("p", StringType()), StructField("o", TERM)])
BNODE, IRI, LITERAL, TRIPLE = 0, 1, 2, 3

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Namespaces known by name.
NAMESPACES = {
    "rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#",
    "dc": "http://purl.org/dc/elements/1.1/", "dcterms": "http://purl.org/dc/terms/", "foaf": "http://xmlns.com/foaf/0.1/",
    "schema": "https://schema.org/", "sh": "http://www.w3.org/ns/shacl#",
}


class Namespace(str):
    """An IRI prefix: ns.name and ns["name"] give IRIs below it."""

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return str(self) + name

    def __getitem__(self, name):  # type: ignore[override]
        return str(self) + name if isinstance(name, str) else str.__getitem__(self, name)


rdf, rdfs, xsd, owl, skos, dc, dcterms, foaf, schema, sh = (Namespace(v) for v in NAMESPACES.values())


def short_dt(iri: str) -> str:
    """A datatype IRI in the short form that terms carry it in."""
    for name, ns in (("xsd", XSD), ("rdf", RDF)):
        if iri.startswith(ns):
            return f"{name}:{iri[len(ns) :]}"
    return iri


def full_dt(dt: str) -> str:
    return XSD + dt[4:] if dt.startswith("xsd:") else RDF + dt[4:] if dt.startswith("rdf:") else dt


@dataclass(frozen=True)
class Term:
    """A constant term; dt is short for XSD and RDF datatypes."""

    k: int
    v: str
    dt: str | None = None
    lang: str | None = None
    dir: str | None = None

    def __str__(self) -> str:
        return self.nt()

    def col(self) -> Column:
        return term_col(self.k, F.lit(self.v), F.lit(self.dt), F.lit(self.lang), F.lit(self.dir))

    def value(self):
        """The Python value of a literal; raises LiteralError outside the datatype's lexical space. IRIs and other datatypes give their text."""
        import datetime as d
        import re
        from decimal import Decimal

        from quadloom.errors import LiteralError
        from quadloom.functions.xsd import LEXICAL

        kind = (self.dt or "").removeprefix("xsd:")
        if self.k != LITERAL or not (self.dt or "").startswith("xsd:") or kind == "string":
            return self.v
        space = "integer" if kind not in LEXICAL and re.search("(?i)integer|long|int|short|byte", kind) else kind
        if space not in LEXICAL:
            return self.v
        if "\n" in self.v or not re.match(LEXICAL[space], self.v):
            raise LiteralError(f"{self.v!r} is no {self.dt}")
        if space == "boolean":
            return self.v in ("true", "1")
        if space == "integer":
            return int(self.v)
        if space == "decimal":
            return Decimal(self.v)
        if space in ("double", "float"):
            return float(self.v.replace("INF", "inf"))
        if space == "date":
            return d.date.fromisoformat(self.v[:10])
        over = "T24:00:00" in self.v
        t = d.datetime.fromisoformat(self.v.replace("T24:00:00", "T00:00:00"))
        return t + d.timedelta(days=1) if over else t

    def try_value(self):
        """value(), or None where it would raise."""
        from quadloom.errors import LiteralError

        try:
            return self.value()
        except (LiteralError, ValueError):
            return None

    def nt(self) -> str:
        if self.k == BNODE:
            return f"_:{self.v}"
        if self.k == IRI:
            return f"<{self.v}>"
        if self.k == TRIPLE:
            return self.v
        text = '"' + escape(self.v) + '"'
        if self.lang:
            return f"{text}@{self.lang}" + (f"--{self.dir}" if self.dir else "")
        return text if self.dt in (None, "xsd:string") else f"{text}^^<{full_dt(self.dt)}>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def iri(v: str) -> Term:
    return Term(IRI, v)


def bnode(v: str) -> Term:
    return Term(BNODE, v)


def literal(v, dt: str | None = None, lang: str | None = None, dir: str | None = None) -> Term:
    """A literal of a Python value or of text; the datatype follows the value's type unless given."""
    if lang:
        return Term(LITERAL, str(v), "rdf:dirLangString" if dir else "rdf:langString", lang.lower(), dir)
    if dt is None:
        import datetime as d
        from decimal import Decimal

        if isinstance(v, bool):
            v, dt = str(v).lower(), "xsd:boolean"
        elif isinstance(v, int):
            dt = "xsd:integer"
        elif isinstance(v, float):
            v, dt = double_text(v), "xsd:double"
        elif isinstance(v, Decimal):
            dt = "xsd:decimal"
        elif isinstance(v, d.datetime):
            v, dt = v.isoformat(), "xsd:dateTime"
        elif isinstance(v, d.date):
            dt = "xsd:date"
        else:
            dt = "xsd:string"
    return Term(LITERAL, str(v), short_dt(dt))


def double_text(x: float) -> str:
    """Canonical text of a double: one digit before the point, an exponent always."""
    import math

    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "INF" if x > 0 else "-INF"
    mantissa, _, exponent = f"{x!r}".partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, frac = mantissa.lstrip("-").partition(".")
    digits, point = whole + frac, len(whole) + int(exponent or 0)
    kept = digits.lstrip("0")
    if not kept:
        return f"{sign}0.0E0"
    exp = point - (len(digits) - len(kept)) - 1
    kept = kept.rstrip("0") or "0"
    return f"{sign}{kept[0]}.{kept[1:] or '0'}E{exp}"



def term_col(k: int | Column, v: Column, dt: Column | None = None, lang: Column | None = None, dir: Column | None = None) -> Column:
    """A TERM column; NULL where v is NULL."""
    none = lambda c: (F.lit(None) if c is None else c).cast("string")
    kk = (F.lit(k) if isinstance(k, int) else k).cast("tinyint")
    return F.when(v.isNotNull(), F.struct(kk.alias("k"), v.cast("string").alias("v"), none(dt).alias("dt"), none(lang).alias("lang"), none(dir).alias("dir")))


def nt_text(t: Column) -> Column:
    """N-Triples text of a TERM column."""
    esc = t["v"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), esc, F.lit('"'))
    full = F.when(t["dt"].startswith("xsd:"), F.concat(F.lit(XSD), F.substring(t["dt"], 5, 1 << 20))).when(t["dt"].startswith("rdf:"), F.concat(F.lit(RDF), F.substring(t["dt"], 5, 1 << 20))).otherwise(t["dt"])
    tagged = F.concat(quoted, F.lit("@"), t["lang"], F.coalesce(F.concat(F.lit("--"), t["dir"]), F.lit("")))
    lit = F.when(t["lang"].isNotNull(), tagged).when(t["dt"].isNull() | (t["dt"] == "xsd:string"), quoted).otherwise(F.concat(quoted, F.lit("^^<"), full, F.lit(">")))
    return F.when(t["k"] == IRI, F.concat(F.lit("<"), t["v"], F.lit(">"))).when(t["k"] == BNODE, F.concat(F.lit("_:"), t["v"])).when(t["k"] == TRIPLE, t["v"]).otherwise(lit)
