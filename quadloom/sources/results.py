"""Query results as JSON, XML, CSV and TSV, and JSON results read back.

write_results streams solutions through the driver row by row; write_results_dir writes whole results by partition.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape as xml_escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quadloom.engine import Solutions
from quadloom.errors import ParseError, QueryError
from quadloom.terms import BNODE, IRI, LITERAL, TRIPLE, Term, full_dt, nt_text, short_dt

FORMATS = {
    "json": "json", "application/sparql-results+json": "json", "xml": "xml", "application/sparql-results+xml": "xml",
    "csv": "csv", "text/csv": "csv", "tsv": "tsv", "text/tab-separated-values": "tsv",
}

_PARTS = re.compile(r"<<\( (<[^>]*>|_:\S+) (<[^>]*>) (.*) \)>>\Z", re.DOTALL)
_LIT = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+?)(?:--(ltr|rtl))?|\^\^<([^>]*)>)?\Z', re.DOTALL)


def parse_nt_term(text: str) -> Term:
    """A Term of its canonical N-Triples text."""
    from quadloom.plans.lexer import unescape

    if text.startswith("<<("):
        return Term(TRIPLE, text)
    if text.startswith("<"):
        return Term(IRI, unescape(text[1:-1]))
    if text.startswith("_:"):
        return Term(BNODE, text[2:])
    m = _LIT.match(text)
    if not m:
        raise ParseError(f"no term: {text!r}")
    v, lang, direction, dt = m.groups()
    kind = ("rdf:dirLangString" if direction else "rdf:langString") if lang else short_dt(dt) if dt else "xsd:string"
    return Term(LITERAL, unescape(v), kind, lang.lower() if lang else None, direction)


def triple_parts(t: Term) -> tuple[Term, Term, Term]:
    m = _PARTS.match(t.v)
    if not m:
        raise ParseError(f"no triple term: {t.v!r}")
    return tuple(parse_nt_term(x) for x in m.groups())


def _json_term(t: Term) -> dict:
    if t.k == IRI:
        return {"type": "uri", "value": t.v}
    if t.k == BNODE:
        return {"type": "bnode", "value": t.v}
    if t.k == TRIPLE:
        return {"type": "triple", "value": dict(zip(("subject", "predicate", "object"), map(_json_term, triple_parts(t)), strict=True))}
    out = {"type": "literal", "value": t.v}
    if t.lang:
        out["xml:lang"] = t.lang
        if t.dir:
            out["its:dir"] = t.dir
    elif t.dt and t.dt != "xsd:string":
        out["datatype"] = full_dt(t.dt)
    return out


def _xml_term(t: Term) -> str:
    if t.k == IRI:
        return f"<uri>{xml_escape(t.v)}</uri>"
    if t.k == BNODE:
        return f"<bnode>{xml_escape(t.v)}</bnode>"
    if t.k == TRIPLE:
        parts = zip(("subject", "predicate", "object"), triple_parts(t), strict=True)
        return "<triple>" + "".join(f"<{n}>{_xml_term(x)}</{n}>" for n, x in parts) + "</triple>"
    attr = f" xml:lang={quoteattr(t.lang)}" if t.lang else f" datatype={quoteattr(full_dt(t.dt))}" if t.dt not in (None, "xsd:string") else ""
    if t.dir:
        attr += f' xmlns:its="http://www.w3.org/2005/11/its" its:dir={quoteattr(t.dir)}'
    return f"<literal{attr}>{xml_escape(t.v)}</literal>"


def _rows(s: Solutions):
    for row in s.terms.toLocalIterator():
        yield [None if x is None else Term(*x) for x in row]


def write_results(out: io.TextIOBase, result: Solutions | bool, format: str) -> None:
    """Write the result of a SELECT or ASK."""
    fmt = FORMATS.get(format)
    if fmt is None:
        raise QueryError(f"unknown result format {format!r}")
    if isinstance(result, bool):
        if fmt == "json":
            out.write(json.dumps({"head": {}, "boolean": result}))
        elif fmt == "xml":
            out.write(f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{str(result).lower()}</boolean></sparql>\n')
        else:
            raise QueryError(f"ASK has no {fmt.upper()} form")
        return
    names = result.vars
    if fmt in ("json", "xml"):
        out.writelines(_pieces(names, _rows(result), fmt))
    elif fmt == "csv":
        w = csv.writer(out, lineterminator="\r\n")
        w.writerow(names)
        for row in _rows(result):
            w.writerow(["" if t is None else f"_:{t.v}" if t.k == BNODE else t.v for t in row])
    else:
        out.write("\t".join(f"?{n}" for n in names) + "\n")
        for row in _rows(result):
            out.write("\t".join("" if t is None else t.nt() for t in row) + "\n")


def _documents(result: Solutions, fmt: str) -> DataFrame:
    """(value): the lines of one whole JSON or XML result per partition."""
    names = result.vars
    rows = result.terms.select(F.array(*[F.col(f"`{n}`") for n in names]).alias("row"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = io.StringIO()
        for i, text in enumerate(_pieces(names, ([None if x is None else Term(*(x[k] for k in ("k", "v", "dt", "lang", "dir"))) for x in row] for b in batches for row in b["row"]), fmt)):
            out.write(text)
            if i % 10_000 == 9_999:
                yield pd.DataFrame({"value": [out.getvalue().rstrip("\n")]})
                out = io.StringIO()
        yield pd.DataFrame({"value": [out.getvalue().rstrip("\n")]})

    return rows.mapInPandas(lines, "value string")


def _pieces(names: list[str], rows: Iterable[list[Term | None]], fmt: str) -> Iterator[str]:
    """A JSON or XML result in pieces that end in line breaks."""
    if fmt == "json":
        yield json.dumps({"head": {"vars": names}})[:-1] + ', "results": {"bindings": [\n'
        comma = ""
        for row in rows:
            yield comma + json.dumps({n: _json_term(t) for n, t in zip(names, row, strict=True) if t is not None}, ensure_ascii=False) + "\n"
            comma = ","
        yield "]}}\n"
    else:
        yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head>' + "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head>\n<results>\n"
        for row in rows:
            yield "<result>" + "".join(f"<binding name={quoteattr(n)}>{_xml_term(t)}</binding>" for n, t in zip(names, row, strict=True) if t is not None) + "</result>\n"
        yield "</results>\n</sparql>\n"


def write_results_dir(result: Solutions, path: str, format: str, mode: str = "error") -> None:
    """Files written by all executors, each a whole result with its own header."""
    fmt = FORMATS.get(format)
    terms = result.terms
    if fmt == "csv":
        terms.select(*[F.when(F.col(f"`{n}`.k") == BNODE, F.concat(F.lit("_:"), F.col(f"`{n}`.v"))).otherwise(F.col(f"`{n}`.v")).alias(n) for n in result.vars]).write.mode(mode).csv(path, header=True, escape='"')
    elif fmt == "tsv":
        lines = F.concat_ws("\t", *[F.coalesce(F.when(F.col(f"`{n}`").isNotNull(), nt_text(F.col(f"`{n}`"))), F.lit("")) for n in result.vars])
        terms.select(lines.alias("value")).write.mode(mode).text(path)
    elif fmt:
        _documents(result, fmt).write.mode(mode).text(path)
    else:
        raise QueryError(f"unknown result format {format!r}")


def _term(x: dict) -> Term:
    kind, v = x["type"], x["value"]
    if kind == "uri":
        return Term(IRI, v)
    if kind == "bnode":
        return Term(BNODE, v)
    if kind == "triple":
        s, p, o = (_term(v[n]) for n in ("subject", "predicate", "object"))
        return Term(TRIPLE, f"<<( {s.nt()} {p.nt()} {o.nt()} )>>")
    lang = x.get("xml:lang")
    if lang:
        return Term(LITERAL, v, "rdf:dirLangString" if x.get("its:dir") else "rdf:langString", lang.lower(), x.get("its:dir"))
    return Term(LITERAL, v, short_dt(x["datatype"]) if x.get("datatype") else "xsd:string")


def read_json(body: str) -> bool | tuple[list[str], list[dict[str, Term]]]:
    """A JSON result: a bool, or the variables and a dict of terms per solution."""
    data = json.loads(body)
    if "boolean" in data:
        return bool(data["boolean"])
    return list(data["head"].get("vars", [])), [{n: _term(t) for n, t in b.items()} for b in data["results"]["bindings"]]


def read_solutions(spark, body: str) -> Solutions | bool:
    """A JSON result as Solutions."""
    from quadloom.sources.remote import _frame
    from quadloom.engine import as_solutions

    out = read_json(body)
    return out if isinstance(out, bool) else as_solutions(_frame(spark, *out), out[0])
