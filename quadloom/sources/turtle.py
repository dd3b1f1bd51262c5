"""Turtle and TriG: one parser over a document's text, and a writer that works per subject."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.errors import ParseError
from quadloom.plans.iris import resolve
from quadloom.plans.lexer import Token, tokens, unescape, unescape_iri
from quadloom.sources.formats import DOCUMENT_CHARS, DOCUMENT_ROWS
from quadloom.terms import BNODE, IRI, LITERAL, RDF, TRIPLE, Term, full_dt, literal, nt_text

_FIRST, _REST, _NIL, _TYPE, _REIFIES = (Term(IRI, RDF + x) for x in ("first", "rest", "nil", "type", "reifies"))
Quad = tuple[Term | None, Term, Term, Term]


def unused_label(text: str) -> str:
    """A beginning of blank node labels that does not occur in a text."""
    label = "anon__"
    while label in text:
        label = "x" + label
    return label


class TurtleParser:
    """Statements of one document; graphs=True reads TriG. Blank node labels get the document's scope as prefix."""

    def __init__(self, text: str, base: str | None = None, scope: str = "", graphs: bool = False):
        self.text, self.base, self.scope, self.graphs = text, base, scope, graphs
        self.toks: list[Token] = tokens(text)
        self.i, self.n, self.anon = 0, 0, unused_label(text)
        self.prefixes: dict[str, str] = {}
        self.out: list[Quad] = []
        self.g: Term | None = None

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def fail(self, message: str) -> ParseError:
        line = self.text.count("\n", 0, self.tok.at) + 1
        return ParseError(message, line, self.tok.at - self.text.rfind("\n", 0, self.tok.at), "turtle")

    def op(self, *ops: str) -> str | None:
        if self.tok.kind == "op" and self.tok.text in ops:
            self.i += 1
            return self.toks[self.i - 1].text
        return None

    def is_op(self, *ops: str) -> bool:
        return self.tok.kind == "op" and self.tok.text in ops

    def need(self, op: str) -> None:
        if not self.op(op):
            raise self.fail(f"expected {op!r}, found {self.tok.text!r}")

    def parse(self) -> list[Quad]:
        while self.tok.kind != "end":
            self.statement()
        return self.out

    def statement(self) -> None:
        t = self.tok
        word = t.text.upper() if t.kind == "word" else t.text if t.kind == "lang" else ""
        if word in ("PREFIX", "@prefix"):
            self.i += 1
            name = self.tok
            if name.kind != "pname" or not name.text.endswith(":"):
                raise self.fail("expected a prefix")
            self.i += 1
            self.prefixes[name.text[:-1]] = self.iri_ref()
        elif word in ("BASE", "@base"):
            self.i += 1
            self.base = self.iri_ref()
        elif word in ("VERSION", "@version"):
            self.i += 1
            if self.tok.kind != "string" or self.tok.text[:3] in ('"""', "'''"):
                raise self.fail("expected a version")
            self.i += 1
        elif self.graphs and (word == "GRAPH" or self.is_op("{")):
            if word:
                self.i += 1
                self.g = self.label()
            self.block()
            return
        elif self.graphs and self._label_ahead():
            self.g = self.label()
            self.block()
            return
        else:
            self.triples()
            self.need(".")
            return
        if word.startswith("@"):
            self.need(".")

    def _label_ahead(self) -> bool:
        nxt = self.toks[self.i + 1] if self.i + 1 < len(self.toks) else self.tok
        if self.tok.kind in ("iri", "pname", "bnode"):
            return nxt.kind == "op" and nxt.text == "{"
        return self.is_op("[") and nxt.text == "]" and self.toks[self.i + 2].text == "{"

    def label(self) -> Term:
        if self.op("["):
            self.need("]")
            return self.fresh()
        return self.bnode() if self.tok.kind == "bnode" else self.iri()

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.triples()
            if not self.op(".") and not self.is_op("}"):
                raise self.fail(f"expected '.', found {self.tok.text!r}")
        self.g = None

    def iri_ref(self) -> str:
        if self.tok.kind != "iri":
            raise self.fail("expected an IRI")
        self.i += 1
        return resolve(unescape_iri(self.toks[self.i - 1].text[1:-1]), self.base)

    def iri(self) -> Term:
        t = self.tok
        if t.kind == "iri":
            return Term(IRI, self.iri_ref())
        if t.kind != "pname":
            raise self.fail(f"expected an IRI, found {t.text!r}")
        name, _, local = t.text.partition(":")
        if name not in self.prefixes:
            raise self.fail(f"prefix {name!r} is not declared")
        self.i += 1
        return Term(IRI, self.prefixes[name] + re.sub(r"\\(.)", r"\1", local))

    def fresh(self) -> Term:
        self.n += 1
        return Term(BNODE, f"{self.scope}{self.anon}{self.n}")

    def bnode(self) -> Term:
        self.i += 1
        return Term(BNODE, f"{self.scope}{self.toks[self.i - 1].text[2:]}")

    def add(self, s: Term, p: Term, o: Term) -> None:
        self.out.append((self.g, s, p, o))

    def triples(self) -> None:
        if self.is_op("["):
            s = self.node()
            if self.is_op(".", "}"):
                if self.toks[self.i - 2].text == "[":
                    raise self.fail("a blank node without properties")
                return
        elif self.is_op("<<"):
            s = self.node()
            if self.is_op(".", "}"):
                return
        elif self.is_op("<<("):
            raise self.fail("a triple term as subject")
        elif self.tok.kind in ("string", "integer", "decimal", "double"):
            raise self.fail("a literal as subject")
        else:
            s = self.node()
            if s.k == LITERAL:
                raise self.fail("a literal as subject")
        self.properties(s)

    def verb(self) -> Term:
        if self.tok.kind == "word" and self.tok.text == "a":
            self.i += 1
            return _TYPE
        return self.iri()

    def properties(self, s: Term) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.node()
                self.add(s, p, o)
                self.annotations(s, p, o)
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.is_op(".", "]", "}", "|}"):
                return

    def annotations(self, s: Term, p: Term, o: Term) -> None:
        last: Term | None = None
        while True:
            if self.op("~"):
                last = self.bnode() if self.tok.kind == "bnode" else self.iri() if self.tok.kind in ("iri", "pname") else self.fresh()
                self.add(last, _REIFIES, _triple(s, p, o))
            elif self.op("{|"):
                if self.is_op("|}"):
                    raise self.fail("an empty annotation")
                if last is None:
                    last = self.fresh()
                    self.add(last, _REIFIES, _triple(s, p, o))
                self.properties(last)
                self.need("|}")
                last = None
            else:
                return

    def node(self) -> Term:
        t = self.tok
        if t.kind == "bnode":
            return self.bnode()
        if t.kind in ("iri", "pname"):
            return self.iri()
        if self.op("["):
            b = self.fresh()
            if not self.op("]"):
                self.properties(b)
                self.need("]")
            return b
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node())
            cells = [self.fresh() for _ in items]
            for c, item, rest in zip(cells, items, [*cells[1:], _NIL], strict=False):
                self.add(c, _FIRST, item)
                self.add(c, _REST, rest)
            return cells[0] if cells else _NIL
        if self.op("<<("):
            s, p, o = self.inner(), self.verb(), self.inner(True)
            self.need(")>>")
            return _triple(s, p, o)
        if self.op("<<"):
            s, p, o = self.inner(), self.verb(), self.inner(True)
            r = None
            if self.op("~") and not self.is_op(">>"):
                r = self.bnode() if self.tok.kind == "bnode" else self.iri()
            self.need(">>")
            r = r or self.fresh()
            self.add(r, _REIFIES, _triple(s, p, o))
            return r
        return self.literal()

    def inner(self, object: bool = False) -> Term:
        if self.op("["):
            self.need("]")
            return self.fresh()
        if self.is_op("(") or (self.is_op("<<(") and not object):
            raise self.fail("not allowed in a triple term")
        t = self.node()
        if t.k == LITERAL and not object:
            raise self.fail("a literal as subject")
        return t

    def literal(self) -> Term:
        t = self.tok
        if t.kind == "string":
            self.i += 1
            q = 3 if t.text[:3] in ('"""', "'''") else 1
            v = unescape(t.text[q:-q])
            if self.tok.kind == "lang":
                tag, _, direction = self.tok.text[1:].partition("--")
                if direction not in ("", "ltr", "rtl"):
                    raise self.fail(f"base direction {direction!r}")
                self.i += 1
                return literal(v, lang=tag, dir=direction or None)
            if self.op("^^"):
                dt = self.iri().v
                if dt in (RDF + "langString", RDF + "dirLangString"):
                    raise self.fail("a language-tagged datatype without a tag")
                return literal(v, dt)
            return literal(v)
        sign = self.op("+", "-") or ""
        t = self.tok
        if t.kind in ("integer", "decimal", "double"):
            self.i += 1
            nxt = self.tok
            if nxt.kind in ("word", "pname") and nxt.at == t.at + len(t.text):
                raise self.fail("a letter after a number")
            return literal(sign + t.text, f"xsd:{t.kind}")
        if t.kind == "word" and t.text in ("true", "false"):
            self.i += 1
            return literal(t.text, "xsd:boolean")
        raise self.fail(f"unexpected {t.text!r}")


def _triple(s: Term, p: Term, o: Term) -> Term:
    return Term(TRIPLE, f"<<( {s.nt()} {p.nt()} {o.nt()} )>>")


# writing

_LOCAL = r"[A-Za-z_][A-Za-z0-9_-]*"


def turtle_text(t: Column, prefixes: dict[str, str]) -> Column:
    """Turtle text of a TERM column, IRIs abbreviated by the longest fitting prefix."""
    out = nt_text(t)
    name = F.lit(None).cast("string")
    for label, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        rest = F.substr(t["v"], F.lit(len(ns) + 1))
        name = F.when(t["v"].startswith(ns) & rest.rlike(f"^(?:{_LOCAL})?$"), F.concat(F.lit(f"{label}:"), rest)).otherwise(name)
    dt = F.lit(None).cast("string")
    for label, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        if full_dt("xsd:") == ns:
            dt = F.when(t["dt"].startswith("xsd:") & (t["dt"] != "xsd:string") & t["lang"].isNull(), F.concat(F.regexp_extract(out, r'(?s)^(".*")\^\^', 1), F.lit(f"^^{label}:"), F.substr(t["dt"], F.lit(5))))
    return F.when(t["k"] == IRI, F.coalesce(name, out)).otherwise(F.coalesce(dt, out))


def subject_blocks(triples: DataFrame, prefixes: dict[str, str] | None = None, by: tuple[str, ...] = ("s",), block: int = 10_000) -> DataFrame:
    """One text per subject (and other grouping columns): its predicates in order, objects comma-separated.

    A subject with more than `block` statements gets several texts, which the syntax allows, so that no task holds all of a hot subject.
    """
    prefixes = prefixes or {}
    none = F.lit(None).cast("string")
    verb = F.struct(F.lit(IRI).alias("k"), F.col("p").alias("v"), none.alias("dt"), none.alias("lang"), none.alias("dir"))
    p = F.when(F.col("p") == RDF + "type", F.lit("a")).otherwise(turtle_text(verb, prefixes))
    hot = triples.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(*[F.col(c).alias(f"{c}2") for c in by], F.ceil(F.col("n") / block).alias("parts"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}2"))
    rows = triples.join(hot, on, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("p", "o"), F.col("parts")), F.lit(0)))
    objects = rows.groupBy(*by, "part", "p").agg(F.array_join(F.array_sort(F.collect_set(turtle_text(F.col("o"), prefixes))), ", ").alias("os"))
    lines = objects.select(*by, "part", F.concat(p, F.lit(" "), F.col("os")).alias("line"), (F.col("p") != RDF + "type").alias("later"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("later", "line"))), lambda x: x["line"]), " ;\n    ")
    return lines.groupBy(*by, "part").agg(body.alias("body")).select(*by, F.concat(turtle_text(F.col("s"), prefixes), F.lit(" "), F.col("body"), F.lit(" .")).alias("text"))


def header(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in sorted(prefixes.items()))


def turtle_chunks(triples: DataFrame, prefixes: dict[str, str] | None = None) -> Iterator[str]:
    """A Turtle document in pieces, subjects in order."""
    yield header(prefixes or {})
    for r in subject_blocks(triples, prefixes).orderBy("s").toLocalIterator():
        yield r["text"] + "\n"


def trig_chunks(quads: DataFrame, prefixes: dict[str, str] | None = None) -> Iterator[str]:
    """A TriG document in pieces: the default graph, then named graphs in order of their names."""
    yield header(prefixes or {})
    blocks = subject_blocks(quads, prefixes, ("g", "s"))
    now = None
    for r in blocks.select("g", "s", "text", turtle_text(F.col("g"), prefixes or {}).alias("name")).orderBy(F.col("g").asc_nulls_first(), "s").toLocalIterator():
        if r["name"] != now:
            if now is not None:
                yield "}\n"
            now = r["name"]
            yield f"{now} {{\n"
        yield ("    " if now is not None else "") + r["text"] + "\n"
    if now is not None:
        yield "}\n"


def document_rows(quads: DataFrame, prefixes: dict[str, str] | None = None, graphs: bool = False) -> tuple[DataFrame, list[str], list[str], Callable[[Iterable[tuple]], Iterator[str]]]:
    """The texts of statements, the columns that place them and those that order them further, and what makes documents of them in that order."""
    prefixes = prefixes or {}
    none = F.lit(None).cast("string")
    verb = F.struct(F.lit(IRI).alias("k"), F.col("p").alias("v"), none.alias("dt"), none.alias("lang"), none.alias("dir"))
    typed = F.col("p") == RDF + "type"
    name = F.when(F.col("g").isNotNull(), turtle_text(F.col("g"), prefixes)) if graphs else none
    rows = quads.select(name.alias("name"), turtle_text(F.col("s"), prefixes).alias("subject"), (~typed).alias("later"), F.when(typed, "a").otherwise(turtle_text(verb, prefixes)).alias("verb"), turtle_text(F.col("o"), prefixes).alias("object"))
    return rows, ["name", "subject"], ["later", "verb", "object"], partial(documents, top=header(prefixes))


def documents(rows: Iterable[tuple], top: str) -> Iterator[str]:
    """Whole documents of bounded size from rows (graph, subject, _, verb, object) of texts in order; one without statements if there are none."""
    none = (None,) * 4
    out, n, size, last = [top], 0, 0, none

    def end(block: bool) -> str:
        return (" .\n" if last[1] else "") + ("}\n" if block and last[0] else "")

    for name, s, _, p, o in rows:
        row = (name, s, p, o)
        if row == last:
            continue
        if n >= DOCUMENT_ROWS or size >= DOCUMENT_CHARS:
            yield "".join(out) + end(True)
            out, n, size, last = [top], 0, 0, none
        if last[1] is None or name != last[0]:
            text = f"{end(True)}{name} {{\n{s} {p} {o}" if name else f"{end(True)}{s} {p} {o}"
        elif s != last[1]:
            text = f"{end(False)}{s} {p} {o}"
        else:
            text = f", {o}" if p == last[2] else f" ;\n    {p} {o}"
        out.append(text)
        n, size, last = n + 1, size + len(text), row
    yield "".join(out) + end(True)
