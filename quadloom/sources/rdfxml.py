"""RDF/XML documents as statements."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from quadloom.errors import ParseError
from quadloom.plans.iris import resolve
from quadloom.sources.turtle import unused_label
from quadloom.terms import BNODE, IRI, RDF, Term, literal

XML = "http://www.w3.org/XML/1998/namespace"
_SYNTAX = {RDF + x for x in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "bagID", "aboutEach", "aboutEachPrefix")}
_TYPE, _FIRST, _REST, _NIL, _SUBJECT, _PREDICATE, _OBJECT, _STATEMENT, _VALUE = (Term(IRI, RDF + x) for x in ("type", "first", "rest", "nil", "subject", "predicate", "object", "Statement", "value"))
_OWN_ATTRIBUTES = {f"{{{RDF}}}{x}" for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype")} | {f"{{{XML}}}lang", f"{{{XML}}}base"}


_NAME = re.compile(r"[^\W\d][\w.·-]*\Z")


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def _escaped(text: str, attribute: bool = False) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("\r", "&#xD;"), *((('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;")) if attribute else ((">", "&gt;"),))):
        text = text.replace(a, b)
    return text


def canonical_xml(e: ET.Element, prefixes: dict[str, str], shown: dict[str, str] | None = None) -> str:
    """An element in exclusive canonical form: namespaces declared where they are first used, attributes in order, no empty-element tags."""
    shown, used = shown or {}, {}

    def qname(tag: str) -> tuple[str, str, str]:
        uri, local = tag[1:].split("}", 1) if tag.startswith("{") else ("", tag)
        prefix = prefixes.get(uri, "")
        used[prefix] = uri
        return uri, local, f"{prefix}:{local}" if prefix else local

    name = qname(e.tag)[2]
    attributes = sorted((*(qname(k) if k.startswith("{") else ("", k, k)), v) for k, v in e.attrib.items())
    new = {p: u for p, u in used.items() if p != "xml" and shown.get(p, "") != u}
    head = "".join(f' xmlns{":" if p else ""}{p}="{_escaped(u, True)}"' for p, u in sorted(new.items())) + "".join(f' {q}="{_escaped(v, True)}"' for _, _, q, v in attributes)
    inner = _escaped(e.text or "") + "".join(canonical_xml(c, prefixes, shown | new) + _escaped(c.tail or "") for c in e)
    return f"<{name}{head}>{inner}</{name}>"


class RdfXmlParser:
    """Statements of one document; scope prefixes its blank node labels."""

    def __init__(self, text: str, base: str | None = None, scope: str = ""):
        self.base, self.scope, self.n, self.anon = base, scope, 0, unused_label(text)
        self.ids: set[str] = set()
        self.out: list[tuple[None, Term, Term, Term]] = []
        self.prefixes: dict[str, str] = {XML: "xml"}
        try:
            reader = ET.XMLPullParser(["start-ns", "start"])
            reader.feed(text)
            reader.close()
            events = list(reader.read_events())
            self.root = next(x for kind, x in events if kind == "start")
            for kind, x in events:
                if kind == "start-ns":
                    self.prefixes.setdefault(x[1], x[0])
        except ET.ParseError as e:
            raise ParseError(str(e), syntax="rdf/xml") from e

    def parse(self) -> list[tuple[None, Term, Term, Term]]:
        base, lang = self._context(self.root, self.base, None)
        if _name(self.root.tag) == RDF + "RDF":
            for child in self.root:
                self.node(child, base, lang)
        else:
            self.node(self.root, self.base, None)
        return self.out

    def _context(self, e: ET.Element, base: str | None, lang: str | None) -> tuple[str | None, str | None]:
        for a in ("aboutEach", "aboutEachPrefix", "bagID"):
            if e.get(f"{{{RDF}}}{a}") is not None:
                raise ParseError(f"rdf:{a} is no longer part of the syntax", syntax="rdf/xml")
        for a in ("ID", "nodeID"):
            if (name := e.get(f"{{{RDF}}}{a}")) is not None and not _NAME.match(name):
                raise ParseError(f"rdf:{a} {name!r} is no name", syntax="rdf/xml")
        if (b := e.get(f"{{{XML}}}base")) is not None:
            base = resolve(b, base).split("#")[0]
        if (new := e.get(f"{{{XML}}}lang")) is not None:
            lang = new or None
        return base, lang

    def fresh(self) -> Term:
        self.n += 1
        return Term(BNODE, f"{self.scope}{self.anon}{self.n}")

    def add(self, s: Term, p: Term, o: Term) -> None:
        self.out.append((None, s, p, o))

    def _id(self, value: str, base: str | None) -> Term:
        t = Term(IRI, resolve("#" + value, base))
        if t.v in self.ids:
            raise ParseError(f"rdf:ID {value!r} is used twice", syntax="rdf/xml")
        self.ids.add(t.v)
        return t

    def _subject(self, e: ET.Element, base: str | None) -> Term:
        names = [x for x in ("about", "ID", "nodeID") if e.get(f"{{{RDF}}}{x}") is not None]
        if len(names) > 1:
            raise ParseError(f"{names} on one node", syntax="rdf/xml")
        if not names:
            return self.fresh()
        value = e.get(f"{{{RDF}}}{names[0]}")
        if names[0] == "about":
            return Term(IRI, resolve(value, base))
        return self._id(value, base) if names[0] == "ID" else Term(BNODE, f"{self.scope}{value}")

    def node(self, e: ET.Element, base: str | None, lang: str | None) -> Term:
        base, lang = self._context(e, base, lang)
        name = _name(e.tag)
        if name in _SYNTAX or name == RDF + "li":
            raise ParseError(f"<{name}> as a node", syntax="rdf/xml")
        s = self._subject(e, base)
        if name != RDF + "Description":
            self.add(s, _TYPE, Term(IRI, name))
        self._attributes(s, e, base, lang)
        count = 0
        for child in e:
            p = _name(child.tag)
            if p == RDF + "li":
                count += 1
                p = f"{RDF}_{count}"
            elif p in _SYNTAX or p == RDF + "Description":
                raise ParseError(f"<{p}> as a property", syntax="rdf/xml")
            self.property(s, Term(IRI, p), child, base, lang)
        return s

    def _attributes(self, s: Term, e: ET.Element, base: str | None, lang: str | None) -> None:
        for a, v in e.attrib.items():
            if a in _OWN_ATTRIBUTES or not a.startswith("{") or a.startswith(f"{{{XML}}}"):
                continue
            p = _name(a)
            if p == RDF + "type":
                self.add(s, _TYPE, Term(IRI, resolve(v, base)))
            elif p == RDF + "li":
                raise ParseError("rdf:li as an attribute", syntax="rdf/xml")
            else:
                self.add(s, Term(IRI, p), literal(v, lang=lang))

    def _state(self, s: Term, p: Term, o: Term, e: ET.Element, base: str | None) -> None:
        self.add(s, p, o)
        if (rid := e.get(f"{{{RDF}}}ID")) is not None:
            r = self._id(rid, base)
            for q, x in ((_TYPE, _STATEMENT), (_SUBJECT, s), (_PREDICATE, p), (_OBJECT, o)):
                self.add(r, q, x)

    def property(self, s: Term, p: Term, e: ET.Element, base: str | None, lang: str | None) -> None:
        base, lang = self._context(e, base, lang)
        get = lambda x: e.get(f"{{{RDF}}}{x}")
        kind = get("parseType")
        if kind is not None:
            if any(get(x) is not None for x in ("resource", "nodeID", "datatype")) or any(a.startswith("{") and a not in _OWN_ATTRIBUTES for a in e.attrib):
                raise ParseError("rdf:parseType with another attribute", syntax="rdf/xml")
            if kind == "Resource":
                b = self.fresh()
                self._state(s, p, b, e, base)
                count = 0
                for child in e:
                    q = _name(child.tag)
                    if q == RDF + "li":
                        count += 1
                        q = f"{RDF}_{count}"
                    self.property(b, Term(IRI, q), child, base, lang)
            elif kind == "Collection":
                items = [self.node(child, base, lang) for child in e]
                cells = [self.fresh() for _ in items]
                self._state(s, p, cells[0] if cells else _NIL, e, base)
                for c, item, rest in zip(cells, items, [*cells[1:], _NIL], strict=False):
                    self.add(c, _FIRST, item)
                    self.add(c, _REST, rest)
            else:
                inner = _escaped(e.text or "") + "".join(canonical_xml(c, self.prefixes) + _escaped(c.tail or "") for c in e)
                self._state(s, p, literal(inner, RDF + "XMLLiteral"), e, base)
            return
        children = list(e)
        if children:
            if len(children) > 1 or (e.text or "").strip() or (children[0].tail or "").strip():
                raise ParseError(f"content of <{p.v}>", syntax="rdf/xml")
            self._state(s, p, self.node(children[0], base, lang), e, base)
            return
        extra = [a for a in e.attrib if a.startswith("{") and a not in _OWN_ATTRIBUTES and not a.startswith(f"{{{XML}}}")]
        if get("resource") is not None or get("nodeID") is not None or (extra and not (e.text or "").strip()):
            if get("resource") is not None and get("nodeID") is not None:
                raise ParseError("rdf:resource with rdf:nodeID", syntax="rdf/xml")
            o = Term(IRI, resolve(get("resource"), base)) if get("resource") is not None else Term(BNODE, f"{self.scope}{get('nodeID')}") if get("nodeID") is not None else self.fresh()
            self._state(s, p, o, e, base)
            self._attributes(o, e, base, lang)
            return
        dt = get("datatype")
        text = e.text or ""
        self._state(s, p, literal(text, resolve(dt, base)) if dt is not None else literal(text, lang=lang), e, base)
