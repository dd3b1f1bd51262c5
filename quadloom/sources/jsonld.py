"""JSON-LD documents as statements, and statements as JSON-LD.

Contexts may be inline, or named by IRI and found through `contexts` (a dict or a callable); nothing is fetched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from quadloom.errors import ParseError
from quadloom.plans.iris import resolve
from quadloom.sources.formats import DOCUMENT_CHARS, DOCUMENT_ROWS
from quadloom.sources.turtle import unused_label
from quadloom.terms import BNODE, IRI, LITERAL, RDF, XSD, Term, double_text, full_dt, literal, short_dt

_TYPE, _FIRST, _REST, _NIL = (Term(IRI, RDF + x) for x in ("type", "first", "rest", "nil"))
_KEYWORDS = {"@base", "@vocab", "@version", "@import", "@propagate", "@protected", "@language", "@direction", "@context", "@id", "@type", "@value", "@list", "@set", "@graph", "@reverse", "@index", "@included", "@nest", "@json", "@container", "@none", "@prefix"}
Contexts = dict[str, Any] | Callable[[str], Any] | None


def _fail(message: str) -> ParseError:
    return ParseError(message, syntax="json-ld")


@dataclass
class TermDef:
    iri: str | None
    type: str | None = None
    container: tuple[str, ...] = ()
    language: Any = False  # False: not given
    direction: Any = False
    reverse: bool = False
    context: Any = None
    nest: str | None = None
    prefix: bool = False
    index: str = "@index"
    protected: bool = False


@dataclass
class Context:
    base: str | None = None
    vocab: str | None = None
    language: str | None = None
    direction: str | None = None
    terms: dict[str, TermDef | None] = field(default_factory=dict)
    previous: Context | None = None


_ABSOLUTE = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*|_):")
_NO_IRI = re.compile(r"[\x00-\x20<>\"{}|^`\\]")
_LIKE_KEYWORD = re.compile(r"@[A-Za-z]+\Z")
_DEFINITION = {"@id", "@reverse", "@container", "@context", "@direction", "@index", "@language", "@nest", "@prefix", "@protected", "@type"}


class JsonLdParser:
    """Quads of one document; scope prefixes its blank node labels; directions is None, 'i18n-datatype', 'compound-literal' or 'literal'."""

    def __init__(self, text: str, base: str | None = None, scope: str = "", contexts: Contexts = None, directions: str = "literal"):
        try:
            self.doc = json.loads(text, parse_float=Decimal)
        except ValueError as e:
            raise _fail(str(e)) from e
        self.base, self.scope, self.contexts, self.directions = base, scope, contexts, directions
        self.n, self.anon = 0, unused_label(text)
        self.out: list[tuple[Term | None, Term, Term, Term]] = []

    def parse(self) -> list[tuple[Term | None, Term, Term, Term]]:
        ctx = Context(base=self.base)
        for item in self.doc if isinstance(self.doc, list) else [self.doc]:
            self.top(item, ctx)
        return list(dict.fromkeys(self.out))

    def top(self, item: Any, ctx: Context) -> None:
        if not isinstance(item, dict):
            return
        inner = self.context(item["@context"], ctx) if "@context" in item else ctx
        keys = {self.keyword(k, inner) or k for k in item} - {"@context"}
        if keys <= {"@graph"} or keys == {"@graph", "@index"}:
            for k, v in item.items():
                if self.keyword(k, inner) == "@graph":
                    for x in v if isinstance(v, list) else [v]:
                        self.top(x, inner) if isinstance(x, dict) and "@context" in x else self.element(x, inner, None)
        else:
            self.element(item, ctx, None)

    # contexts

    def context(self, local: Any, ctx: Context, propagate: bool = True, override: bool = False) -> Context:
        for c in local if isinstance(local, list) else [local]:
            if c is None:
                ctx = Context(base=self.base)
                continue
            if isinstance(c, str):
                iri = resolve(c, ctx.base or self.base)
                found = self.contexts(iri) if callable(self.contexts) else (self.contexts or {}).get(iri)
                if found is None:
                    raise _fail(f"context <{iri}> is not given")
                ctx = self.context(found.get("@context", found) if isinstance(found, dict) else found, ctx)
                continue
            if not isinstance(c, dict):
                raise _fail("a context that is no object")
            if c.get("@version", 1.1) != Decimal("1.1") and c.get("@version", 1.1) != 1.1:
                raise _fail("@version is not 1.1")
            new = replace(ctx, terms=dict(ctx.terms))
            if c.get("@propagate") is False or not propagate:
                new.previous = ctx.previous or ctx
            if "@import" in c:
                c = {**self._imported(c["@import"], ctx), **{k: v for k, v in c.items() if k != "@import"}}
            if "@base" in c:
                new.base = None if c["@base"] is None else resolve(c["@base"], new.base)
            if "@vocab" in c:
                v = c["@vocab"]
                new.vocab = None if v is None else self.expand_iri(v, new, vocab=True, relative=True) if v else (new.base or "")
            if "@language" in c:
                new.language = c["@language"].lower() if c["@language"] else None
            if "@direction" in c:
                if c["@direction"] not in (None, "ltr", "rtl"):
                    raise _fail("base direction")
                new.direction = c["@direction"]
            done: set[str] = set()
            for k in c:
                if k not in ("@base", "@vocab", "@language", "@direction", "@version", "@propagate", "@protected", "@import"):
                    self.define(k, c, new, done, set(), bool(c.get("@protected")), override)
            ctx = new
        return ctx

    def _imported(self, ref: str, ctx: Context) -> dict:
        iri = resolve(ref, ctx.base or self.base)
        found = self.contexts(iri) if callable(self.contexts) else (self.contexts or {}).get(iri)
        if not isinstance(found, dict):
            raise _fail(f"context <{iri}> is not given")
        return found.get("@context", found)

    def define(self, k: str, c: dict, ctx: Context, done: set[str], active: set[str], protect: bool, override: bool) -> None:
        if k in done:
            return
        if k in active:
            raise _fail(f"cyclic definition of {k!r}")
        if k in _KEYWORDS and not (k == "@type" and isinstance(c[k], dict)):
            raise _fail(f"{k} is redefined")
        old = ctx.terms.get(k)
        v = c[k]
        active.add(k)
        if v is None or (isinstance(v, dict) and "@id" in v and v["@id"] is None):
            ctx.terms[k] = None
            done.add(k)
            return
        d = {"@id": v} if isinstance(v, str) else v
        if not isinstance(d, dict):
            raise _fail(f"definition of {k!r}")
        if set(d) - _DEFINITION:
            raise _fail(f"{min(set(d) - _DEFINITION)!r} in the definition of {k!r}")
        if k == "@type" and (not d or set(d) - {"@container", "@protected"} or d.get("@container", "@set") not in ("@set", ["@set"])):
            raise _fail("definition of @type")
        if isinstance(d.get("@id"), str) and d["@id"] not in _KEYWORDS and _LIKE_KEYWORD.match(d["@id"]) or isinstance(d.get("@reverse"), str) and _LIKE_KEYWORD.match(d["@reverse"]):
            ctx.terms.pop(k, None)  # looks like a keyword of a later version: no definition
            done.add(k)
            return
        if "@reverse" in d and ({"@id", "@nest"} & set(d) or d.get("@container") not in (None, "@set", "@index", ["@set"], ["@index"])):
            raise _fail(f"reverse property {k!r}")
        if "@nest" in d and (not isinstance(d["@nest"], str) or (d["@nest"] in _KEYWORDS and d["@nest"] != "@nest")):
            raise _fail(f"@nest of {k!r}")
        t = TermDef(None, protected=bool(d.get("@protected", protect)))

        def known(x: str) -> str | None:
            head = x.split(":", 1)[0]
            for y in (x, head):
                if y in c and y not in done and y != k:
                    self.define(y, c, ctx, done, active, protect, override)
            return self.expand_iri(x, ctx, vocab=True)

        if "@reverse" in d:
            t.reverse, t.iri = True, known(d["@reverse"])
        elif "@id" in d and d["@id"] != k:
            t.iri = known(d["@id"])
            t.prefix = bool(d.get("@prefix", isinstance(v, str) and (t.iri or "")[-1:] in ":/?#[]@" or (t.iri or "").startswith("_:")))
        elif ":" in k[1:]:
            t.iri, (head, rest) = known(k), k.split(":", 1)
            if (whole := ctx.terms.get(head)) is not None and whole.iri and not rest.startswith("//"):
                t.iri = whole.iri + rest  # here any term serves as a prefix
        elif "/" in k:
            t.iri = self.expand_iri(k, ctx, vocab=True, relative=True)
        elif k == "@type":
            t.iri = "@type"
        elif ctx.vocab is not None:
            t.iri = ctx.vocab + k
        else:
            raise _fail(f"{k!r} has no IRI")
        if "@type" in d:
            t.type = d["@type"] if d["@type"] in ("@id", "@vocab", "@json", "@none") else known(d["@type"])
            if t.type is None or not (t.type in ("@id", "@vocab", "@json", "@none") or _ABSOLUTE.match(t.type)):
                raise _fail(f"type of {k!r}")
        if t.iri == "@context":
            raise _fail("@context has no other name")
        if "@container" in d:
            boxes = d["@container"] if isinstance(d["@container"], list) else [d["@container"]]
            if any(x not in ("@list", "@set", "@index", "@language", "@graph", "@id", "@type", None) for x in boxes) or ("@list" in boxes and len(boxes) > 1):
                raise _fail(f"container of {k!r}")
            t.container = tuple(d["@container"]) if isinstance(d["@container"], list) else (d["@container"],) if d["@container"] else ()
        if "@language" in d:
            t.language = d["@language"].lower() if d["@language"] else None
        if "@direction" in d:
            t.direction = d["@direction"]
        t.context, t.nest, t.index = d.get("@context"), d.get("@nest"), d.get("@index", "@index")
        if old is not None and old.protected and not override and replace(old, protected=False) != replace(t, protected=False):
            raise _fail(f"{k!r} is protected")
        ctx.terms[k] = t
        done.add(k)
        active.discard(k)

    def keyword(self, k: str, ctx: Context) -> str | None:
        if k.startswith("@"):
            return k if k in _KEYWORDS else None
        t = ctx.terms.get(k)
        return t.iri if t is not None and t.iri in _KEYWORDS else None

    def expand_iri(self, x: str, ctx: Context, vocab: bool = False, relative: bool = False) -> str | None:
        if x in _KEYWORDS:
            return x
        if x.startswith("@") and x[1:].isalpha():
            return None
        if vocab and x in ctx.terms:
            t = ctx.terms[x]
            return None if t is None else t.iri
        if ":" in x[1:]:
            head, rest = x.split(":", 1)
            if head == "_" or rest.startswith("//"):
                return x
            t = ctx.terms.get(head)
            if t is not None and t.iri and t.prefix:
                return t.iri + rest
            if _ABSOLUTE.match(x):
                return x
        if vocab and ctx.vocab is not None:
            return ctx.vocab + x
        return resolve(x, ctx.base) if relative else x

    # nodes

    def fresh(self) -> Term:
        self.n += 1
        return Term(BNODE, f"{self.scope}{self.anon}{self.n}")

    def ref(self, x: str | None) -> Term | None:
        if x is None:
            return None
        if x.startswith("_:"):
            return Term(BNODE, f"{self.scope}{x[2:]}")
        return Term(IRI, x) if ":" in x and not x.startswith("@") and not _NO_IRI.search(x) else None

    def add(self, g: Term | None, s: Term | None, p: Term | None, o: Term | None) -> None:
        if s is not None and p is not None and o is not None and p.k == IRI:
            self.out.append((g, s, p, o))

    def element(self, node: Any, ctx: Context, g: Term | None, id_: str | None = None, extra_types: tuple[str, ...] = ()) -> Term | None:
        """Adds a node's statements to graph g and returns the node."""
        if not isinstance(node, dict):
            return None
        if ctx.previous is not None and not any(self.keyword(k, ctx) == "@value" for k in node) and not (len(node) == 1 and self.keyword(next(iter(node)), ctx) == "@id"):
            ctx = ctx.previous
        if "@context" in node:
            ctx = self.context(node["@context"], ctx)
        types, typed = [], ctx
        for k in sorted(node):
            if self.keyword(k, ctx) == "@type":
                types += node[k] if isinstance(node[k], list) else [node[k]]
        types += extra_types
        for t in sorted(x for x in types if isinstance(x, str)):
            d = ctx.terms.get(t)
            if d is not None and d.context is not None:
                typed = self.context(d.context, typed, propagate=isinstance(d.context, dict) and d.context.get("@propagate") is True)
        outer, ctx = ctx, typed
        keys = {self.keyword(k, ctx): k for k in node if self.keyword(k, ctx)}
        if "@set" in keys:  # its nodes stand by themselves
            for x in node[keys["@set"]] if isinstance(node[keys["@set"]], list) else [node[keys["@set"]]]:
                self.element(x, ctx, g)
        if "@value" in keys or "@list" in keys or "@set" in keys:
            return None
        mapped = [kw for k in node if (kw := self.keyword(k, ctx)) and kw not in ("@type", "@included", "@nest")]
        if len(set(mapped)) < len(mapped):
            raise _fail("two keys for one keyword")
        name = id_
        if "@id" in keys:
            v = node[keys["@id"]]
            if not isinstance(v, str):
                raise _fail("@id is no text")
            name = self.expand_iri(v, ctx, relative=True)
        s = self.ref(name) if name is not None else self.fresh()
        if s is None:
            return None
        for t in types:
            self.add(g, s, _TYPE, self.ref(self.expand_iri(t, outer, vocab=True, relative=True)))
        self.members(s, node, ctx, g)
        return s

    def members(self, s: Term, node: dict, ctx: Context, g: Term | None) -> None:
        for k in sorted(node):
            v = node[k]
            kw = self.keyword(k, ctx)
            if kw == "@graph":
                for x in v if isinstance(v, list) else [v]:
                    self.element(x, ctx, s)
            elif kw == "@included":
                for x in v if isinstance(v, list) else [v]:
                    if not isinstance(x, dict) or self._has(x, ctx, "@value") or self._has(x, ctx, "@list"):
                        raise _fail("@included is no node")
                    self.element(x, ctx, g)
            elif kw == "@reverse":
                if not isinstance(v, dict):
                    raise _fail("@reverse is no object")
                for rk, rv in v.items():
                    if self.keyword(rk, ctx):
                        raise _fail("a keyword as a reverse property")
                    d = ctx.terms.get(rk)
                    p = self.ref(self.expand_iri(rk, ctx, vocab=True))
                    back = d is not None and d.reverse
                    for x in rv if isinstance(rv, list) else [rv]:
                        for o in self.values(x, rk, ctx, g):
                            self.add(g, *((s, p, o) if back else (o, p, s)))
            elif kw == "@nest":
                for x in v if isinstance(v, list) else [v]:
                    if not isinstance(x, dict) or self._has(x, ctx, "@value"):
                        raise _fail("@nest is no node")
                    d = ctx.terms.get(k)
                    self.members(s, x, self.context(d.context, ctx, override=True) if d is not None and d.context is not None else ctx, g)
            elif kw is None and k not in ("@context",):
                d = ctx.terms.get(k)
                iri = self.expand_iri(k, ctx, vocab=True)
                if iri is None or ":" not in iri or (k in ctx.terms and d is None):
                    continue
                p = self.ref(iri)
                inner = ctx
                if d is not None and d.context is not None:  # it comes on top of what a node falls back to, not of what it leaves
                    nodes = any(isinstance(x, dict) and not self._has(x, ctx, "@value") for x in (v if isinstance(v, list) else [v]))
                    inner = self.context(d.context, ctx.previous if nodes and ctx.previous is not None else ctx, override=True)
                if v is None:
                    continue
                for o in self.property_values(v, k, d, inner, g):
                    if d is not None and d.reverse:
                        if o.k != LITERAL:
                            self.add(g, o, p, s)
                    else:
                        self.add(g, s, p, o)

    def property_values(self, v: Any, k: str, d: TermDef | None, ctx: Context, g: Term | None) -> list[Term]:
        box = d.container if d is not None else ()
        many = v if isinstance(v, list) else [v]
        if d is not None and d.type == "@json":
            return [self.json_literal(v)]
        if "@list" in box and not (isinstance(v, dict) and self._has(v, ctx, "@list")):
            return [self.list_(many, k, ctx, g)]
        if "@language" in box and isinstance(v, dict):
            out = []
            for tag, xs in sorted(v.items()):
                for x in xs if isinstance(xs, list) else [xs]:
                    if x is not None and not isinstance(x, str):
                        raise _fail("a language map holds texts")
                    if x is not None:
                        none = self.expand_iri(tag, ctx, vocab=True) == "@none"
                        out.append(self.text(x, None if none else tag, self.direction(d, ctx)))
            return out
        if "@graph" in box:
            out = []
            if "@id" in box and isinstance(v, dict):
                for name, xs in sorted(v.items()):
                    n = self.expand_iri(name, ctx, relative=True)
                    gn = self.fresh() if self.expand_iri(name, ctx, vocab=True) == "@none" else self.ref(n)
                    for x in xs if isinstance(xs, list) else [xs]:
                        self.members(gn, x, ctx, g) if isinstance(x, dict) and self._has(x, ctx, "@graph") else self.element(x, ctx, gn)
                    out.append(gn)
                return [x for x in out if x is not None]
            xs = [x for ys in (v.values() if "@index" in box and isinstance(v, dict) else [many]) for x in (ys if isinstance(ys, list) else [ys])]
            for x in xs:
                gn = self.fresh()
                if "@index" in box and isinstance(x, dict) and self._has(x, ctx, "@graph"):
                    self.members(gn, x, ctx, g)
                else:
                    self.element(x, ctx, gn)
                out.append(gn)
            return out
        if isinstance(v, dict) and box and {"@index", "@id", "@type"} & set(box):
            out = []
            for key, xs in sorted(v.items()):
                none = self.expand_iri(key, ctx, vocab=True) == "@none"
                for x in xs if isinstance(xs, list) else [xs]:
                    if "@id" in box and isinstance(x, dict):
                        out.append(self.element(x, ctx, g, None if none else self.expand_iri(key, ctx, relative=True)))
                    elif "@type" in box:
                        node = x if isinstance(x, dict) else {"@id": x}
                        out.append(self.element(node, ctx, g, None, () if none else (key,)))
                    else:
                        got = self.values(x, k, ctx, g)
                        if d is not None and d.index != "@index" and not none:
                            for o in got:
                                for y in self.values(key, d.index, ctx, g):
                                    self.add(g, o, self.ref(self.expand_iri(d.index, ctx, vocab=True)), y)
                        out += got
            return [x for x in out if x is not None]
        return [o for x in many for o in self.values(x, k, ctx, g)]

    def _has(self, node: dict, ctx: Context, keyword: str) -> bool:
        return any(self.keyword(k, ctx) == keyword for k in node)

    def direction(self, d: TermDef | None, ctx: Context) -> str | None:
        return d.direction if d is not None and d.direction is not False else ctx.direction

    def values(self, x: Any, k: str, ctx: Context, g: Term | None) -> list[Term]:
        """The terms of one value of property k."""
        d = ctx.terms.get(k)
        if x is None:
            return []
        if isinstance(x, list):
            return [o for y in x for o in self.values(y, k, ctx, g)]
        if isinstance(x, dict):
            inner = self.context(x["@context"], ctx) if "@context" in x else ctx
            keys = {self.keyword(n, inner): n for n in x if self.keyword(n, inner)}
            if len(x) == 1 and set(keys) == {"@language"}:
                return []
            if "@value" in keys:
                t = self.value_object(x, keys, inner)
                return [] if t is None else [t]
            if "@list" in keys:
                items = x[keys["@list"]]
                return [self.list_(items if isinstance(items, list) else [items], k, inner, g)]
            if "@set" in keys:
                items = x[keys["@set"]]
                return [o for y in (items if isinstance(items, list) else [items]) for o in self.values(y, k, inner, g)]
            if "@graph" in keys and not set(keys) - {"@graph", "@index", "@context"} and len(keys) >= len(set(x) - {"@context"}):
                gn = self.fresh()
                for y in x[keys["@graph"]] if isinstance(x[keys["@graph"]], list) else [x[keys["@graph"]]]:
                    self.element(y, inner, gn)
                return [gn]
            o = self.element(x, ctx, g)
            return [] if o is None else [o]
        if d is not None and d.type in ("@id", "@vocab") and isinstance(x, str):
            o = self.ref(self.expand_iri(x, ctx, vocab=d.type == "@vocab", relative=True))
            return [] if o is None else [o]
        if d is not None and d.type and d.type not in ("@none", "@id", "@vocab"):
            return [self.native(x, d.type)]
        if isinstance(x, str):
            lang = d.language if d is not None and d.language is not False else ctx.language
            return [self.text(x, lang, self.direction(d, ctx))]
        return [self.native(x, None)]

    def text(self, v: str, lang: str | None, direction: str | None) -> Term:
        if direction is None or self.directions is None:
            return literal(v, lang=lang)
        if self.directions == "i18n-datatype":
            return Term(LITERAL, v, f"https://www.w3.org/ns/i18n#{(lang or '').lower()}_{direction}")
        if self.directions == "compound-literal":
            b = self.fresh()
            self.add(None, b, Term(IRI, RDF + "value"), literal(v))
            if lang:
                self.add(None, b, Term(IRI, RDF + "language"), literal(lang.lower()))
            self.add(None, b, Term(IRI, RDF + "direction"), literal(direction))
            return b
        return literal(v, lang=lang, dir=direction) if lang else literal(v)

    def native(self, x: Any, dt: str | None) -> Term:
        if isinstance(x, bool):
            return literal(str(x).lower(), dt or XSD + "boolean")
        if isinstance(x, int) and abs(x) < 10**21:
            return literal(double_text(float(x)), dt) if dt == XSD + "double" else literal(str(x), dt or XSD + "integer")
        if isinstance(x, (int, Decimal)):
            whole = x == int(x) and abs(x) < 10**21
            if whole and dt != XSD + "double":
                return literal(str(int(x)), dt or XSD + "integer")
            return literal(double_text(float(x)), dt or XSD + "double")
        return literal(str(x), dt)

    def json_literal(self, v: Any) -> Term:
        return Term(LITERAL, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda d: int(d) if d == int(d) else float(d)), "rdf:JSON")

    def value_object(self, x: dict, keys: dict, ctx: Context) -> Term | None:
        v = x[keys["@value"]]
        kind = x[keys["@type"]] if "@type" in keys else None
        if kind == "@json" or (isinstance(kind, str) and self.expand_iri(kind, ctx, vocab=True) == "@json"):
            return self.json_literal(v)
        if v is None:
            return None
        if isinstance(v, (list, dict)):
            raise _fail("a value that is no scalar")
        if "@language" in keys or "@direction" in keys:
            if not isinstance(v, str) or kind is not None:
                raise _fail("a language on something else than text")
            return self.text(v, x[keys["@language"]] if "@language" in keys else None, x[keys["@direction"]] if "@direction" in keys else None)
        if kind is not None:
            if not isinstance(kind, str):
                raise _fail("the type of a value")
            dt = self.expand_iri(kind, ctx, vocab=True, relative=True)
            return None if dt is None or _NO_IRI.search(dt) else self.native(v, dt)
        return literal(v) if isinstance(v, str) else self.native(v, None)

    def list_(self, items: list, k: str, ctx: Context, g: Term | None) -> Term:
        terms = [o for x in items for o in ([self.list_(x, k, ctx, g)] if isinstance(x, list) else self.values(x, k, ctx, g))]
        cells = [self.fresh() for _ in terms]
        for c, t, rest in zip(cells, terms, [*cells[1:], _NIL], strict=False):
            self.add(g, c, _FIRST, t)
            self.add(g, c, _REST, rest)
        return cells[0] if cells else _NIL


# writing


I18N = "https://www.w3.org/ns/i18n#"


def _object(t: Term, native: bool, direction: str | None = None) -> dict:
    if t.k in (IRI, BNODE):
        return {"@id": t.v if t.k == IRI else f"_:{t.v}"}
    if direction == "i18n-datatype" and (t.dt or "").startswith(I18N):
        lang, _, way = t.dt[len(I18N) :].partition("_")
        return {"@value": t.v} | ({"@language": lang} if lang else {}) | ({"@direction": way} if way else {})
    if t.lang:
        out = {"@value": t.v, "@language": t.lang}
        return out | ({"@direction": t.dir} if t.dir else {})
    if t.dt == "rdf:JSON":
        return {"@value": json.loads(t.v), "@type": "@json"}
    if native and t.dt == "xsd:boolean" and t.v in ("true", "false"):
        return {"@value": t.v == "true"}
    if native and t.dt in ("xsd:integer", "xsd:double"):
        return {"@value": int(t.v) if t.dt == "xsd:integer" else float(t.v)}
    return {"@value": t.v} | ({} if t.dt in (None, "xsd:string") else {"@type": full_dt(t.dt)})


def compact_iris(doc: Any, context: dict[str, str]) -> dict:
    """A document of expanded nodes under a context of terms and prefixes: IRIs in their shortest form there, single values without brackets."""
    terms = {v: k for k, v in context.items() if not k.startswith("@")}
    vocab = context.get("@vocab")

    def short(iri: str, key: bool) -> str:
        if key and iri in terms:
            return terms[iri]
        if key and vocab and iri.startswith(vocab) and len(iri) > len(vocab) and iri[len(vocab) :] not in context and ":" not in iri[len(vocab) :]:
            return iri[len(vocab) :]
        fits = [(len(ns), f"{k}:{iri[len(ns) :]}") for ns, k in terms.items() if ns[-1:] in "/#:" and iri.startswith(ns) and len(iri) > len(ns) and not iri[len(ns) :].startswith("//")]
        return max(fits)[1] if fits else iri

    def walk(x: Any, key: str | None = None) -> Any:
        if isinstance(x, list):
            got = [walk(y, key) for y in x]
            return got[0] if len(got) == 1 and key not in ("@graph", "@list") else got
        if isinstance(x, dict):
            if set(x) == {"@value"} and "@language" not in context:
                return x["@value"]
            return {(k if k.startswith("@") else short(k, True)): walk(v, k) for k, v in x.items()}
        return short(x, key == "@type") if key in ("@id", "@type") and isinstance(x, str) and not x.startswith(("_:", "@")) else x

    return {"@context": context, "@graph": walk(doc, "@graph")}


def to_jsonld(quads: list[tuple[Term | None, Term, str, Term]], native: bool = False, direction: str | None = None) -> list[dict]:
    """Expanded JSON-LD of the statements of one document; lists in one place become @list.

    direction 'i18n-datatype' reads directions from datatypes, 'compound-literal' from blank nodes with a value and a direction; both become values."""
    graphs: dict[Term | None, dict[Term, dict[str, list[Term]]]] = {None: {}}
    uses: dict[Term, int] = {}
    for g, s, p, o in quads:
        graphs.setdefault(g, {}).setdefault(s, {}).setdefault(p, []).append(o)
        uses[o] = uses.get(o, 0) + 1

    def render(nodes: dict[Term, dict[str, list[Term]]]) -> list[dict]:
        def list_of(t: Term) -> list[Term] | None:
            items, seen = [], set()
            while t != _NIL:
                props = nodes.get(t)
                if t.k != BNODE or uses.get(t) != 1 or t in seen or props is None or set(props) != {_FIRST.v, _REST.v} or len(props[_FIRST.v]) != 1 or len(props[_REST.v]) != 1:
                    return None
                seen.add(t)
                items.append(props[_FIRST.v][0])
                used.add(t)
                t = props[_REST.v][0]
            return items

        def compound(t: Term) -> dict | None:
            props = nodes.get(t, {})
            if direction != "compound-literal" or t.k != BNODE or uses.get(t) != 1 or not {RDF + "value", RDF + "direction"} <= set(props) <= {RDF + "value", RDF + "direction", RDF + "language"}:
                return None
            if any(len(x) != 1 for x in props.values()):
                return None
            used.add(t)
            names = (("value", "@value"), ("language", "@language"), ("direction", "@direction"))
            return {k: props[RDF + n][0].v for n, k in names if RDF + n in props}

        used: set[Term] = set()
        out = {}
        for s, props in nodes.items():
            node: dict[str, Any] = {"@id": s.v if s.k == IRI else f"_:{s.v}"}
            for p, os in sorted(props.items()):
                if p == _TYPE.v and all(o.k != LITERAL for o in os):
                    node["@type"] = sorted(o.v if o.k == IRI else f"_:{o.v}" for o in os)
                    continue
                values = []
                for o in os:
                    before = set(used)
                    items = list_of(o) if (o.k == BNODE or o == _NIL) and p != _REST.v else None
                    if items is None:
                        used = before
                    values.append(compound(o) or _object(o, native, direction) if items is None else {"@list": [compound(x) or _object(x, native, direction) for x in items]})
                node[p] = values
            out[s] = node
        return [n for s, n in sorted(out.items(), key=lambda x: (x[0].k, x[0].v)) if s not in used]

    result = render(graphs[None])
    for g, nodes in sorted(((g, n) for g, n in graphs.items() if g is not None), key=lambda x: x[0].v):
        name = g.v if g.k == IRI else f"_:{g.v}"
        target = next((n for n in result if n["@id"] == name), None)
        if target is None:
            target = {"@id": name}
            result.append(target)
        target["@graph"] = render(nodes)
    return result


def part_documents(rows: Iterable[tuple], native: bool = False, direction: str | None = None, context: dict[str, str] | None = None) -> Iterator[str]:
    """Documents of bounded size from rows (kind and text of graph and subject, predicate, fields of the object) in order of graphs and subjects; one without
    nodes if there are no rows. No nodes become lists or values here: other documents may refer to them."""

    def text(doc: list) -> str:
        return json.dumps(compact_iris(doc, context) if context else doc, ensure_ascii=False, separators=(",", ":"))

    doc, nodes, node, n, size, last_g, last_s = [], [], {}, 0, 0, None, None
    for gk, gv, sk, sv, p, ok, ov, dt, lang, way in rows:
        if n >= DOCUMENT_ROWS or size >= DOCUMENT_CHARS:
            yield text(doc)
            doc, n, size = [], 0, 0
        g, s = (gk, gv), (sk, sv)
        if not n or g != last_g:
            nodes = doc
            if gv is not None:
                doc.append({"@id": gv if gk == IRI else f"_:{gv}", "@graph": (nodes := [])})
        if not n or g != last_g or s != last_s:
            nodes.append(node := {"@id": sv if sk == IRI else f"_:{sv}"})
        if p == _TYPE.v and ok in (IRI, BNODE):
            node.setdefault("@type", []).append(ov if ok == IRI else f"_:{ov}")
        else:
            node.setdefault(p, []).append(_object(Term(ok, ov, dt, lang, way), native, direction))
        last_g, last_s, n, size = g, s, n + 1, size + len(sv) + len(p) + len(ov) + 40
    yield text(doc)


__all__ = ["JsonLdParser", "short_dt", "to_jsonld"]
