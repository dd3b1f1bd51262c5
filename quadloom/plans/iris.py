"""Relative IRI resolution (RFC 3986)."""

from __future__ import annotations

import re

_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.DOTALL)


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif p == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def resolve(ref: str, base: str | None) -> str:
    """ref against base; without a base ref stays as it is."""
    scheme, auth, path, query, frag = _PARTS.match(ref).groups()
    if scheme or not base:
        return ref
    bs, ba, bp, bq, _ = _PARTS.match(base).groups()
    if auth is not None:
        path = _dots(path)
    else:
        auth = ba
        if not path:
            path, query = bp, bq if query is None else query
        elif path.startswith("/"):
            path = _dots(path)
        else:
            path = _dots(("/" if ba is not None and not bp else bp[: bp.rfind("/") + 1]) + path)
    out = f"{bs}:" if bs else ""
    out += f"//{auth}" if auth is not None else ""
    return out + path + (f"?{query}" if query is not None else "") + (f"#{frag}" if frag is not None else "")
