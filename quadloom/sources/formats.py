"""Names of graph formats and their file extensions."""

from __future__ import annotations

from quadloom.errors import GraphError

EXTENSIONS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "trig": "trig", "jsonld": "jsonld", "json-ld": "jsonld", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml"}
MIME = {
    "application/n-triples": "ntriples", "application/n-quads": "nquads", "text/turtle": "turtle", "application/trig": "trig",
    "application/ld+json": "jsonld", "application/rdf+xml": "rdfxml",
}
HAS_GRAPHS = {"nquads", "trig", "jsonld"}
LINES = {"ntriples", "nquads"}


def format_name(name: str | None, path: str = "") -> str:
    """The format of a name, a MIME type, or else of a path's extension."""
    if name:
        key = name.lower().lstrip(":")
        found = MIME.get(key) or EXTENSIONS.get(key) or (key if key in EXTENSIONS.values() else None)
        if not found:
            raise GraphError(f"unknown format {name!r}")
        return found
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext in ("gz", "bz2", "zst"):
        ext = path.rsplit(".", 2)[-2].lower()
    if ext not in EXTENSIONS:
        raise GraphError(f"no format for {path!r}")
    return EXTENSIONS[ext]

#: Statements and characters at which a document of several is full: small enough to be parsed by a task whose memory others share.
DOCUMENT_ROWS, DOCUMENT_CHARS = 25_000, 4 << 20
