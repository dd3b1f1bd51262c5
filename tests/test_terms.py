"""Terms and their values."""

from __future__ import annotations

import datetime as d
from decimal import Decimal

import pytest
from hypothesis import given, strategies as st

from quadloom.errors import LiteralError
from quadloom.sources.results import parse_nt_term
from quadloom.terms import Term, double_text, literal


@pytest.mark.parametrize(
    ("term", "want"),
    [
        (literal("x"), "x"), (literal(5), 5), (literal(True), True), (literal("1", "xsd:boolean"), True), (literal("2.50", "xsd:decimal"), Decimal("2.50")), (literal(1.5), 1.5), (literal("-INF", "xsd:double"), float("-inf")),
        (literal(d.date(2020, 2, 29)), d.date(2020, 2, 29)), (literal("2020-01-01T24:00:00", "xsd:dateTime"), d.datetime(2020, 1, 2)), (literal("7", "xsd:unsignedByte"), 7), (literal("a", "other:t"), "a"), (Term(1, "http://x"), "http://x"),
    ],
)
def test_values(term, want):
    assert term.value() == want == term.try_value()


@pytest.mark.parametrize("term", [literal("x", "xsd:integer"), literal("1.0", "xsd:long"), literal("2019-02-29", "xsd:date"), literal("yes", "xsd:boolean"), literal("1\n", "xsd:integer")])
def test_bad_values(term):
    assert term.try_value() is None
    with pytest.raises(LiteralError):
        term.value()


@given(st.floats(allow_nan=False))
def test_double_text(x):
    assert float(double_text(x).replace("INF", "inf")) == x


@given(st.text(), st.sampled_from([None, "en", "de-at"]))
def test_nt_round_trip(text, lang):
    t = literal(text, lang=lang)
    assert parse_nt_term(t.nt()) == t
