"""Lines taken apart: reasons, loading, and odd input."""

from __future__ import annotations

import pytest

from quadloom.operators.quarantine import load_lines, reject_lines

S, P = "<http://e/s>", "<http://e/p>"
GOOD = [
    f'{S} {P} "a" .', f'{S}{P}"a"@en-GB.', f"\t{S}  {P}\t<http://e/o>  . # a comment with \"quotes\" .", f"_:b1 {P} _:b2 .\r", f'{S} {P} "a\\"b\\\\" .', f'{S} {P} "\\u00e9\\U0001F600"@fr--rtl .',
    f'{S} {P} "5"^^<xsd:integer> .', f'{S} {P} "-.5"^^<http://www.w3.org/2001/XMLSchema#decimal> .', f'{S} {P} "2020-02-29"^^<xsd:date> .', f'{S} {P} "x"^^<other:type> .', f"{S} {P} <<( {S} {P} \"x\"@en )>> .",
    f'{S} {P} "-2000-02-29T24:00:00+14:00"^^<xsd:dateTime> .', f'{S} {P} "1E400"^^<xsd:double> .', f"<http://e/?a=1&b=\\u00E9> {P} <urn:x:y> .",
]
BAD = {
    "iri": [f"<> {P} _:b .", f"<rel> {P} _:b .", f"<http://e/a b> {P} _:b .", f"{S} <http://e/{{x}}> _:b .", f'{S} {P} "5"^^<> .', f'{S} {P} "5"^^<#int> .', f"{S} {P} <http://e/\\u0020> .", f"{S} {P} <<( <rel> {P} {S} )>> ."],
    "quoting": [f"{S} {P} 'a' .", f'{S} {P} "a .', f'{S} {P} a" .', f'{S} {P} "a"b" .', f'{S} {P} "a\\xb" .', f'{S} {P} "a\\" .', f"{S} {P} “a”@en .", f'{S} {P} "\\u00G1" .'],
    "lang": [f'{S} {P} "a"@ .', f'{S} {P} "a"@12 .', f'{S} {P} "a"@en_GB .', f'{S} {P} "a"@en- .', f'{S} {P} "a"@en--up .', f'{S} {P} "a"@abcdefghi .', f'{S} {P} "a"@en--LTR .'],
    "value": [f'{S} {P} "1.0"^^<xsd:integer> .', f'{S} {P} " 1"^^<xsd:integer> .', f'{S} {P} "2019-02-29"^^<xsd:date> .', f'{S} {P} "yes"^^<xsd:boolean> .', f'{S} {P} "nan"^^<xsd:double> .', f'{S} {P} "2020-01-01T24:00:01"^^<xsd:dateTime> .', f'{S} {P} "1e3"^^<xsd:decimal> .'],
    "terms": [f"{S} {P} .", f'{S} "a" .', f'{S} {P} "a"', f'{S} {P} "a" . .', f'{S} {P} "a" "b" .', f"{S} _:p {S} .", f'"a" {P} {S} .', f"{S} {P} {S} {S} .", f"{S} {P} {S}, {S} .", "hello", f"{S} {P} ; {S} .", f"<<( {S} {P} {S} )>> {P} {S} ."],
}


def frame(spark, lines):
    return spark.createDataFrame([(i, x, "kept") for i, x in enumerate(lines)], "line_id bigint, line_text string, __s string")


def test_valid_lines(spark):
    df = frame(spark, GOOD)
    assert reject_lines(df).collect() == []
    rows = {r["line_id"]: r for r in load_lines(df).collect()}
    assert len(rows) == len(GOOD)
    assert rows[4]["object"]["v"] == 'a"b\\' and rows[5]["object"]["v"] == "é😀" and rows[5]["object"]["dir"] == "rtl" and rows[1]["object"]["lang"] == "en-gb"
    assert rows[7]["object"]["dt"] == "xsd:decimal" and rows[10]["object"]["k"] == 3 and rows[13]["subject"]["v"] == "http://e/?a=1&b=é" and rows[3]["__s"] == "kept"


@pytest.mark.parametrize("reason", list(BAD))
def test_reasons(spark, reason):
    got = {r["line_text"]: r["reason"] for r in reject_lines(frame(spark, BAD[reason])).collect()}
    assert got == dict.fromkeys(BAD[reason], reason)


def test_mixed_file(spark):
    lines = [*GOOD, *[x for xs in BAD.values() for x in xs], None, "", "  ", "# c", "\r"] * 2
    df = frame(spark, lines)
    n_bad = 2 * sum(map(len, BAD.values()))
    assert reject_lines(df).count() == n_bad and load_lines(df).count() == 2 * len(GOOD)


def test_empty_and_long(spark):
    empty = frame(spark, GOOD).limit(0)
    assert reject_lines(empty).count() == 0 and load_lines(empty).count() == 0
    long = "é\\\"x " * 100_000
    df = frame(spark, [f'{S} {P} "{long}" .', f'{S} {P} "{long}"b" .', f"<http://e/{'x' * 300_000}> {P} {S} ."])
    assert [(r["line_id"], r["reason"]) for r in reject_lines(df).collect()] == [(1, "quoting")]
    assert len(load_lines(df).where("line_id = 0").first()["object"]["v"]) == 4 * 100_000


def test_columns_named_like_results(spark):
    df = spark.createDataFrame([(1, f"{S} {P} .", 5, 6)], "line_id bigint, line_text string, reason int, subject int")
    assert reject_lines(df).collect()[0].asDict() == {"line_id": 1, "line_text": f"{S} {P} .", "subject": 6, "reason": "terms"}


def nest(term: str, depth: int) -> str:
    return "".join(f"<<( {S} {P} " for _ in range(depth)) + term + " )>>" * depth


def test_triple_terms_of_any_depth(spark, tmp_path):
    from quadloom.sources.ntriples import read_lines

    good = [f"{S} {P} {nest(x, depth)} ." for depth in (1, 2, 3, 9) for x in (S, "_:b", '"<<( in a text"@en')]
    bad = {"iri": "<rel>", "lang": '"a"@-', "terms": "<<( <http://e/s> )>>", "value": '"x"^^<xsd:integer>'}
    lines = good + [f"{S} {P} {nest(x, 5)} ." for x in bad.values()]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, line_text string")
    assert [r["line_id"] for r in load_lines(df).orderBy("line_id").collect()] == list(range(len(good)))
    assert [r["reason"] for r in reject_lines(df).orderBy("line_id").collect()] == list(bad)
    (tmp_path / "x.nt").write_text("\n".join(good))
    assert read_lines(spark, str(tmp_path / "x.nt"), faults="raise").where("o.k = 3").count() == len(good)
    (tmp_path / "x.nq").write_text("\n".join(lines))
    assert read_lines(spark, str(tmp_path / "x.nq"), quads=True, faults="drop").count() == len(good) + 1  # readers take ill-typed literals


def test_texts_that_look_like_the_end_of_a_line(spark):
    want = {
        f'{S} {P} "No. # 3"': "terms", f'{S} {P} "No. # 3"@en': "terms", f'{S} {P} "No. # 3 .': "quoting", f'{S} {P} "a "b" c. # 3"@en .': "quoting", f'{S} {P} "No. # 3" .': None,
        f'{S} {P} "said \\"yes\\" . Now .': "quoting", f'{S} {P} said \\"yes\\" . Now"@en .': "quoting", f'{S} {P} "said \\"yes\\" . Now"': "terms", f'{S} {P} "a\x00b" .': None, f"{S} {P} \x00 .": "terms",
    }
    got = {r["line_text"]: r["reason"] for r in reject_lines(frame(spark, list(want))).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert load_lines(frame(spark, list(want))).count() == 2


def test_large_dictionaries_are_joined_by_shuffle(spark, monkeypatch):
    from quadloom.operators import quarantine

    lines = [*GOOD, *[x for xs in BAD.values() for x in xs]] * 2
    want = sorted((r["line_id"], r["reason"]) for r in reject_lines(frame(spark, lines)).collect())
    monkeypatch.setattr(quarantine, "BROADCAST_CHARS", 0)
    assert sorted((r["line_id"], r["reason"]) for r in reject_lines(frame(spark, lines)).collect()) == want
