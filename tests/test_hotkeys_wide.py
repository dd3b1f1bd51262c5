"""Per-key reports against brute force, and entity tables."""

from __future__ import annotations

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quadloom.functions.xsd import canonical
from quadloom.operators.hotkeys import distinct_counts, exact_quantiles, hot_key_report
from quadloom.operators.wide import cast_failures, filled_cells, widen


def test_report_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}" if rng.random() < 0.9 else None, rng.randrange(9), rng.choice([None, rng.randrange(-(10**15), 10**15), 7])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "k string, d int, v bigint")
    got = {r["key"]: r for r in hot_key_report(df, F.col("k"), {"d": F.col("d")}, F.col("v"), [0.0, 0.5, 0.99, 1.0], bins=16).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for k, rs in by.items():
        vs = sorted(r[2] for r in rs if r[2] is not None)
        want = [vs[max(1, math.ceil(q * len(vs))) - 1] for q in (0.0, 0.5, 0.99, 1.0)]
        assert (got[k]["n_rows"], got[k]["n_d"], got[k]["n_values"], list(got[k]["q"])) == (len(rs), len({r[1] for r in rs}), len(vs), want)
        assert math.isclose(got[k]["share"], len(rs) / len(rows))


def test_many_open_ranges_are_salted(spark, monkeypatch):
    import quadloom.operators.hotkeys as H

    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1009).alias("v"))
    got = {r["key"]: list(r["q"]) for r in exact_quantiles(df, F.col("k"), F.col("v"), [0.5], bins=8, salts=4).collect()}
    for k in range(3):
        vs = sorted(i * 7919 % 1009 for i in range(1000) if i % 3 == k)
        assert got[k] == [vs[math.ceil(len(vs) / 2) - 1]]


def test_empty_and_null_values(spark):
    df = spark.createDataFrame([], "k string, d int, v bigint")
    assert hot_key_report(df, F.col("k"), {"d": F.col("d")}, F.col("v"), [0.5]).count() == 0
    one = spark.createDataFrame([("a", None, None)], "k string, d int, v bigint")
    r = hot_key_report(one, F.col("k"), {"d": F.col("d")}, F.col("v"), [0.5]).first()
    assert (r["n_rows"], r["n_d"], r["n_values"], r["q"]) == (1, 0, 0, None)
    assert distinct_counts(one, F.col("k"), {"d": F.col("d")}).first()["n_d"] == 0


def test_widest_ranges_and_close_values(spark):
    ends = [-(2**63), 0, 2**63 - 1]
    near = [2**62 + i for i in range(3000)]
    rows = [("ends", v) for v in ends] + [("near", v) for v in near] + [("same", 5)] * 7
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {r["key"]: list(r["q"]) for r in exact_quantiles(df, F.col("k"), F.col("v"), [0.0, 0.5, 1.0], bins=16).collect()}
    assert got == {"ends": ends, "near": [near[0], near[1499], near[-1]], "same": [5, 5, 5]}


TYPES = {"x:i": "integer", "x:d": "decimal", "x:b": "boolean", "x:t": "date", "x:s": "string"}


def test_wide_table(spark):
    rows = [
        ("e1", "x:i", "007"), ("e1", "x:i", " +7"), ("e1", "x:i", "1e2"), ("e1", "x:d", "07.50"), ("e1", "x:b", "1"), ("e1", "x:b", "true"), ("e1", "x:t", "2020-02-29"), ("e1", "x:s", " a "),
        ("e2", "x:i", "1"), ("e2", "x:i", "2"), ("e2", "x:s", "a"), ("e2", "x:s", "a "), ("e3", "x:t", "2019-02-29"), ("e4", "x:q", "1"), (None, "x:i", "1"), ("e5", None, "1"), ("e6", "x:i", None), ("e7", "x:i", "9" * 60), ("e1", "x:s", " a "),
    ]
    df = spark.createDataFrame(rows, "e string, a string, v string")
    wide = widen(df, F.col("e"), F.col("a"), F.col("v"), TYPES)
    cells = {(r["subject"], r["predicate"], r["val"]) for r in filled_cells(wide).collect()}
    assert cells == {("e1", "x:i", "7"), ("e1", "x:d", "7.5"), ("e1", "x:b", "true"), ("e1", "x:t", "2020-02-29"), ("e1", "x:s", " a "), ("e7", "x:i", "9" * 60)}
    by = {r["entity"]: r for r in wide.collect()}
    assert set(by) == {"e1", "e2", "e3", "e7"} and by["e1"]["i"] == 7 and str(by["e1"]["t"]) == "2020-02-29" and by["e1"]["b"] is True and by["e7"]["i"] is None
    assert by["e1"]["failures"]["x:i"]["failed"] == "1e2" and by["e3"]["failures"]["x:t"]["n_failed"] == 1
    assert widen(df.limit(0), F.col("e"), F.col("a"), F.col("v"), TYPES).count() == 0


def test_all_cast_failures_are_kept(spark):
    rows = [("e", "x:i", v) for v in ("x1", "x2", "x3", "x3", "4", "5")] + [("e", "x:s", "x"), (None, "x:i", "x"), ("f", "x:i", None)]
    df = spark.createDataFrame(rows, "e string, a string, v string")
    args = df, F.col("e"), F.col("a"), F.col("v"), TYPES
    assert sorted(tuple(r) for r in cast_failures(*args).collect()) == [("e", "x:i", "x1", 1), ("e", "x:i", "x2", 1), ("e", "x:i", "x3", 2)]
    assert widen(*args).first()["failures"]["x:i"].asDict() == {"n_failed": 4, "failed": "x1"}


def test_attributes_of_one_local_name(spark):
    types = {"x:n": "string", "y:N": "integer", "x:cells": "string", "x:it's": "string"}
    df = spark.createDataFrame([("e", a, "1") for a in types], "e string, a string, v string")
    wide = widen(df, F.col("e"), F.col("a"), F.col("v"), types)
    assert wide.columns == ["entity", "x:n", "y:N", "x:cells", "it's", "cells", "failures"] and list(wide.first())[:5] == ["e", "1", 1, "1", "1"]


def test_canonical_texts(spark):
    cases = [("decimal", "-0.0", "0"), ("decimal", "+12.", "12"), ("decimal", ".50", "0.5"), ("decimal", "1e1", None), ("integer", "-0", "0"), ("integer", "--1", None), ("boolean", "0", "false"), ("boolean", "TRUE", None), ("date", "0004-02-29Z", "0004-02-29"), ("date", "1900-02-29", None), ("date", "2020-01-01\n", "2020-01-01"), ("integer", "", None)]
    for kind, text, want in cases:
        got = spark.createDataFrame([(text,)], "v string").select(canonical(F.col("v"), kind)).first()[0]
        assert got == want, (kind, text)
