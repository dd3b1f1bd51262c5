"""Term counts, packing and mixing."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quadloom.llm import mixing, packing, terms, tokens


def test_terms_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["hot"] * 5 + [f"t{i}" for i in range(30)] + [None]), rng.choice(["", "en"]), rng.choice([f"s{i}" for i in range(60)] + [None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "p string, v string, l string, scope string")
    got = {(r["scope"], r["v"], r["l"]): r for r in terms.term_frequencies(df, F.col("p"), {"v": F.col("v"), "l": F.col("l")}, F.col("scope")).collect()}
    occurrences, records, scopes = defaultdict(int), defaultdict(set), defaultdict(set)
    for p, v, lang, s in rows:
        if p is not None and s is not None:
            occurrences[p, v, lang] += 1
            records[p, v, lang].add(s)
            scopes[p].add(s)
    assert set(got) == set(occurrences)
    for k, n in occurrences.items():
        share = len(records[k]) / len(scopes[k[0]])
        mark = "rare" if len(records[k]) < 3 else "common" if share > 0.2 else None
        assert (got[k]["n_occurrences"], got[k]["n_records"], got[k]["mark"]) == (n, len(records[k]), mark)
    assert terms.term_frequencies(df.limit(0), F.col("p"), {"v": F.col("v")}, F.col("scope")).count() == 0


def bins_of(sizes, place, capacity):
    load = defaultdict(int)
    for s, b in zip(sizes, place, strict=True):
        load[b] += s
    assert all(x <= capacity for x in load.values())
    return len(load)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_two_fit_is_valid(sizes):
    place = packing.best_two_fit(np.array(sorted(sizes, reverse=True), dtype=np.int64), 50)
    assert len(place) == len(sizes)
    used = bins_of(sorted(sizes, reverse=True), place, 50)
    assert used <= max(1, 2 * -(-sum(sizes) // 50)) or not sizes


def test_best_two_fit_wastes_little():
    rng = random.Random(4)
    sizes = np.array(sorted((rng.randrange(20, 400) for _ in range(5000)), reverse=True))
    used = bins_of(sizes.tolist(), packing.best_two_fit(sizes, 512), 512)
    assert used <= 1.01 * -(-int(sizes.sum()) // 512)


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, None, rng.randrange(1, 300), 512, rng.randrange(513, 3000)])) for i in range(800)]
    df = spark.createDataFrame(rows, "id bigint, container bigint")
    specs = spark.createDataFrame([(1, 512), (2, 2048)], "spec int, cap int")
    out = packing.pack(df, specs, "id", "container", "spec", "cap", shard_rows=200).collect()
    for spec, cap in ((1, 512), (2, 2048)):
        mine = [r for r in out if r["spec"] == spec]
        load, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            load[r["container"]] += r["tokens"]
            pieces[r["id"]].append((r["piece"], r["first_token"], r["tokens"]))
        assert all(x <= cap for x in load.values()) and all(load[r["container"]] == r["container_tokens"] for r in mine)
        for i, size in rows:
            ps, size = sorted(pieces[i]), size or 0
            assert sum(p[2] for p in ps) == size and (len(ps) == 1) == (size <= cap)
            assert [p[1] for p in ps] == [cap * k for k in range(len(ps))]
        assert len(load) <= 1.1 * -(-sum(s or 0 for _, s in rows) // cap) + 4
    assert packing.pack(df.limit(0), specs, "id", "container", "spec", "cap").count() == 0
    assert packing.pack(df, specs.limit(0), "id", "container", "spec", "cap").count() == 0


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None, "untargeted"]), rng.choice([None, 0, rng.randrange(1, 100)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 4)], "src string, w double, r int")
    mixed = mixing.mix(df.withColumnRenamed("source", "src"), targets, "id", "src", "tokens", "w", "r")
    got = mixed.collect()
    all_tokens = defaultdict(int)
    for _, s, t in rows:
        all_tokens[s] += t or 0
    most = min(all_tokens["a"] / 0.5, all_tokens["b"] * 3 / 0.3, all_tokens["c"] * 2 / 0.1) * 0.9
    total = sum(r["tokens"] for r in got)
    assert most - 400 <= total <= most + 1
    per, copies = defaultdict(int), defaultdict(int)
    for r in got:
        per[r["source"]] += r["tokens"]
        copies[r["id"], r["source"]] += 1
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(per[s] / total - w / 0.9) < 0.01
        assert max(n for (_, x), n in copies.items() if x == s) <= {"a": 1, "b": 3, "c": 2}[s]
    ordered = sorted(got, key=lambda r: (r["finish"], r["source"], r["id"], r["repeat"]))
    running = 0
    for r in ordered:
        running += r["tokens"]
        assert r["running_tokens"] == running
    report = {r["source"]: r for r in mixing.shares(mixed, targets, "src", "w").collect()}
    assert report["none"]["tokens"] == 0 and abs(sum(r["share"] for r in report.values()) - 1) < 1e-9
    assert mixing.mix(df.limit(0).withColumnRenamed("source", "src"), targets, "id", "src", "tokens", "w", "r").count() == 0
    some = mixing.mix(df.withColumnRenamed("source", "src"), targets, "id", "src", "tokens", "w", "r", budget=3000).agg(F.sum("tokens")).first()[0]
    assert 2800 <= some <= 3000


def test_mix_by_shuffle_and_small_blocks(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else "b", 1 + i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, src string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 2_000_000_000)], "src string, w double, r int")
    run = lambda: sorted(tuple(r) for r in mixing.mix(df, targets, "id", "src", "tokens", "w", "r").collect())
    want = run()
    for name, value in (("MAX_TARGETS", 0), ("BUCKET_ROWS", 20), ("BLOCK_BUCKETS", 3)):
        monkeypatch.setattr(mixing, name, value)
    assert run() == want and len(want) > 900


def test_tokens(spark):
    e = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    long = "Madam President, the café isn't 42 open. " * 20_000
    assert tokens.count_tokens(long) == len(e.encode_ordinary(long))
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokens.token_count(F.col("t"))).collect()] == [2, 0, 0]


@pytest.mark.parametrize("capacity", [1, 7])
def test_single_sizes(capacity):
    assert packing.best_two_fit(np.full(3, capacity), capacity) == [0, 1, 2] and packing.best_two_fit(np.zeros(0, np.int64), capacity) == []
