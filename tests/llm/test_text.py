"""Look-alike forms, languages and encodings."""

from __future__ import annotations

import itertools
import math
import random
import unicodedata as ud

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quadloom.llm import encoding, language, lookalike


def test_fold():
    same = {
        "Procès-verbal": ["Ｐｒｏｃèｓ－ｖｅｒｂａｌ", "Procès‑verbal", "Pro​cès­-verbal﻿", "Ρrocès-verbal", "Prоcès‐verbal"],
        "affilié 12": ["afﬁlié 12", "affilié １２", "affilié　12"],
        "Chapter IV...": ["Chapter Ⅳ…"],
        "Åland": ["Åland", "Åland"],
    }
    for want, forms in same.items():
        for f in forms:
            assert lookalike.canonical_text(f) == want
    for kept in ("225³", "ÇA", "ça", "Straße", "½", "①", "a – b", "Щфлцф", "ſ"):
        assert lookalike.canonical_text(kept) == kept


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_fold_is_stable_and_matches_whole_text(text):
    once = lookalike.canonical_text(text)
    assert lookalike.canonical_text(once) == once
    whole = ud.normalize("NFC", "".join(map(lookalike._fold, text)))
    assert ud.normalize("NFC", once) == whole


def test_lookalike_pairs(spark):
    rows = [(1, "ab"), (2, "аb"), (3, "ab"), (4, "AB"), (5, None), (6, ""), (7, "​"), (8, "á" + "x" * 200_000), (9, "á" + "x" * 200_000)]
    df = spark.createDataFrame(rows, "t bigint, form string")
    assert {tuple(r) for r in lookalike.lookalike_pairs(df, "t", "form").collect()} == {(1, 2), (2, 3), (6, 7), (8, 9)}
    assert lookalike.lookalike_pairs(df.limit(0), "t", "form").count() == 0
    out = df.select(lookalike.canonical_form(F.col("form"))).collect()
    assert out[4][0] is None and out[5][0] == ""


WORDS = {"en": "the house and of with we have not this that they should", "de": "das haus und von mit wir haben nicht dieses dass sie sollten", "fr": "la maison et de avec nous avons pas cette que ils devraient", "es": "la casa y del con nosotros tenemos no esta que ellos deben", "it": "la casa e della con noi abbiamo non questa che loro devono"}


def sentence(rng, lang, n=12):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


def test_languages_held_out(spark):
    rng, rows = random.Random(1), []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        tag = rng.choice(list(WORDS)) if rng.random() < 0.1 else lang  # some labels are wrong
        rows.append((i, " ".join(sentence(rng, lang) for _ in range(3)), tag))
    df = spark.createDataFrame(rows, "id bigint, text string, tag string")
    model = language.fit_languages(df, "text", "tag")
    test = []
    for i in range(200):
        a, b = rng.sample(list(WORDS), 2)
        test.append((i, f"{sentence(rng, a)} Zanholt. {sentence(rng, b)}", a, b))
    t = spark.createDataFrame(test, "id bigint, text string, a string, b string")
    said = t.withColumn("said", language.label_texts(F.col("text"), model))
    rows = said.select("a", "b", language.whole_sentence_languages(F.col("said")).alias("found"), "said.segments").collect()
    assert sum(set(r["found"]) == {r["a"], r["b"]} for r in rows) >= 0.97 * len(rows)
    assert all(0 <= s["confidence"] <= 1 for r in rows for s in r["segments"])


def test_classes_hold_all_links(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "a b", "a\u00a0b", "a\u200bb", "ab", "AB", "cafe\u0301", "café"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, t string")
    pairs = [tuple(r) for r in lookalike.lookalike_pairs(df, "id", "t").collect()]
    links = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i, _ in rows}
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in lookalike.lookalike_classes(df, "id", "t").collect()}
    form = {i: lookalike.canonical_text(t) for i, t in rows if t is not None}
    assert got == {i: (min(j for j in form if form[j] == form[i]), len(links[i])) for i in links if links[i]}
    assert lookalike.lookalike_classes(df.limit(0), "id", "t").count() == 0


def test_no_unstable_character_is_missed():
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            ch = chr(c)
            once = lookalike.canonical_text(ch)
            assert lookalike.canonical_text(once) == once
            if ud.decomposition(ch)[:1] not in ("", "<"):  # canonical decompositions are always folded
                assert once == lookalike.canonical_text(ud.normalize("NFD", ch))
    assert lookalike.canonical_text("\U0002f81a") == "冬" and lookalike.canonical_text("ᎠᎬᏟ ꓡꓲꓢꓴ") == "DEC LISU"
    assert len(set(lookalike.LOOKALIKES)) == len(lookalike.LOOKALIKES) and all(x.isascii() for x in lookalike.LOOKALIKES.values())


def brute_path(scores, same):
    """The best path of one text, by all paths."""
    best = None
    for path in itertools.product(range(len(scores[0])), repeat=len(scores)):
        total = sum(row[i] for row, i in zip(scores, path, strict=True))
        total -= sum(language.SWITCH if same[k] else language.SWITCH_AT_END for k in range(1, len(path)) if path[k] != path[k - 1])
        best = max(best or (total, path), (total, path))
    return best


def test_paths_are_best_paths():
    rng = random.Random(9)
    texts = [[[rng.uniform(-9, 9) for _ in range(3)] for _ in range(rng.randrange(0, 7))] for _ in range(120)]
    gain, same = [row for t in texts for row in t], [k % 3 > 0 for t in texts for k in range(len(t))]
    counts = np.array([len(t) for t in texts])
    labels, k, switched = language.best_paths(np.array(gain), np.array(same), counts), 0, 0
    for n in counts:
        if n:
            scores, inside, got = gain[k : k + n], same[k : k + n], labels[k : k + n].tolist()
            total = sum(row[i] for row, i in zip(scores, got, strict=True)) - sum(language.SWITCH if inside[j] else language.SWITCH_AT_END for j in range(1, n) if got[j] != got[j - 1])
            assert math.isclose(total, brute_path(scores, inside)[0], abs_tol=1e-9)
            switched += len(set(got)) > 1
        k += n
    assert switched > 20
    assert language.best_paths(np.zeros((0, 3)), np.zeros(0, bool), np.zeros(4, int)).tolist() == []


def test_two_leads_together_can_pay_for_one_switch():
    scores = np.array([(1.2, -3.0, 0.0, -3.0, -3.0)] * 2 + [(-3.0, 1.2, 0.0, -3.0, -3.0)] * 2)
    assert language.best_paths(scores, np.array([False, True, False, True]), np.array([4])).tolist() == [0, 0, 1, 1]


def test_segments_of_a_batch():
    scores = {"ja": (2.0, -2.0), "yes": (-2.0, 2.0)}
    model = language.Model(("de", "en"), scores, {}, {"Latin": (True, True), "Greek": (False, True)})
    texts = ["Ja ja. Yes, yes yes!", "", "12 !!", "ja λόγος Ж ja", "Ja. ja"]
    got = language.label_batch(texts, model).to_pylist()
    assert [[(texts[i][s["start"] : s["end"]], s["lang"], s["words"]) for s in r["segments"]] for i, r in enumerate(got)] == [
        [("Ja ja", "de", 2), ("Yes, yes yes", "en", 3)], [], [], [("ja λόγος", "de", 2), ("Ж", "und", 1), ("ja", "de", 1)], [("Ja. ja", "de", 2)],
    ]
    assert [r["lang"] for r in got] == ["en", "und", "und", "de", "de"] and got[1]["confidence"] == 0 and got[0]["confidence"] > 0.99
    assert [(s["lang"], s["words"], s["share"]) for s in got[0]["sentences"]] == [("de", 2, 1.0), ("en", 3, 1.0)] and len(got[4]["sentences"]) == 2
    assert language.label_batch([], model).to_pylist() == [] and language.label_batch(["ja"], language.Model()).to_pylist()[0]["lang"] == "und"


def test_languages_and_scripts_come_from_the_labels(spark):
    rng = random.Random(4)
    words = {"en": "the house has a red door and seven windows".split(), "ru": "дом имеет красную дверь и семь окон на улице".split(), "el": "το σπίτι έχει κόκκινη πόρτα και επτά παράθυρα".split()}
    rows = [(" ".join(rng.choice(words[x]) for _ in range(25)), x) for x in words for _ in range(30)]
    rows += [(rows[0][0], "en")] * 500
    df = spark.createDataFrame(rows, "text string, tag string")
    model = language.fit_languages(df, "text", "tag", tags={x: x for x in words}, train_rows=20)
    assert model.languages == ("el", "en", "ru") and model.scripts["Cyrillic"] == (False, False, True)
    got = language.label_batch(["красная дверь", "red door. το σπίτι. красную дверь", "中文"], model).to_pylist()
    assert [[s["lang"] for s in r["segments"]] for r in got] == [["ru"], ["en", "el", "ru"], ["und"]]


def test_language_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "12 !!", "en"), (4, "Привет мир", "en"), (5, "word " * 60_000, "xx")], "id bigint, text string, tag string")
    model = language.fit_languages(df, "text", "tag")
    out = df.select(language.label_texts(F.col("text"), model).alias("s")).collect()
    assert all(r["s"]["lang"] == "und" and r["s"]["segments"] == [] for r in out)
    assert df.limit(0).select(language.label_texts(F.col("text"), model)).count() == 0
    tags = spark.createDataFrame([("en-GB",), ("EN",), ("deu",), ("und",), ("x-none",), ("",), (None,), ("pt",), ("fra-CH",)], "t string")
    assert [r[0] for r in tags.select(language.tag_language(F.col("t"))).collect()] == ["en", "en", "de", None, None, None, None, None, "fr"]


CLEAN = ["Señor presidente, la atención", "Für die Präsidentin wären", "L’été où le président a été", "«¡Esto no es así!»", "naïve café – façade", "Größe und Fähre", "Ôrihólt £560", "la comisión examinó", "25 °C ± 2 µm", "EDIÇÃO Nº 3", "Г. Лозань: «Да»"]


def test_encodings_round_trip(spark):
    rows, changed = [], {}
    for i in range(40):
        rows += [(len(rows) + k, x) for k, x in enumerate(CLEAN)]
    for chain in (("utf_8", "cp1252", 1), ("utf_8", "latin_1", 1), ("utf_8", "cp1250", 1), ("utf_8", "mac_roman", 1), ("utf_8", "cp850", 1), ("utf_8", "cp1252", 2), ("cp1252", "mac_roman", 1), ("cp1252", "cp1251", 1)):
        for text in CLEAN[:8]:
            bad = encoding.garble(text, *chain)
            if bad is not None and bad != text:
                changed[len(rows)] = text
                rows.append((len(rows), bad))
    lost = len(rows)
    rows += [(lost, "Se�or presidente"), (lost + 1, "caf\x92"), (lost + 2, None), (lost + 3, ""), (lost + 4, "plain"), (lost + 5, "é" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r[0] for r in encoding.affected(df, "doc_id", "text").collect()}
    assert found == set(changed) | {lost, lost + 1}
    fixed = {r["doc_id"]: r["text"] for r in encoding.repair(df, "doc_id", "text").collect()}
    assert fixed[lost] == "Señor presidente"
    right = sum(fixed[i] == t for i, t in changed.items())
    assert right >= 0.95 * len(changed)


def test_copies_of_a_garbled_text_have_one_vote(spark):
    rows = [x for x in CLEAN for _ in range(2)] + [f"{x} {i}" for x in CLEAN for i in range(4)] + ["Öl für Ärzte, señal única"]
    bad = encoding.garble(" ".join([*CLEAN[:6], "Öl Ärzte señal única"]).replace("’", " "), "cp1252", "mac_roman")
    copies = set(range(len(rows), len(rows) + len(rows) // 2))
    df = spark.createDataFrame(list(enumerate(rows + [bad] * len(copies))), "doc_id bigint, text string")
    assert {r[0] for r in encoding.affected(df, "doc_id", "text").collect()} == copies
    fixed = {r["doc_id"]: r["text"] for r in encoding.repair(df, "doc_id", "text").collect()}
    assert set(fixed) == copies and all("Für die Präsidentin wären" in x for x in fixed.values())


def test_inverse_mappings_are_told_apart(spark):
    clean = [f"{a}{c}{b}" for a in "bdfg" for b in ("la", "na", "ra") for c in "éüñç"]
    forth, back = ("cp1252", "mac_roman", 1), ("mac_roman", "cp1252", 1)
    learned = lambda pairs: encoding.learn_mappings(spark.createDataFrame(pairs, "word string, clean string, by_texts boolean"))
    right, turned = [(encoding.garble(w, *forth), w, True) for w in clean], [(w, encoding.garble(w, *forth)) for w in clean[:8]]
    assert not {back, ("mac_roman", "latin_1", 1)} & set(got := learned(right + [(*x, True) for x in turned])) and forth in got
    copied = [(x, encoding.garble(x, *forth), False) for w in clean for x in (w, w.translate(str.maketrans("éüñç", "ßöáó")))]
    assert not {back, ("mac_roman", "latin_1", 1)} & set(got := learned(right + copied)) and forth in got
    got = learned(right + [(encoding.garble(w, *back), w, True) for w in clean])
    assert forth in got and back in got  # both mistakes in one table


def test_encoding_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert encoding.affected(empty, "doc_id", "text").count() == 0 and encoding.repair(empty, "doc_id", "text").count() == 0
    assert encoding.align("SeÃ±or", "Señor") == [("Ã±", "ñ")]
    assert encoding.restore("Â«Ã©", "utf_8", "cp1252", 1) == "«é" and encoding.restore("’é", "utf_8", "cp1252", 1) is None


def test_garblings_beyond_the_known_encodings(spark):
    odd = str.maketrans({"é": "ŧ¤", "ü": "ŧ¼", "ñ": "ŧ±"})
    clean = [f"{a}{c}{b}{d}" for a in "bdfgkl" for c, bs in zip("éüñ", ("lmn", "rst", "vwz"), strict=True) for b in bs for d in "ao"]
    rows = [(i, f"{w} plain {i}") for i, w in enumerate(clean * 3)]
    bad = {len(rows) + k: w for k, w in enumerate(clean[::2])} | {len(rows) + 500 + k: w for k, w in enumerate(("zéro", "müde", "moño"))}
    rows += [(i, w.translate(odd)) for i, w in bad.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r[0] for r in encoding.affected(df, "doc_id", "text").collect()} == set(bad)  # the last three have no near-twin
    assert {r["doc_id"]: r["text"] for r in encoding.repair(df, "doc_id", "text").collect()} == bad


def test_whole_texts_are_near_twins(spark):
    texts = ["où à – çà et là", "plain", "où est-il ? à la – fin"]
    pairs = [(t, encoding.garble(t, "cp1252", "mac_roman")) for t in texts[::2]]
    df = spark.createDataFrame(list(enumerate([x for p in pairs for x in (p[0], f"{p[0]} a", p[1])] + texts[1:2] + [None, ""])), "doc_id int, text string")
    odd = encoding.odd_texts(df, "doc_id", "text")
    twins = encoding._text_twins(df, "doc_id", "text", odd, encoding.word_counts(odd)).collect()
    assert {("où", encoding.garble("où", "cp1252", "mac_roman")), ("à", encoding.garble("à", "cp1252", "mac_roman"))} <= {(r["clean"], r["word"]) for r in twins}
