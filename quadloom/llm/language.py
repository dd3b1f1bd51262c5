"""A language with a confidence for each text and for each segment of a mixed-language text.

Scripts narrow the candidates of each word: only languages whose labelled text uses the word's script are candidates, and words of a script that none
uses are 'und'. Candidates get a log score: from word counts where the word was seen in labelled text, else from its character trigrams at half
weight, both clipped so that names decide nothing. Viterbi with a penalty for switching, smaller where a sentence ends, labels the words; runs of one
label are the segments. Scores are fitted on labelled rows in two rounds: rows whose own label the first model contradicts are left out of the second,
so wrong labels do not stay in the model. The languages are those that the labels name.

The texts of a batch are labelled together: words are cut out of their characters as one array, each distinct word is scored once, and the search goes
over the first, second, ... word of all texts at once.

The sample for fitting is bounded by about `train_rows` distinct texts a language, taken by hash; labelling covers every row and whole texts. Defined
results: NULL and wordless texts get language 'und' with confidence 0 and no segments; if no labelled row exists every text is such; a sentence gets the
language of most of its words, the first by name of those with equally many; a text that of most characters, the last by name likewise.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quadloom.session import cut

# Primary subtags of two and three letters.
TAGS = {"en": "en", "eng": "en", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr", "es": "es", "spa": "es", "it": "it", "ita": "it"}
# Ranges of letters of widespread scripts.
SCRIPTS = {
    "Latin": r"A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿﬀ-ﬆＡ-Ｚａ-ｚ", "Greek": "Ͱ-Ͽἀ-῿", "Cyrillic": "Ѐ-ԯꙀ-ꚟ", "Armenian": "Ա-֏", "Hebrew": "א-ת", "Arabic": "ؠ-ۿݐ-ݿ",
    "Devanagari": "ऀ-ॿ", "Bengali": "ঀ-৿", "Tamil": "஀-௿", "Thai": "ก-๎", "Georgian": "Ⴀ-ჿ", "Hangul": "ᄀ-ᇿ가-힣", "Kana": "ぁ-ヿ", "Han": "㐀-䶿一-鿿",
}
_MARK = "̀-ͯ"
# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = "mr mrs ms dr sr sra st no nr art abs mme mlle prof hr fr sig m bzw ca cf ref etc vgl usw núm"

_WORD = r"\p{L}[\p{L}\p{M}]*"
_SCRIPT_OF = {name: re.compile(f"[{chars}{_MARK}]+\\Z") for name, chars in SCRIPTS.items()}
_END = re.compile(r"(?<=[.!?…])[\"”“»’)\]]*\s+(?=\S)|\n+")
_SHORT = re.compile(rf"(?i)(?:^|\W)(?:{'|'.join(ABBREVIATIONS.split())})\.$")
SWITCH, SWITCH_AT_END, CLIP = 9.0, 2.5, 3.5


def tag_language(tag: Column, tags: dict[str, str] = TAGS) -> Column:
    """The two-letter language that a tag states, or NULL for none and for languages that are not known here."""
    primary = F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]), primary)


@dataclass
class Model:
    """Clipped log scores by word and by trigram, in the order of languages, and the languages that use each script."""

    languages: tuple[str, ...] = ()
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)
    grams: dict[str, tuple[float, ...]] = field(default_factory=dict)
    scripts: dict[str, tuple[bool, ...]] = field(default_factory=dict)
    seen: dict[str, tuple[float, ...] | None] = field(default_factory=dict)  # scores made before, kept per worker

    def score(self, word: str) -> tuple[float, ...] | None:
        """The scores of a word in small letters; None where no language uses its script."""
        if word in self.seen:
            return self.seen[word]
        script = "Latin" if word.isascii() else next((s for s, p in _SCRIPT_OF.items() if p.match(word)), None)
        if (used := self.scripts.get(script)) is None:
            hit = None
        else:
            if (hit := self.words.get(word)) is None:
                w, n = f"^{word}$", len(self.languages)
                grams = [g for i in range(len(w) - 2) if (g := self.grams.get(w[i : i + 3]))]
                hit = tuple(max(-CLIP / 2, min(CLIP / 2, 0.5 * sum(g[i] for g in grams))) for i in range(n)) if grams else (0.0,) * n
            if not all(used):
                hit = tuple(h if u else -CLIP for h, u in zip(hit, used, strict=True))
        if len(self.seen) < 400_000:
            self.seen[word] = hit
        return hit


def _scores(counts: pd.DataFrame, key: str, languages: tuple[str, ...]) -> dict[str, tuple[float, ...]]:
    """Log of each language's smoothed rate over the mean rate."""
    wide = counts.pivot_table(index=key, columns="lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=list(languages), fill_value=0)
    rate = (wide + 0.3) / (wide.sum() + 0.3 * max(1, len(wide))).clip(lower=1)
    out = rate.div(rate.mean(axis=1), axis=0)
    return {k: tuple(max(-CLIP, min(CLIP, math.log(x))) for x in row) for k, row in zip(out.index, out.to_numpy(), strict=True)}


def _fit(labelled: DataFrame, languages: tuple[str, ...], min_count: int = 2, min_use: float = 0.02) -> Model:
    words = labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORD})"), 1)).alias("word"))
    counts = cut(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = counts.select("lang", "n", padded.alias("w")).select("lang", "n", F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substr(w, i, 3))")).alias("gram"))
    grams = grams.groupBy("lang", "gram").agg(F.sum(F.sqrt("n")).alias("n")).where("n >= 2")
    script = F.lit(None).cast("string")
    for name, chars in SCRIPTS.items():
        script = F.when(F.col("word").rlike(f"^[{chars}{_MARK}]+$"), name).otherwise(script)
    used = {(r["lang"], r["script"]): r["n"] for r in counts.groupBy("lang", script.alias("script")).agg(F.sum("n").alias("n")).collect()}  # languages by scripts
    total = {x: sum(n for (lang, _), n in used.items() if lang == x) for x in languages}
    scripts = {s: tuple(used.get((x, s), 0) > min_use * total[x] for x in languages) for s in SCRIPTS}
    scripts = {s: uses for s, uses in scripts.items() if any(uses)}
    return Model(languages, _scores(counts.where(f"n >= {min_count}").toPandas(), "word", languages), _scores(grams.toPandas(), "gram", languages), scripts)  # bounded by the sample


def fit_languages(df: DataFrame, text: str, tag: str, train_rows: int = 5_000, min_chars: int = 80, tags: dict[str, str] = TAGS) -> Model:
    """Fit on at most about train_rows distinct labelled texts a language; tags maps the primary subtags that name a language to it."""
    rows = df.select(F.col(text).alias("text"), tag_language(F.col(tag), tags).alias("lang")).where(f"lang is not null and length(text) >= {min_chars}")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}  # at most one row a language
    if not n:
        return Model()
    languages, share = tuple(sorted(n)), F.lit(1.0)
    for lang, k in n.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_rows / k))).otherwise(share)
    rows = cut(rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000).distinct())
    first = _fit(rows, languages)
    agree = rows.withColumn("said", label_texts(F.col("text"), first)["lang"]).where("said = lang")
    second = _fit(agree, languages)
    return second if second.words else first


def _cut_words(whole: str) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each word and the one after its last: runs of letters and marks."""
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.flatnonzero(np.bincount(codes)) if len(codes) else []
    letter = np.zeros(int(codes.max(initial=0)) + 1, bool)
    letter[present] = [ud.category(chr(c))[0] in "LM" for c in present]
    edge = np.diff(letter[codes].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def best_paths(gain: np.ndarray, same: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The label of every word on the best path of its text: gain has a row of scores a word, text after text; same tells whether a word is in the sentence
    of the one before; counts has the words of each text. All texts are searched at once, by the place of their words, as long as they have one there."""
    if not len(gain):
        return np.zeros(0, np.int16)
    n = gain.shape[1]
    order = np.argsort(-counts, kind="stable")
    length, first = counts[order], (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0))  # the texts that have a word at each place
    best, back, labels, every = np.zeros((len(counts), n)), np.empty(gain.shape, np.int16), np.empty(len(gain), np.int16), np.arange(n)
    for t, a in enumerate(active):
        i, b = first[:a] + t, best[:a]
        top = b.argmax(axis=1)
        jump = (b[np.arange(a), top] - np.where(same[i], SWITCH, SWITCH_AT_END))[:, None]
        back[i] = np.where(b >= jump, every, top[:, None])
        best[:a] = np.maximum(b, jump) + gain[i]
    at = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        i = first[: active[t]] + t
        labels[i] = at[: active[t]]
        at[: active[t]] = back[i, at[: active[t]]]
    return labels


def _confidence(totals: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The share of a label's likelihood among all languages; 0 for 'und', which is the label after the last language."""
    n = totals.shape[1]
    own = totals[np.arange(len(label)), np.minimum(label, n - 1)]
    return np.where(label < n, 1 / np.exp(np.clip(totals - own[:, None], -50, 50)).sum(axis=1), 0.0)


def label_batch(texts: list[str], model: Model) -> pa.StructArray:
    """Language, confidence, segments and sentences of each text."""
    size, n = np.array([len(t) for t in texts], np.int64), len(model.languages)
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    whole = "\n".join(texts)
    begin, end = _cut_words(whole) if model.words else (np.zeros(0, np.int64),) * 2
    text = np.searchsorted(offset, begin, side="right") - 1
    ends = [m.start() for m in _END.finditer(whole)] if len(begin) else []
    ends = np.array([e for e in ends if not _SHORT.search(whole[max(0, e - 8) : e])], np.int64)
    sentence = np.searchsorted(ends, begin, side="right")
    ids, distinct = pd.factorize(np.array([whole[b:e].lower() for b, e in zip(begin.tolist(), end.tolist(), strict=True)], object))
    scored = [model.score(w) for w in distinct]
    known = np.array([s is not None for s in scored], bool)[ids]
    gain = np.array([s or (0.0,) * n for s in scored], float).reshape(len(scored), n)[ids]
    follows = np.concatenate([[False], text[1:] == text[:-1]]) if len(text) else np.zeros(0, bool)
    same = follows & np.concatenate([[False], sentence[1:] == sentence[:-1]]) if len(text) else follows
    label = np.where(known, best_paths(gain, same, np.bincount(text, minlength=len(texts))), n)
    names = pa.array([*model.languages, "und"])
    at = offset[text]  # positions count from the start of each text

    def parts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(new)) - 1 if len(firsts) else firsts
        return firsts, lasts, np.add.reduceat(gain, firsts, axis=0) if len(firsts) else gain[:0]

    def listed(firsts: np.ndarray, fields: dict[str, pa.Array]) -> pa.ListArray:
        bounds = np.searchsorted(text[firsts], np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    def span(firsts: np.ndarray, lasts: np.ndarray, lang: np.ndarray, confidence: np.ndarray) -> dict[str, pa.Array]:
        whole_numbers = {"start": begin[firsts] - at[firsts], "end": end[lasts] - at[firsts], "words": lasts - firsts + 1}
        x = {k: pa.array(v, pa.int32()) for k, v in whole_numbers.items()}
        return {"start": x["start"], "end": x["end"], "lang": names.take(pa.array(lang)), "confidence": pa.array(confidence, pa.float64()), "words": x["words"]}

    firsts, lasts, totals = parts(~follows | np.concatenate([[True], label[1:] != label[:-1]]) if len(text) else follows)
    said = label[firsts]
    sure = _confidence(totals, said)
    segments = listed(firsts, span(firsts, lasts, said, sure))
    chars = end[lasts] - begin[firsts]
    by = np.bincount(text[firsts] * (n + 1) + said, weights=chars, minlength=len(texts) * (n + 1)).reshape(-1, n + 1)
    weighed = np.bincount(text[firsts] * (n + 1) + said, weights=chars * sure, minlength=len(texts) * (n + 1)).reshape(-1, n + 1)
    backwards = np.array(sorted(range(n + 1), key=lambda i: names[i].as_py(), reverse=True))
    lang = np.where(by.sum(axis=1) > 0, backwards[by[:, backwards].argmax(axis=1)], n) if len(texts) else np.zeros(0, np.int64)
    confidence = weighed[np.arange(len(texts)), lang] / np.maximum(1, by[np.arange(len(texts)), lang])

    firsts, lasts, totals = parts(~same)
    number = np.repeat(np.arange(len(firsts)), lasts - firsts + 1)
    votes = np.bincount(number * (n + 1) + label, minlength=len(firsts) * (n + 1)).reshape(-1, n + 1)
    said = votes.argmax(axis=1) if len(firsts) else np.zeros(0, np.int64)
    fields = span(firsts, lasts, said, _confidence(totals, said))
    sentences = listed(firsts, fields | {"share": pa.array(votes.max(axis=1, initial=0) / (lasts - firsts + 1), pa.float64())})
    return pa.StructArray.from_arrays([names.take(pa.array(lang)), pa.array(confidence, pa.float64()), segments, sentences], ["lang", "confidence", "segments", "sentences"])


_SEGMENT = "array<struct<start:int,end:int,lang:string,confidence:double,words:int>>"
_SENTENCE = "array<struct<start:int,end:int,lang:string,confidence:double,words:int,share:double>>"


def label_texts(text: Column, model: Model) -> Column:
    """Struct (lang, confidence, segments, sentences) of each text; positions count characters from 0."""
    shared = Model(model.languages, model.words, model.grams, model.scripts)

    @F.arrow_udf(f"struct<lang:string,confidence:double,segments:{_SEGMENT},sentences:{_SENTENCE}>")
    def label(texts: pa.Array) -> pa.Array:
        return label_batch([t or "" for t in texts.to_pylist()], shared)

    return label(text)


def whole_sentence_languages(labelled: Column, min_words: int = 2, min_share: float = 0.7, min_confidence: float = 0.9) -> Column:
    """The languages in which at least one sentence of a labelled text is written as a whole."""
    whole = F.filter(labelled["sentences"], lambda s: (s["words"] >= min_words) & (s["share"] >= min_share) & (s["confidence"] >= min_confidence) & (s["lang"] != "und"))
    return F.array_distinct(F.transform(whole, lambda s: s["lang"]))
