"""Text decoded with the wrong character encoding: affected records found, the original restored where possible.

Records are compared at two grains. Whole texts that are the same once their non-ASCII characters are stripped meet the least odd of their kind, and
differ from it in aligned words. And the words of all texts that hold a character beyond ASCII meet, each with the number of different texts it is in, in
an equi-join on what is left of them without such characters; copies of a text only decide between forms that equally many texts have. The clean one of
two words is the form more texts have, of those that are not plainly UTF-8 read as something else. Aligned at their common ASCII characters, the two give
pairs of garbled and clean runs. Each pair is explained by the encodings, right and wrong, that turn the clean run into the garbled one (also twice over);
explanations that enough different pairs support are the learned mappings. Between single-byte encodings a pair could as well be the inverse mistake: it
counts only if clearly more words have it than have it turned round, and what copies alone decided counts only if no texts support the inverse. A run that
no encoding explains is mapped by itself, if most of the words that hold it have near-twins with one and the same run in its place. The mappings are then
applied to every word: where UTF-8 was read as something else, valid multi-byte sequences are decoded; where a single-byte encoding was mistaken for
another, the word is mapped if its restored form is more widespread than it is itself; runs with a map of their own are replaced. Replacement characters
and stray control characters mark damage whose original comes, if at all, from a clean near-twin.

Defined results: NULL and plain ASCII texts are clean; a word is restored the same way in all texts; with no learned mapping only replacement and control
characters are found; words that keep fewer than two ASCII characters are learned from through whole texts only, but mapped like any other; texts and words of any length are handled whole.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quadloom.session import BROADCAST_ROWS, cut

# The encodings considered.
WRONG = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")
RIGHT = ("utf_8", "cp1252", "mac_roman", "cp850", "cp437")

_TOKEN = r"(?<![^\s])[!-~]*+[^\x00-\x7f]\S*+"
_EDGE = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
#: Characters that wrongly decoded UTF-8 may well have stood for, without further evidence.
_PLAUSIBLE = re.compile(r"[ -¿À-ÿŒœŠšŽžŸ–—‘’‚“”„†‡•…‰‹›€™]+\Z")
LOST = "�"


@lru_cache(32)
def _tables(encoding: str) -> tuple[tuple[str, ...], dict[str, int]]:
    """The character of each byte and back; bytes without one stand for the control character of their number, as browsers have it."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return tuple(chars), {c: b for b, c in enumerate(chars)}


def garble(text: str, right: str, wrong: str, times: int = 1) -> str | None:
    """text as it looks when its bytes in the right encoding are read in the wrong one; NULL where right lacks a character."""
    for _ in range(times):
        if right == "utf_8":
            data = text.encode("utf_8", "surrogatepass")
        else:
            back = _tables(right)[1]
            if any(c not in back for c in text):
                return None
            data = bytes(back[c] for c in text)
        text = "".join(map(_tables(wrong)[0].__getitem__, data))
    return text


def chains() -> list[tuple[str, str, int]]:
    return [(r, w, n) for r in RIGHT for w in WRONG if r != w for n in ((1, 2) if r == "utf_8" else (1,))]


def _utf8(text: str, wrong: str) -> str:
    """text with each run of characters that are a valid multi-byte sequence in the wrong encoding decoded."""
    back = _tables(wrong)[1]
    data = [back.get(c, 0) for c in text]
    out, i = [], 0
    while i < len(text):
        b = data[i]
        n = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if n and i + n <= len(text) and all(0x80 <= x < 0xC0 for x in data[i + 1 : i + n]):
            try:
                out.append(bytes(data[i : i + n]).decode())
                i += n
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out)


def restore(word: str, right: str, wrong: str, times: int) -> str | None:
    """word restored under one learned mapping, or None if it does not apply."""
    if right == "utf_8":
        out = word
        for _ in range(times):
            out = _utf8(out, wrong)
        return out if out != word and (times == 1 or out != _utf8(word, wrong)) else None
    back, chars = _tables(wrong)[1], _tables(right)[0]
    if any(c not in back for c in word):
        return None
    out = "".join(chars[back[c]] if ord(c) > 127 else c for c in word)
    return out if out != word else None


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The differing runs beyond ASCII of two words that are alike without them, between the same ASCII characters."""
    a, b = re.split(r"[\x00-\x7f]", garbled), re.split(r"[\x00-\x7f]", clean)
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y and x and y] if len(a) == len(b) else []


def _read_as_utf8() -> str:
    """Pattern of the Latin letters and signs of UTF-8 read in any of the wrong encodings."""
    parts = []
    for wrong in WRONG:
        own = lambda first, last=None, c=_tables(wrong)[0]: "[" + "".join(f"\\x{{{ord(x):x}}}" for x in c[first : (last or first) + 1]) + "]"
        parts += [own(0xC2) + own(0xA0, 0xBF), own(0xC3) + own(0x80, 0xBF), own(0xE2) + own(0x80) + own(0x80, 0xBF)]
    return "|".join(dict.fromkeys(parts))


def _odd(text: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({_TOKEN})"), 1), lambda w: F.regexp_replace(w, _EDGE, "")))


def odd_texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key, bare, words) of the documents with a character beyond ASCII: hashes of the text, and of the text without such characters, and the words
    that hold one, once each, without ASCII punctuation around them."""
    t = F.col(text)
    rows = df.where(t.rlike(r"[^\x00-\x7f]"))
    return rows.select(F.col(id_col).alias("id"), F.unhex(F.sha2(t, 256)).alias("key"), F.unhex(F.sha2(_bare(t), 256)).alias("bare"), _odd(text).alias("words"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n_texts, n_docs): the words of odd_texts with the number of different texts and of documents that have them."""
    texts = texts.groupBy("key", "words").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(F.explode("words").alias("word"), "copies").groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("n_docs"))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, r"[^\x00-\x7f]+", "")


def _sane(word: Column) -> Column:
    return ~word.rlike("[\x80-\x9f�]") & ~word.rlike(_read_as_utf8())


_SPREAD = ("n_texts", "n_docs")


def _twins(words: DataFrame) -> DataFrame:
    """(word, clean, by_texts): words with the most widespread form that is the same without characters beyond ASCII, and if it is in more texts, not just more copies."""
    rows = words.withColumn("bare", _bare(F.col("word"))).where("length(bare) >= 2")
    best = rows.where(_sane(F.col("word"))).groupBy("bare").agg(F.max(F.struct(*_SPREAD, "word")).alias("top")).where("top.n_docs >= 2").select("bare", "top")
    fewer = F.struct(*_SPREAD) < F.struct("top.n_texts", "top.n_docs")
    return rows.join(best, "bare").where(F.expr("word <> top.word") & fewer).select("word", F.col("top.word").alias("clean"), F.expr("n_texts < top.n_texts").alias("by_texts"))


def _text_twins(df: DataFrame, id_col: str, text: str, texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, clean, by_texts): the words in which whole texts that are the same without characters beyond ASCII differ; each text meets one of its kind, the least odd."""
    several = texts.groupBy("bare").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").select("bare")
    rows = cut(texts.join(several, "bare", "left_semi").groupBy("key", "bare").agg(F.min("id").alias("id")))  # one of each group of copies
    small = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(F.broadcast(rows) if small else rows, "id").dropDuplicates(["key"]))
    odd = F.size(F.regexp_extract_all("t", F.lit(f"({_read_as_utf8()}|[\x80-\x9f�])"), 1))
    best = rows.groupBy("bare").agg(F.min(F.struct(odd.alias("odd"), "key")).alias("best")).select("bare", F.col("best.key").alias("best"))
    rows = rows.join(best, "bare")
    tokens = lambda c: F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, _EDGE, ""))
    clean = rows.where("key = best").select(F.col("bare").alias("b2"), tokens(F.col("t")).alias("clean"))
    both = rows.where("key <> best").select("bare", tokens(F.col("t")).alias("own")).join(clean, F.col("bare") == F.col("b2")).where("size(own) = size(clean)")
    pairs = both.select(F.explode(F.arrays_zip("own", "clean")).alias("x")).where("x.own <> x.clean").select("x.own", "x.clean").distinct()
    spread = lambda name: words.select(F.col("word").alias(name), F.struct(*_SPREAD).alias(f"{name}_spread"))
    pairs = pairs.join(spread("own"), "own").join(spread("clean"), "clean")
    turned = F.col("own_spread") > F.col("clean_spread")
    pairs = pairs.where("own_spread <> clean_spread").select(
        F.when(turned, F.col("clean")).otherwise(F.col("own")).alias("word"), F.when(turned, F.col("own")).otherwise(F.col("clean")).alias("clean"), F.expr("own_spread.n_texts <> clean_spread.n_texts").alias("by_texts")
    )
    return pairs.where(_sane(F.col("clean")) & (_bare(F.col("word")) == _bare(F.col("clean")))).distinct()


_PIECES = r"([^\x00-\x7f]+|[\x00-\x7f]+)"


def learn_runs(twins: DataFrame, words: DataFrame, min_words: int = 5, min_share: float = 0.8) -> DataFrame:
    """(run, restored): runs beyond ASCII that no chain of encodings explains, of which at least min_words words and min_share of all words that hold them
    have a near-twin with one and the same run in their place."""
    known = chains()

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, g, c) for w, t in zip(batch["word"], batch["clean"], strict=True) for g, c in align(w, t)]
            yield pd.DataFrame(rows, columns=["word", "run", "restored"])

    def unexplained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[not any(garble(c, *k) == g or garble(g, *k) == c for k in known) for g, c in zip(batch["run"], batch["restored"], strict=True)]]

    runs = twins.where("by_texts").mapInPandas(pairs, "word string, run string, restored string").distinct().groupBy("run", "restored").agg(F.count(F.lit(1)).alias("n"))
    best = runs.groupBy("run").agg(F.max(F.struct("n", "restored")).alias("b")).select("run", "b.n", "b.restored").where(F.col("n") >= min_words)
    held = words.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(r"([^\x00-\x7f]+)"), 1))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("held"))
    best = best.join(held, "run").where(F.col("n") >= min_share * F.col("held"))
    return best.select("run", "restored").mapInPandas(unexplained, "run string, restored string")


def map_runs(words: DataFrame, runs: DataFrame) -> DataFrame:
    """(word, restored): the words that hold a mapped run, with all such runs replaced."""
    pieces = words.select("word", F.posexplode(F.regexp_extract_all("word", F.lit(_PIECES), 1)).alias("at", "run")).join(runs, "run", "left")
    order = F.array_sort(F.collect_list(F.struct("at", F.coalesce("restored", "run").alias("piece"))))  # the pieces of one word
    out = pieces.groupBy("word").agg(F.max(F.col("restored").isNotNull()).alias("hit"), F.array_join(F.transform(order, lambda x: x["piece"]), "").alias("restored"))
    return out.where("hit").drop("hit")


def learn_mappings(twins: DataFrame, min_pairs: int = 2, min_words: int = 3) -> list[tuple[str, str, int]]:
    """The chains (right, wrong, times) that enough pairs of runs support; a pair counts for the chains of fewest steps that explain it."""
    known = chains()
    known += [(w, r, 1) for r, w, _ in known if r != "utf_8" and (w, r, 1) not in known]  # inverses are weighed, not learned

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(min(g, c), max(g, c), g < c, by) for w, t, by in zip(batch["word"], batch["clean"], batch["by_texts"], strict=True) for g, c in align(w, t)]
            yield pd.DataFrame(rows, columns=["a", "b", "up", "by_texts"])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, up, down, sure_up, sure_down in batch.itertuples(index=False, name=None):
                for g, c, n, turned, sure, sure_turned in ((a, b, up, down, sure_up, sure_down), (b, a, down, up, sure_down, sure_up)):
                    net = sure if sure > 2 * sure_turned else 0
                    most = 0 if sure_turned > 2 * sure else n if n > 2 * turned else net
                    for i, (r, w, k) in enumerate(known):
                        if n and garble(c, r, w, k) == g:
                            rows.append((i, n, n) if r == "utf_8" else (i, most, net))
            yield pd.DataFrame(rows, columns=["chain", "n", "sure"])

    runs = twins.mapInPandas(pairs, "a string, b string, up boolean, by_texts boolean").groupBy("a", "b")  # a pair and the same turned round
    runs = runs.agg(*[F.count_if(F.expr(x)).alias(name) for name, x in (("n_up", "up"), ("n_down", "not up"), ("sure_up", "up and by_texts"), ("sure_down", "not up and by_texts"))])
    support = runs.mapInPandas(explain, "chain int, n bigint, sure bigint").groupBy("chain")
    support = support.agg(F.count_if(F.expr("n > 0")).alias("pairs"), F.sum("n").alias("words"), F.count_if(F.expr("sure > 0")).alias("sure_pairs"), F.sum("sure").alias("sure_words"))
    by = {known[r["chain"]]: r for r in support.collect()}  # at most one row a chain
    learned = []
    for chain in chains():
        if (r := by.get(chain)) is not None:
            inverse = by.get((chain[1], chain[0], 1))
            n, words = (r["sure_pairs"], r["sure_words"]) if inverse is not None and inverse["sure_words"] else (r["pairs"], r["words"])
            if n >= min_pairs and words >= min_words:
                learned.append((-words, r["chain"], chain))
    return [chain for _, _, chain in sorted(learned)]


def garbled_words(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(word, restored, mapping) of every garbled word, restored NULL where its original is not known; and the (id, word) rows they were found in."""
    texts = cut(odd_texts(df, id_col, text))
    words = cut(word_counts(texts))
    twins = cut(_twins(words).unionByName(_text_twins(df, id_col, text, texts, words)).groupBy("word", "clean").agg(F.max("by_texts").alias("by_texts")))
    learned = learn_mappings(twins)
    runs = cut(learn_runs(twins, words))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, *n in zip(batch["word"], batch["n_texts"], batch["n_docs"], strict=True):
                for rank, (r, w, k) in enumerate(learned):
                    if (x := restore(word, r, w, k)) is not None and not any(ud.category(c) == "Cc" for c in x):
                        changed = "".join(c for c in x if ord(c) > 127)
                        sure = r == "utf_8" and _PLAUSIBLE.match(changed) is not None
                        out.append((word, *n, x, f"{r}>{w}" + ">again" * (k - 1), sure, k * 100 - rank))
                if LOST in word or any(0x80 <= ord(c) < 0xA0 for c in word):
                    out.append((word, *n, None, "lost", True, -1))
            yield pd.DataFrame(out, columns=["word", "n_texts", "n_docs", "restored", "mapping", "sure", "rank"])

    found = words.mapInPandas(candidates, "word string, n_texts bigint, n_docs bigint, restored string, mapping string, sure boolean, rank int")
    lexicon = words.select(F.col("word").alias("lex"), F.struct("n_texts", "n_docs").alias("spread"))
    found = found.join(lexicon, F.col("restored") == F.col("lex"), "left").withColumn("known", F.coalesce(F.col("spread") > F.struct("n_texts", "n_docs"), F.lit(False)))
    best = F.max(F.struct("known", "rank", "spread", "restored", "mapping"))
    found = found.where("sure or known").select("word", "known", "rank", "spread", "restored", "mapping")
    if not runs.isEmpty():
        mapped = map_runs(words, runs).select("word", F.lit(False).alias("known"), F.lit(-2).alias("rank"), F.lit(None).cast(found.schema["spread"].dataType).alias("spread"), "restored", F.lit("runs").alias("mapping"))
        found = found.unionByName(mapped)  # only where no chain of encodings applies
    found = found.groupBy("word").agg(best.alias("b"))
    clean = twins.where(_sane(F.col("clean"))).groupBy("word").agg(F.max("clean").alias("clean"))
    found = found.join(clean, "word", "left").select("word", F.coalesce("b.restored", F.when(F.col("b.mapping") == "lost", F.col("clean"))).alias("restored"), F.col("b.mapping").alias("mapping"))
    return found, texts.select("id", F.explode("words").alias("word"))


def repair(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, restored text, n_garbled, n_lost): one row per affected document; words whose original is not known stay as they are."""
    found, rows = garbled_words(df, id_col, text)
    fixes = rows.join(found, "word").groupBy("id").agg(F.collect_list(F.struct("word", "restored")).alias("fixes"))  # at most the document's own words
    fixes = fixes.withColumns({"n_garbled": F.size("fixes"), "n_lost": F.size(F.filter("fixes", lambda x: x["restored"].isNull()))})
    joined = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(fixes, "id")
    token, edge = re.compile(r"(?<!\S)[!-~]*[^\x00-\x7f]\S*", re.ASCII), re.compile(_EDGE)

    @F.pandas_udf("string")
    def apply(texts: pd.Series, fixes: pd.Series) -> pd.Series:
        def one(t: str, fx) -> str:
            by = {f["word"]: f["restored"] for f in fx if f["restored"] is not None}

            def swap(m: re.Match) -> str:
                core = edge.sub("", m[0])
                return m[0].replace(core, by[core], 1) if core in by else m[0]

            return token.sub(swap, t)

        return pd.Series([one(t, fx) for t, fx in zip(texts, fixes, strict=True)])

    return joined.select(F.col("id").alias(id_col), apply("text", "fixes").alias(text), "n_garbled", "n_lost")


def affected(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """The ids of the documents with at least one garbled word."""
    found, rows = garbled_words(df, id_col, text)
    return rows.join(found.select("word"), "word", "left_semi").select(F.col("id").alias(id_col)).distinct()
