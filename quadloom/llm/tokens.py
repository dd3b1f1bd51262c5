"""Token counts of texts under a public byte-level tokenizer, whose vocabulary file is named by path and sent to executors that lack it."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession, functions as F

DEFAULT_VOCABULARY = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    import tiktoken

    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Texts are encoded in pieces of about so many characters, cut before a blank that a letter precedes and follows, where no token can cross.
_PIECE = 200_000


def count_tokens(text: str, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of one whole text."""
    e, n = encoder(path), 0
    while len(text) > _PIECE:
        cut = _PIECE
        while (cut := text.find(" ", cut)) > 0 and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        if cut < 0:
            break
        n, text = n + len(e.encode_ordinary(text[:cut])), text[cut:]
    return n + len(e.encode_ordinary(text))


def token_count(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """BIGINT token count of a text column; NULL and empty texts have 0 tokens."""
    spark = SparkSession.getActiveSession()
    if spark is not None and os.path.exists(path):
        spark.sparkContext.addFile(path)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_tokens(t, path) if t else 0).astype("int64")

    return count(text)
