"""Sizes of texts in tokens of a public tokenizer, read from vocabulary files whose folder is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

VOCABULARIES = os.environ.get("MARLSTONE_TOKENIZERS", "/opt/tokenizers")
# --- fixed value: the public pattern that cuts a text into words before byte pairs are merged ---
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --- end of fixed value ---
_encoders: dict = {}


def encoder(path: str):
    """The encoder of a vocabulary of ranks; one for each Python worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("marlstone", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, key: str, text: str, keep: list[str] | None = None, folder: str = VOCABULARIES, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, *keep, n_tokens bigint) of each row's whole text; null and empty texts have 0 tokens."""
    path = f"{folder}/{vocabulary}"
    columns = [key, *(keep or [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b[text]]
            yield b[columns].assign(n_tokens=pd.Series(n, dtype="int64", index=b.index))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, text).mapInPandas(run, f"{kinds}, n_tokens long")
