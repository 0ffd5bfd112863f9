"""Token counts with a public byte-pair tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the public 50k byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(vocabulary: str):
    """The tokenizer of a ``.tiktoken`` rank file; loaded once a worker process."""
    import tiktoken

    loaded = tiktoken.__dict__.setdefault("_loaded_by_path", {})
    if vocabulary not in loaded:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        loaded[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return loaded[vocabulary]


def n_tokens(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens of ``text``; 0 for null. Whole texts are counted."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)
