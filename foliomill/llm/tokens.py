"""Token counts of texts under a public byte-level vocabulary, whose folder is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The folder of the vocabulary files, the file, and the published pre-tokenisation pattern that belongs to it.
FOLDER, FILE = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(folder: str = FOLDER, file: str = FILE):
    import tiktoken

    with open(f"{folder}/{file}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = FOLDER, file: str = FILE) -> Column:
    """Number of tokens of the whole text; null and empty texts have 0."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(folder, file).encode_ordinary
        for b in batches:
            yield pd.Series([len(encode(x)) if x else 0 for x in b], dtype="int64")

    # with the hints for an iterator the function is set up once a task
    return F.pandas_udf(count, "long")(text)
