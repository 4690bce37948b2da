"""Lengths of texts in tokens of a public tokenizer. The vocabulary's path is a parameter; nothing is trained or copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of a byte-level BPE for many languages, and the pattern that splits text before its merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens, the length of the whole text; 0 for a null or empty text."""
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch["_text"]]
            yield batch.drop(columns="_text").assign(n_tokens=pd.Series(n, dtype="int64", index=batch.index))

    return chosen.mapInPandas(count, f"{fields}{', ' if fields else ''}n_tokens bigint")
