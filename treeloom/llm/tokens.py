"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary file; it has to be at this path on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(count(text)) if isinstance(text, str) else 0 for text in batch["text"]]
            yield batch.drop(columns="text").assign(n_tokens=pd.Series(sizes, batch.index, "int32"))

    return run


def with_token_counts(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``n_tokens`` in place of ``text``; a null text has none. Special tokens written in a text count as ordinary text."""
    kept = [f for f in df.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_tokens int"])
    return df.select(*[f.name for f in kept], "text").mapInPandas(_count(path), schema)


def sized_texts(documents: DataFrame, *more: str, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, digest, n_tokens`` and further columns, one row per id: of several texts for one id the one with the greatest SHA-256 holds. Rows without id are left out, a null text counts as empty.

    Texts are counted where they are read and never shuffled; exact duplicates fall together afterwards.
    """
    rows = documents.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), *more, "text")
    counted = with_token_counts(rows, path)
    best = F.max(F.struct("digest", "n_tokens", *more)).alias("_b")
    return counted.groupBy("doc_id").agg(best).select("doc_id", *[F.col("_b")[c].alias(c) for c in ("digest", "n_tokens", *more)])
