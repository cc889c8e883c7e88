"""Token counters: what budgets are counted in, and the name that is recorded beside the counts."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import n_words


class TokenCounter(Protocol):
    name: str

    def count(self, text: Column) -> Column:
        """Tokens of ``text`` (int); a null text has none."""


class WordCounter:
    """Words between white space: needs no vocabulary and stays in the JVM."""

    name = "words"

    def count(self, text: Column) -> Column:
        return F.coalesce(n_words(text), F.lit(0)).cast("int")


class RankCounter:
    """Byte-level BPE by a rank file and its split pattern, through ``tiktoken``, a batch of texts at a time."""

    def __init__(self, path: str, pattern: str, name: str):
        self.path, self.pattern, self.name = path, pattern, name

    def count(self, text: Column) -> Column:
        with open(self.path, "rb") as f:
            content = f.read()
        return F.pandas_udf(_counter(content, self.pattern, self.name), "int")(text)


def _counter(content: bytes, pattern: str, name: str) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        coding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield pd.Series([0 if t is None else len(coding.encode_ordinary(t)) for t in texts], dtype="int32")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def with_token_counts(df: DataFrame, counter: TokenCounter, text_col: str = "text") -> DataFrame:
    """Add n_tokens and tokenizer, the name of what counted them."""
    return df.withColumn("n_tokens", counter.count(F.col(text_col))).withColumn("tokenizer", F.lit(counter.name))
