"""Pluggable token counters: ``Column -> Column`` (long), which also work inside
higher-order-function lambdas, and tokenizers that are Python functions."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TokenCounter = Callable[[Column], Column]

# Non-space run, same class in Java regex and RE2 (Python str.split()).
WORD_PATTERN = r"[^\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]+"


def chars4(c: Column) -> Column:
    """ceil(characters / 4): the reference's own 4-characters-per-token ratio."""
    return F.ceil(F.length(c) / F.lit(4)).cast("long")


def words(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.regexp_extract_all(c, F.lit(WORD_PATTERN), 0)).cast("long")


COUNTERS: dict[str, TokenCounter] = {"chars4": chars4, "words": words}


class PythonCounter:
    """A tokenizer that is a Python function: a list of texts -> their sizes, one call per
    Arrow batch (or per part of one: a call gets at most about ``batch_chars`` characters,
    or one text). ``factory=True`` calls it once per worker to get that function. It cannot
    run inside lambdas; the chunker gives it whole arrays of pieces instead."""

    def __init__(self, fn: Callable, *, factory: bool = False, batch_chars: int = 4_000_000):
        self.fn, self.factory, self.batch_chars = fn, factory, batch_chars

    def bound(self) -> Callable[[list[str]], list[int]]:
        fn = self.fn() if self.factory else self.fn

        def sizes(texts: list[str]) -> list[int]:
            out: list[int] = []
            begin, chars = 0, 0
            for i, t in enumerate(texts):
                if chars and chars + len(t) > self.batch_chars:
                    out += fn(texts[begin:i])
                    begin, chars = i, 0
                chars += len(t)
            if begin < len(texts):
                out += fn(texts[begin:])
            if len(out) != len(texts):
                raise ValueError(f"the tokenizer gave {len(out)} sizes for {len(texts)} texts")
            return out
        return sizes

    def __call__(self, c: Column) -> Column:
        """The sizes of a column of texts; null for null."""
        @F.pandas_udf("long")
        def count(s: pd.Series) -> pd.Series:
            known = s.notna()
            return pd.Series(self.bound()(s[known].tolist()), index=s.index[known], dtype="Int64").reindex(s.index)
        return count(c)


def get_counter(counter: str | TokenCounter) -> TokenCounter:
    return COUNTERS[counter] if isinstance(counter, str) else counter


def bpe_counter(encoding_name: str = "cl100k_base") -> PythonCounter:
    """Byte-pair token counts (needs the encoding's files locally)."""
    def load():
        import tiktoken
        enc = tiktoken.get_encoding(encoding_name)
        return lambda texts: [len(ids) for ids in enc.encode_ordinary_batch(texts, num_threads=1)]
    return PythonCounter(load, factory=True)
