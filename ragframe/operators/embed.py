"""Embedding and chunk enrichment.

The embedder is pluggable. The built-in deterministic stand-in is a hashed
bag of words: token -> bucket ``int(md5(token)[:8], 16) % dim``, counts per
bucket, L2-normalised. ``hash_buckets`` and ``hash_embed_joined`` run as Spark
aggregations (a partial aggregation per task, then one shuffle of at most ``dim``
rows per text); ``hash_embedder``, the default of ``enrich_chunks``, takes the place
of a model call: an Arrow batch of texts goes to Python."""

from __future__ import annotations

from typing import Callable

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import newline_to_space
from ragframe.functions.tokens import WORD_PATTERN, TokenCounter, chars4, get_counter
from ragframe.operators.partitioning import spread


def token_bucket(tok: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dim))


def hash_buckets(df: DataFrame, keys: list[str], text_col: str, dim: int) -> DataFrame:
    """Rows ``(keys, bucket, cnt)`` for the non-zero buckets of each text."""
    toks = (spread(df).select(*keys, F.explode_outer(F.regexp_extract_all(
        newline_to_space(F.col(text_col)), F.lit(WORD_PATTERN), 0)).alias("_tok"))
        .filter(F.col("_tok").isNotNull()))
    return (toks.groupBy(*keys, token_bucket(F.col("_tok"), dim).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def hash_embed_joined(df: DataFrame, keys: list[str], text_col: str = "content", dim: int = 64,
                      out_col: str = "embedding") -> DataFrame:
    """JVM-only variant: bucket counts by aggregation, joined back on
    ``keys``. Reads ``df`` twice, so use it on a stored table."""
    b = hash_buckets(df, keys, text_col, dim)
    vec = (b.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("_m"),
                                F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("_norm"))
           .select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                      lambda i: (F.coalesce(F.try_element_at(F.col("_m"), i.cast("long")), F.lit(0))
                                                 / F.col("_norm")).cast("float")).alias(out_col)))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (df.join(vec, keys, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), zero)))


def hash_embedder(dim: int = 64):
    """Arrow-batched hashed bag-of-words embedder (the shape of a real
    embedding-model call: one batch of texts in, one batch of vectors out).
    Same buckets and normalisation as ``hash_buckets``."""
    import hashlib

    import numpy as np

    @F.pandas_udf("array<float>")
    def _embed(texts: pd.Series) -> pd.Series:
        cache: dict[str, int] = {}
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            counts = np.zeros(dim, dtype=np.float64)
            # str.split() separates on exactly WORD_PATTERN's separator set
            # (Unicode White_Space plus U+001C..U+001F), at C speed
            for tok in t.split():
                b = cache.get(tok)
                if b is None:
                    b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim
                    cache[tok] = b
                counts[b] += 1.0
            norm = float(np.sqrt((counts * counts).sum()))
            out.append((counts / norm if norm > 0 else counts).astype(np.float32))
        return pd.Series(out)

    return _embed


def hash_embed(df: DataFrame, keys: list[str], text_col: str = "content", dim: int = 64,
               out_col: str = "embedding") -> DataFrame:
    """Dense L2-normalised float vector per text (texts without tokens get a
    zero vector), computed in-row: no shuffle, no second read of ``df``."""
    return df.withColumn(out_col, hash_embedder(dim)(F.col(text_col)))


Embedder = Callable[[DataFrame, list[str], str], DataFrame]


def enrich_chunks(chunks: DataFrame, keys: list[str], *, content_col: str = "content",
                  dim: int = 64, counter: TokenCounter | str = chars4,
                  embedder: Embedder | None = None) -> DataFrame:
    """Add ``embedding`` (of the text with newlines as spaces) and
    ``num_tokens`` (of the unchanged text)."""
    counter = get_counter(counter)
    out = chunks.withColumn("num_tokens", counter(F.col(content_col)))
    if embedder is None:
        return hash_embed(out, keys, content_col, dim)
    return embedder(out, keys, content_col)
