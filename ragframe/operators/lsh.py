"""Approximate search by random-projection hash tables with multi-probe.

A table hashes a vector to the signs of its products with ``bits`` random planes
(through a given centre). A row is in one bucket of each table; a question looks
into its own bucket and into the neighbouring ones it is least far from: those
that differ in one or two planes, by the sum of its squared margins to them. What
is in a bucket is ranked against the question by exact distance as it streams by,
with a running best ``k``: pairs are never listed. Ids met in several tables count
once. The number of tables, bits and probes decides the recall."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.functions.vectors import is_vector
from ragframe.operators.search import _candidates, _fetch, _rank
from ragframe.operators.sizing import DEFAULT_BROADCAST_MAX_BYTES

SEED = 11


def planes(dim: int, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(tables, bits, dim) normal numbers of six decimals."""
    return np.round(np.random.default_rng([seed, dim]).standard_normal((tables, bits, dim)), 6)


def flips(bits: int) -> list[int]:
    """Bit masks of the buckets a question may look into: its own first, then one and two planes away."""
    return [0, *(1 << b for b in range(bits)), *((1 << a) | (1 << b) for a, b in combinations(range(bits), 2))]


def _margins(vs: pd.Series, p: np.ndarray, center: np.ndarray | None) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vs])
    if center is not None:
        x = x - center
    return np.einsum("nd,tbd->ntb", x, p)


def bucket_codes(margins: np.ndarray) -> np.ndarray:
    """(rows, tables): the bits of the planes on whose positive side a row is."""
    return ((margins > 0) << np.arange(margins.shape[2])).sum(axis=2)


def probed_codes(margins: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes): the buckets of least margin cost, ties to the earlier mask."""
    masks = np.array(flips(margins.shape[2]))
    uses = ((masks[:, None] >> np.arange(margins.shape[2])) & 1).astype(float)
    cost = np.einsum("ntb,mb->ntm", margins * margins, uses)
    chosen = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
    return bucket_codes(margins)[:, :, None] ^ masks[chosen]


def topk_lsh(corpus: DataFrame, questions: DataFrame, k: int = 10, *, tables: int = 8, bits: int = 4, probes: int = 4,
             key: str = "file_id", dim: int | None = None, center: list[float] | None = None, id_col: str = "id",
             vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "embedding", output_fields: list[str] | None = None,
             broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES, seed: int = SEED, **sizes) -> DataFrame:
    """``qid, rank, id, distance``: the nearest ``k`` rows of each question's key among the buckets
    it looks into. Rows and questions without key or id, or whose vector is not of length ``dim`` (by
    default that of the longest question), take no part (``rejected_vectors``)."""
    spark = corpus.sparkSession
    dim = dim or questions.agg(F.max(F.size(qvec_col))).first()[0] or 0
    p = spark.sparkContext.broadcast(planes(dim, tables, bits, seed))       # tables x bits x dim, parameters
    middle = None if center is None else np.asarray(center, dtype=np.float64)

    @F.pandas_udf("array<long>")
    def own(vs: pd.Series) -> pd.Series:
        if not len(vs):
            return pd.Series([], dtype=object)
        codes = bucket_codes(_margins(vs, p.value, middle)) * tables + np.arange(tables)
        return pd.Series(list(codes))

    @F.pandas_udf("array<long>")
    def looked(vs: pd.Series) -> pd.Series:
        if not len(vs):
            return pd.Series([], dtype=object)
        codes = probed_codes(_margins(vs, p.value, middle), probes) * tables + np.arange(tables)[None, :, None]
        return pd.Series(list(codes.reshape(len(vs), -1)))

    # a bucket of a table and key is one group of the search
    inside = F.concat_ws("|", F.col("_bucket").cast("string"), F.col(key).cast("string")).alias("_ck")
    good = lambda df, i, v: df.where(F.col(key).isNotNull() & F.col(i).isNotNull() & is_vector(F.col(v), dim))
    c = (good(corpus, id_col, vec_col).select(F.col(id_col).alias("id"), key, F.col(vec_col).alias("vec"))
         .withColumn("_bucket", F.explode(own("vec"))).select("id", inside, "vec"))
    q = (good(questions, qid_col, qvec_col).select(F.col(qid_col).alias("qid"), key, F.col(qvec_col).alias("qvec"))
         .withColumn("_bucket", F.explode(looked("qvec"))).select("qid", inside, "qvec"))
    scored, n_q = _candidates(c, q, "_ck", k, "auto", sizes.pop("salt", 1), broadcast_max_bytes, **sizes)
    # a row's key is known from its question's, whatever the bucket it was met in
    ranked = _rank(scored.withColumn(key, F.regexp_replace("_ck", r"^\d+\|", "")), k, 0).drop("_ck")
    if not output_fields:
        return ranked.drop(key)
    wide = corpus.select(F.col(id_col).alias("id"), F.col(key).cast("string").alias(key), *[f for f in output_fields if f not in ("id", key)])
    return _fetch(ranked, wide, ["id", key], n_q * k, broadcast_max_bytes).select(
        "qid", "rank", "id", "distance", *[f for f in output_fields if f != "id"])
