"""MinHash near-dedup: universal hash minima, banding, verification, components.

1. Documents of one word sequence are a class; its smallest id stands for it,
   so copies cost one aggregate and never meet in a bucket.
2. A representative's signature is the minimum of ``BANDS * ROWS`` universal
   hashes over its word shingles; each band's minima make a bucket key.
3. In every bucket all members are paired with the smallest one (a star, not all
   pairs). Pairs whose signatures agree are verified on the full shingle sets,
   and the links found are closed into components by large-star / small-star.
4. A bucket may still hold several components. Only those buckets are compared in
   full: blocks of bounded size count the shingles that rows of different
   components share and give back a spanning set of the links. So no link
   between different texts that share a bucket is lost, and neither the pairs
   inside a component nor those that fail are ever rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.buckets import bucket_members, open_members, pairs_across, star_pairs
from ragframe.llm.common import id_and_text, semi_join_measured, written
from ragframe.llm.components import connected_components

BANDS, ROWS = 28, 6          # a pair of similarity 0.85 shares no band with probability 2e-6, of 0.8 2e-4
SEED = 20_240_607
SIGNATURE_SLACK = 0.15       # an estimate this far below the threshold (5 standard errors) ends a pair


def word_list(text: str) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, no word none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = hashed_words(words)
    factors = np.random.default_rng(SEED).integers(1, 2 ** 63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    k = min(k, len(words))
    mixed = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        mixed += h[i:len(h) - k + 1 + i] * factors[i]
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed * np.uint64(0x9E3779B97F4A7C15))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """High 32 bits of the minima of a * x + b (mod 2^64), for all (a, b)."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(shingles), 1024):  # keeps the table in cache
        np.minimum(least, (a[:, None] * shingles[None, s:s + 1024] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(sig[i * ROWS:(i + 1) * ROWS].tobytes(), seed=i) - (1 << 63) for i in range(BANDS)]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, digest of the word sequence, n_shingles, signature (16 bits a minimum) and band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()),
                        ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        rng = np.random.default_rng(SEED + 1)
        a = rng.integers(0, 2 ** 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2 ** 63, size=BANDS * ROWS, dtype=np.uint64)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = word_list(text)
                shingles = shingle_set(words, k)
                sig = signature(shingles, a, b) if len(shingles) else None
                rows.append((xxhash.xxh3_128_digest(b" ".join(words)), len(shingles),
                             None if sig is None else (sig & 0xFFFF).astype("<u2").tobytes(),
                             [] if sig is None else band_keys(sig)))
            digest, n, sig, bands = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()),
                 pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, digest binary, n_shingles long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int, name: str) -> DataFrame:
    """(doc_id, shingles as bytes) of the documents in ``nodes`` (column doc_id)."""
    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), pa.array([shingle_set(word_list(text.as_py()), k).tobytes()], pa.binary())],
                    names=["doc_id", "shingles"])

    texts = semi_join_measured(docs, written(nodes.distinct(), f"{name}-ids"), "doc_id").dropDuplicates(["doc_id", "text"])
    return written(texts.mapInArrow(run, "doc_id long, shingles binary"), f"{name}-sets")


def similar(left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """Matrix of 100 * intersection >= percent * union, of shingle sets as bytes."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in (left if left is right else [*left, *right])]
    size = np.array([len(x) for x in sets], dtype=np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = held > 1                        # a shingle of one set alone is in no intersection
    column = (np.cumsum(several) - 1)[at][several[at]]
    owner = owner[several[at]]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    m = len(left)
    rest = slice(0, m) if left is right else slice(m, None)
    shared = np.zeros((m, len(size[rest])))
    for s in range(0, int(several.sum()), 2048):  # bounds the table
        x, y = np.searchsorted(column, (s, s + 2048))
        table = np.zeros((len(sets), 2048), dtype=np.float32)
        table[owner[x:y], column[x:y] - s] = 1
        shared += table[:m] @ table[rest].T
    return 100 * shared >= percent * (size[:m, None] + size[None, rest] - shared)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, BANDS * ROWS)


def agreeing(pairs: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree on a share of ``floor`` or more."""
    @F.pandas_udf("double")
    def agreement(x, y):
        import pandas as pd
        return pd.Series((_signatures(x) == _signatures(y)).mean(axis=1) if len(x) else [], dtype=float)

    s = reps.select("rep", "sig")
    return (pairs.join(s.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(s.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
            .where(agreement("sig_a", "sig_b") >= floor).select("a", "b"))


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    @F.pandas_udf("boolean")
    def linked(x, y):
        import pandas as pd
        return pd.Series([bool(similar([p], [q], percent)[0, 0]) for p, q in zip(x, y, strict=True)], dtype=bool)

    pairs = written(pairs, f"{name}-pairs")
    sets = shingle_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), k, name)
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"))
    return written(both.where(linked("sa", "sb")).select("a", "b").distinct(), f"{name}-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    Documents link if 100 * |intersection| >= percent * |union| of their sets of
    k-word shingles (a text of fewer words is one shingle). Null, empty and
    blank texts have no shingle and no link. Ids are unique up to repeated rows,
    which give a row each; of an id with different texts, each row has its own
    text's component and the class of the smallest digest is compared. A null id
    links with nothing: it has no component and is kept."""
    d = id_and_text(docs, id_col, text_col)
    sketched = written(sketches(d, k), "sketches")
    floor = percent / 100 - SIGNATURE_SLACK
    full = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"),
                                              F.first("bands").alias("bands")), "reps")
    members = bucket_members(reps.select(F.col("rep").alias("node"), F.explode("bands").alias("key")), "minhash")
    one = reps.groupBy("rep").agg(F.min(F.struct("digest", "sig")).alias("first")).select("rep", "first.sig")
    links = verified(agreeing(star_pairs(members), one, floor), d, k, percent, "star")
    open_ = open_members(members, connected_components(links), "minhash")
    sets = shingle_sets(d, open_.select(F.col("node").alias("doc_id")), k, "open")
    more = written(pairs_across(open_, sets.toDF("node", "payload"), lambda x, y: similar(x, y, percent), spanning=True), "more-links")
    components = connected_components(links.unionByName(more))
    named = (reps.select("digest", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left")
             .select("digest", F.coalesce("component", "rep").alias("component_id")))
    return (sketched.select("doc_id", "digest", "n_shingles").join(named, "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
                    .otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near copies the
    document of the smallest id, and of repeated rows of an id one."""
    found = written(near_duplicates(docs, id_col, text_col, k, percent), "near")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct()
    again = (found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
             .select(F.col("doc_id").alias("_gone_id")))
    key = F.col(id_col).cast("long")
    kept = _without(docs, key, gone)
    if again.limit(1).count() == 0:
        return kept
    once = docs.join(again, key == again["_gone_id"], "left_semi").dropDuplicates([id_col])
    return _without(kept, key, again).unionByName(once)


def _without(docs: DataFrame, key, ids: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """``docs`` without ``ids``, which are counted first and broadcast up to ``max_rows`` of them."""
    ids = written(ids, "gone")
    if ids.limit(max_rows + 1).count() <= max_rows:
        ids = F.broadcast(ids)
    return docs.join(ids, key == ids["_gone_id"], "left_anti")
