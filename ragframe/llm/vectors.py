"""Embedding near-dedup by spherical-cap filters.

A filter is the cell of a direction in one of several codes: each code has a
random rotation of its own, cuts the rotated space into blocks, and gives each
block some random words; its directions take one word of each block. A vector
is in the cell of the direction it is closest to, found block by block, so every
vector has a filter in every code, whatever the others are like.

Vectors are joined on their filters and verified by exact cosine in double
precision. The words follow from the number of vectors: about ``BUCKET``
unrelated ones share a filter, at every size. As the rotations are independent,
whether a pair shares its filter depends on its cosine alone and from code to
code by chance; that share is measured for pairs at the threshold, and there are
as many codes as leave a probability of ``MISS`` that such a pair shares none.
Closer pairs are missed more seldom.

Equal vectors are a class (one aggregate). A bucket is dealt into blocks of
bounded size; a pair of blocks gives back sums of links and the edges of a
spanning star per local component, never its pairs. A pair that shares several
filters counts in the smallest of them alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import written
from ragframe.llm.components import connected_components

BUCKET = 32          # unrelated vectors expected in a filter
MISS = 1e-4          # probability that a pair at the threshold shares no filter
CODES = 48           # most codes; coarser cells if more would be needed
CODE = 400           # most words of a block's code
BLOCK = 512          # vectors of a bucket compared with as many others in one task
SEED = 77


def share_of_pairs(dim: int, blocks: int, words: int, threshold: float, pairs: int = 1000, codes: int = 4) -> float:
    """Measured share of the codes in which a pair at the threshold has the same closest direction."""
    rng = np.random.default_rng([SEED, dim, blocks, words])
    x, y = rng.standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * y if dim > 1 else x
    same = 0
    for k in range(codes):
        rotation, cuts, code = product_code(dim, blocks, words, 1_000_000 + k)
        tx, ty = x @ rotation, y @ rotation
        same += np.all([(tx[:, c] @ w.T).argmax(axis=1) == (ty[:, c] @ w.T).argmax(axis=1)
                        for c, w in zip(cuts, code, strict=True)], axis=0).sum()
    return same / (codes * pairs)


@lru_cache(maxsize=64)
def code_shape(n: int, dim: int, threshold: float) -> tuple[int, int, int]:
    """(codes, blocks, words of a block's code) for n vectors."""
    total, blocks = max(1.0, n / BUCKET), 1
    while total ** (1 / blocks) > CODE and 2 * (blocks + 1) <= dim:
        blocks += 1
    words = int(np.ceil(total ** (1 / blocks)))
    while words > 1:
        share = min(share_of_pairs(dim, blocks, words, threshold), 1 - 1e-9)
        codes = int(np.ceil(np.log(MISS) / np.log1p(-share))) if share > 0 else CODES + 1
        if codes <= CODES:
            return codes, blocks, words
        words = max(1, words * 3 // 4)
    return 1, blocks, 1


def product_code(dim: int, blocks: int, words: int, number: int = 0) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The random rotation of a code, the coordinates of each block and its words
    (all of one length, or the longer ones would have the larger cells)."""
    rng = np.random.default_rng([SEED, dim, number])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cuts = np.array_split(np.arange(dim), blocks)
    code = [rng.standard_normal((words, len(c))) for c in cuts]
    return rotation, cuts, [w * np.sqrt(w.shape[1]) / np.linalg.norm(w, axis=1, keepdims=True) for w in code]


def list_decode(unit: np.ndarray, height: float | None, rotation, cuts, code) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of every direction that a row of ``unit`` exceeds; with
    no height, of the closest one (and any as close)."""
    turned = unit @ rotation
    products = [turned[:, c] @ w.T for c, w in zip(cuts, code, strict=True)]
    rest = np.cumsum([p.max(axis=1) for p in products[::-1]], axis=0)[::-1]
    height = np.full(len(unit), height) if height is not None else rest[0] - 1e-9
    row, sums, at = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), dtype=np.int64)
    for i, p in enumerate(products):
        reach = sums[:, None] + p[row]
        beyond = rest[i + 1][row] if i + 1 < len(products) else np.zeros(len(row))
        x, word = np.nonzero(reach >= (height[row] - beyond)[:, None])
        row, sums, at = row[x], reach[x, word], at[x] * p.shape[1] + word
    return row, at


def _filtered(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(rep, copies, vector as bytes, filters as bytes, filters) of every class."""
    schema = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("listed", pa.binary()),
                        ("filters", pa.list_(pa.int64()))])

    def run(batches):
        codes = {}
        for batch in batches:
            vectors = [np.array(v, dtype=float) for v in batch.column("vector").to_pylist()]
            listed: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == dim]
                if dim not in codes:
                    many, blocks, words = code_shape(n, dim, threshold)
                    codes[dim] = [product_code(dim, blocks, words, k) for k in range(many)]
                for s in range(0, len(rows), 64):
                    part = rows[s:s + 64]
                    m = np.array([vectors[i] for i in part])
                    # scaled by the largest component first: no overflow of the squares
                    m /= np.abs(m).max(axis=1, keepdims=True)
                    m /= np.linalg.norm(m, axis=1, keepdims=True)
                    found = [list_decode(m, None, *code) for code in codes[dim]]
                    row = np.concatenate([r for r, _ in found])
                    # the code is part of the filter's number
                    at = np.concatenate([x * CODES + k for k, (_, x) in enumerate(found)])
                    for j, i in enumerate(part):
                        # vectors of another dimension never meet: it is part of the filter's number
                        listed[i] = np.sort(at[row == j]) * 65536 + dim % 65536
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), pa.array([v.tobytes() for v in vectors], pa.binary()),
                 pa.array([x.tobytes() for x in listed], pa.binary()), pa.array(listed, pa.list_(pa.int64()))], schema=schema)

    return classes.select("rep", "copies", "vector").mapInArrow(
        run, "rep long, copies long, vector binary, listed binary, filters array<long>")


def _cosines(vectors: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return m @ m.T


def _stars(link: np.ndarray) -> list[tuple[int, int]]:
    """(smallest, member) of each connected group of the link matrix."""
    free, out = np.ones(len(link), dtype=bool), []
    for start in range(len(link)):
        if not free[start]:
            continue
        free[start] = False
        front = np.array([start])
        while len(front):
            front = np.flatnonzero(link[front].any(axis=0) & free)
            free[front] = False
            out += [(start, x) for x in front.tolist()]
    return out


def _compare(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches):
        for batch in batches:
            for key, i, j, rows in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "rows")), strict=True):
                rows.sort(key=lambda r: r["rep"])
                side = np.array([r["side"] for r in rows])
                link = _cosines([r["vector"] for r in rows]) >= threshold
                np.fill_diagonal(link, False)
                if i != j:  # pairs of one block are another group's
                    link &= side[:, None] != side[None, :]
                if not link.any():
                    continue
                rep = np.array([r["rep"] for r in rows])
                copies = np.array([r["copies"] for r in rows])
                # pairs that share a smaller filter are counted there
                smaller = [x[x < key] for x in (np.frombuffer(r["listed"], dtype=np.int64) for r in rows)]
                holder = np.repeat(np.arange(len(rows)), [len(x) for x in smaller])
                names, at, held = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
                several = held > 1
                table = np.zeros((len(rows), len(names)), dtype=np.float32)
                table[holder, at] = 1
                table = table[:, several]
                own = link & (table @ table.T < 0.5)
                stars = [(rep[x], rep[y], 0) for x, y in _stars(link)]
                sums = own @ copies
                found = stars + [(rep[x], None, int(sums[x])) for x in np.flatnonzero(sums)]
                yield pa.RecordBatch.from_pylist([{"a": int(a), "b": None if b is None else int(b), "links": n}
                                                  for a, b, n in found], schema=schema)
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = 0.95) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or a non-finite component
    link with nothing, as does one with a null id, and those of different
    dimensions never link. Repeated rows of an id and vector are one vector with
    a row each; an id of several vectors is a node of each one's class."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    inf = float("inf")
    good = (F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
            & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf))
            & F.exists("vector", lambda x: x != 0))
    v = v.withColumn("vector", F.when(good, F.transform("vector", lambda x: x + 0.0)))
    usable = v.where("vector is not null")
    classes = written(usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")),
                      "vector-classes")
    listed = written(_filtered(classes, classes.count(), threshold), "filters")
    keyed = listed.select("rep", F.explode("filters").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = (keyed.join(buckets.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
               .join(listed.drop("filters"), "rep")
               .withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    groups = (members.groupBy("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
              .agg(F.collect_list(F.struct("side", "rep", "copies", "vector", "listed")).alias("rows")))
    found = written(groups.mapInArrow(_compare(threshold), "a long, b long, links long"), "vector-links")
    sums = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("b is not null"))
    named = (classes.join(sums, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
             .select("vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    return (v.join(named, "vector", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
