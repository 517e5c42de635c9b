"""Vector search: L2 distance, filtered exact top-k for a whole table of
questions, offset pages, and an IVF approximate search.

Per question, the nearest ``k`` corpus rows with the same filter key. The
distance work runs in a NumPy kernel inside tasks. A task keeps a running best
``k`` over its batches, so it emits at most ``k`` candidates per question
(a group of the blocked form does; never question x candidate rows); Spark then
ranks the candidates. A row or question without a key, or whose vector is not one
of the questions' dimension, takes no part in any engine (``rejected_vectors``
lists them). Rows of one key and id are one row, however often stored:

    small question side (measured):   corpus --mapInPandas(kernel, broadcast questions)-->
    large question side:              corpus(key, s, r) + questions(key, s, r), sorted
                                          --mapInArrow(kernel)-->
                                      -> WindowGroupLimit(partial) -> Exchange(qid)
                                      -> WindowGroupLimit(final) -> row_number <= k

In the large case a histogram of rows per key gives each key its own number of
corpus slices ``s`` and question blocks ``r``: a key holding a third of the corpus
spreads over ``s x r`` groups, a small one is one group and its rows are copied
nowhere. A group's questions (at most ``question_block_bytes``, a hash spreads
them) are held, its corpus rows stream by in Arrow batches. The kernel picks
candidates with the dot-product expansion (tie- and rounding-aware) and
re-ranks them with an exact left-to-right float64 sum, so distances and the
(distance, id) order equal those of ``l2_squared``.

``engine="jvm"`` keeps the plain Spark form (equi-join + higher-order
function distance) for comparison. Wide output fields are fetched after
ranking by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.functions.vectors import is_vector, l2_squared
from ragframe.operators.partitioning import spread
from ragframe.operators.sizing import DEFAULT_BROADCAST_MAX_BYTES, fits_broadcast, measured_rows
from ragframe.session import scratch_path

_CAND_COLS = ["qid", "id", "distance"]
SMALL_GROUP = 64         # corpus rows of a group whose distances are all exact
SMALL_CELLS = 500_000    # components compared at once in such a group


def _cand_schema(corpus: DataFrame, questions: DataFrame, key: str) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"qid {kind(questions, 'qid')}, id {kind(corpus, 'id')}, distance double, `{key}` {kind(corpus, key)}"


def _ids(s: pd.Series) -> np.ndarray:
    """Numbers as 64-bit integers, anything else as strings (which sort by code point, as Spark's do)."""
    return s.to_numpy(dtype=np.int64) if pd.api.types.is_integer_dtype(s) else s.to_numpy().astype(str)


def _column_ids(column: pa.Array) -> np.ndarray:
    """``_ids`` of an Arrow column; where it is null, any value."""
    if pa.types.is_integer(column.type):
        return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.to_pandas().to_numpy().astype(str)


def _frame(columns: dict, **constants) -> pd.DataFrame:
    """Candidates; strings as plain objects, which Arrow takes as one array."""
    n = len(columns["qid"])
    if not n:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in [*columns, *constants]})
    columns = {c: np.asarray(v) for c, v in columns.items()} | {c: np.array([v] * n) for c, v in constants.items()}
    return pd.DataFrame({c: pd.Series(v, dtype=object if v.dtype.kind in "UO" else v.dtype) for c, v in columns.items()})


def rejected_vectors(df: DataFrame, dim: int, *, vec_col: str = "embedding", key: str = "file_id") -> DataFrame:
    """The rows a search leaves out, with ``reject_reason``."""
    return (df.withColumn("reject_reason", F.when(F.col(key).isNull(), "missing_key")
                          .when(F.col(vec_col).isNull(), "missing_vector").when(~is_vector(F.col(vec_col), dim), "bad_vector"))
            .where("reject_reason is not null"))


def nearest(cm: np.ndarray, ids: np.ndarray, qm: np.ndarray, qids: np.ndarray, keep: int,
            q_chunk: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, id, distance): the top ``keep`` corpus rows per question by (exact distance, id).

    cm: corpus vectors (n x d), qm: question vectors (m x d), float64.
    The distances of a small group are all exact, left-to-right float64 sums. In a
    larger one the dot-product expansion gives approximate distances for all pairs of a
    chunk of questions; for each question every row within a small tolerance
    of the keep-th approximate distance is a candidate (so ties and rounding
    never drop a row the exact order would keep), candidates are re-ranked
    with the exact sum, and ties go to the smaller id.
    Memory stays at O(n x q_chunk) plus the candidates."""
    n, m = len(ids), len(qids)
    if n == 0 or m == 0:
        return qids[:0], ids[:0], np.zeros(0)
    ids, first = np.unique(ids, return_index=True)      # by id; a row stored twice is one row
    cm, n = cm[first], len(ids)
    kk = min(keep, n)
    out_q, out_i, out_d = [], [], []
    if n <= SMALL_GROUP:
        step = max(1, SMALL_CELLS // (n * cm.shape[1] or 1))
        for j0 in range(0, m, step):
            diff = cm[None, :, :] - qm[j0:j0 + step, None, :]
            exact = np.add.accumulate(diff * diff, axis=2)[:, :, -1]
            best = np.argsort(exact, axis=1, kind="stable")[:, :kk]
            out_q.append(np.repeat(qids[j0:j0 + step], kk))
            out_i.append(ids[best].ravel())
            out_d.append(np.take_along_axis(exact, best, axis=1).ravel())
        return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_d)
    cn = (cm * cm).sum(1)
    for j0 in range(0, m, q_chunk):
        qb, qi = qm[j0:j0 + q_chunk], qids[j0:j0 + q_chunk]
        qn = (qb * qb).sum(1)
        approx = cn[:, None] - 2.0 * cm @ qb.T + qn[None, :]
        thr = np.partition(approx, kk - 1, axis=0)[kk - 1] if kk < n else approx.max(axis=0)
        tol = 1e-9 * (1.0 + np.abs(thr) + cn.max() + qn)
        for j in range(len(qi)):
            cand = np.flatnonzero(approx[:, j] <= thr[j] + tol[j])
            diff = cm[cand] - qb[j]
            exact = np.add.accumulate(diff * diff, axis=1)[:, -1]
            best = np.argsort(exact, kind="stable")[:kk]
            out_q.append(np.repeat(qi[j:j + 1], len(best)))
            out_i.append(ids[cand][best])
            out_d.append(exact[best])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_d)


def kernel_candidates(cm: np.ndarray, ids: np.ndarray, qm: np.ndarray, qids: np.ndarray,
                      keep: int, q_chunk: int = 256) -> pd.DataFrame:
    """``nearest`` as a frame."""
    return _frame(dict(zip(_CAND_COLS, nearest(cm, ids, qm, qids, keep, q_chunk), strict=True)))


def _matrix(vs) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vs])


def _by_key(keys: pd.Series) -> tuple[np.ndarray, dict]:
    """An order of the rows by key, and each key's part (first, end) of it."""
    codes, names = pd.factorize(keys, use_na_sentinel=False)
    n = np.bincount(codes, minlength=len(names))
    ends = np.cumsum(n)
    return np.argsort(codes, kind="stable"), dict(zip(names.tolist(), zip((ends - n).tolist(), ends.tolist(), strict=True), strict=True))


def _broadcast_candidates(corpus: DataFrame, questions: DataFrame, key: str, keep: int) -> DataFrame:
    """Questions (already measured below the broadcast limit) go to every
    task as one broadcast value; each corpus batch is ranked against the
    questions of its keys."""
    spark = corpus.sparkSession
    qpdf = questions.toPandas()
    order, spans = _by_key(qpdf[key])
    held = (_ids(qpdf["qid"])[order], _matrix(qpdf["qvec"])[order]) if len(qpdf) else None
    bc = spark.sparkContext.broadcast((spans, held))

    def run(batches):
        (of, held), best = bc.value, {}
        for pdf in batches:
            if held is None or not len(pdf):
                continue
            order, spans = _by_key(pdf[key])
            ids, m = _ids(pdf["id"])[order], _matrix(pdf["vec"])[order]
            for kv, (a, b) in spans.items():
                if kv in of:
                    x, y = of[kv]
                    best[kv] = _best(best.get(kv), nearest(m[a:b], ids[a:b], held[1][x:y], held[0][x:y], keep), keep)
        for kvs, columns in _in_bulk(best.items()):
            yield _frame(dict(zip([*_CAND_COLS, key], [*columns, np.array(kvs)], strict=True)))

    return spread(corpus).mapInPandas(run, _cand_schema(corpus, questions, key))


def _in_bulk(found, rows: int = 10_000):
    """(key of each row, columns) of many keys' candidates at once: a frame or a batch for each key would cost more than its ranking."""
    kvs, parts = [], []
    for kv, part in found:
        kvs += [kv] * len(part[0])
        parts.append(part)
        if len(kvs) >= rows:
            yield kvs, [np.concatenate(c) for c in zip(*parts, strict=True)]
            kvs, parts = [], []
    if kvs:
        yield kvs, [np.concatenate(c) for c in zip(*parts, strict=True)]


def _best(before: tuple | None, new: tuple, keep: int) -> tuple:
    """The nearest ``keep`` rows per question of two sets of candidates."""
    if before is None:
        return new
    q, i, d = (np.concatenate(both) for both in zip(before, new, strict=True))
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    change = np.append(True, q[1:] != q[:-1])[:len(q)]
    # a row that both sets hold has one distance, so its two places follow one another
    fresh = change | np.append(True, (i[1:] != i[:-1]) | (d[1:] != d[:-1]))[:len(q)]
    q, i, d, change = q[fresh], i[fresh], d[fresh], change[fresh]
    starts = np.flatnonzero(change)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[place < keep], i[place < keep], d[place < keep]


def block_sizes(corpus: DataFrame, questions: DataFrame, key: str, row_bytes: int, slice_bytes: int,
                question_block_bytes: int, min_slices: int = 1) -> DataFrame:
    """(key, slices, blocks) of every key that both sides hold, from a histogram of
    their rows: a key's corpus is cut into slices and its questions into blocks of
    at most about the given bytes, so a small key is one slice and one block."""
    n_c = corpus.groupBy(key).agg(F.count(F.lit(1)).alias("_n_c"))
    n_q = questions.groupBy(key).agg(F.count(F.lit(1)).alias("_n_q"))
    pieces = lambda n, size: F.ceil(F.col(n) * F.lit(row_bytes) / F.lit(max(size, row_bytes))).cast("int")
    return n_c.join(n_q, key).select(key, F.greatest(pieces("_n_c", slice_bytes), F.lit(min_slices)).alias("_slices"),
                                     pieces("_n_q", question_block_bytes).alias("_blocks"))


def _dealt(corpus: DataFrame, questions: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Rows (key, slice, block, side, qid, id, vec), questions (side 0) and corpus
    (side 1): a corpus row once per block of its key, a question once per slice."""
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    c = (corpus.join(sizes, key).withColumn("_s", spot("id", "_slices")).withColumn("_r", span("_blocks"))
         .select(key, "_s", "_r", F.lit(1).alias("_side"), none(questions, "qid"), "id",
                 F.col("vec").cast("array<double>").alias("vec")))
    q = (questions.join(sizes, key).withColumn("_r", spot("qid", "_blocks")).withColumn("_s", span("_slices"))
         .select(key, "_s", "_r", F.lit(0).alias("_side"), "qid", none(corpus, "id"),
                 F.col("qvec").cast("array<double>").alias("vec")))
    return q.unionByName(c)


def _stream_kernel(keep: int, key: str, schema: pa.Schema):
    """Ranks groups as they stream by, each one's questions first: a task holds
    one block of questions, one Arrow batch and the best ``keep`` per question."""
    def ranked(batches):
        group, qs, best = None, [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            marks = [keys.dictionary_encode().indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("_s", "_r", "_side"))]
            change = np.zeros(n, dtype=bool)
            for m in marks:
                change[1:] |= m[1:] != m[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), n]
            vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            qids, ids = _column_ids(batch.column("qid")), _column_ids(batch.column("id"))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                here = (keys[a].as_py(), int(marks[1][a]), int(marks[2][a]))
                if here != group:
                    if best is not None:
                        yield group[0], best
                    group, qs, best = here, [], None
                if marks[3][a] == 0:
                    qs.append((qids[a:b], vectors[a:b]))
                    continue
                if not qs:      # no question's hash fell into this block
                    continue
                if len(qs) > 1:
                    qs = [(np.concatenate([i for i, _ in qs]), np.concatenate([x for _, x in qs]))]
                best = _best(best, nearest(vectors[a:b], ids[a:b], qs[0][1], qs[0][0], keep), keep)
        if best is not None:
            yield group[0], best

    def run(batches):
        for kvs, found in _in_bulk(ranked(batches)):
            columns = {c: pa.array(x.tolist(), schema.field(c).type) for c, x in zip(_CAND_COLS, found, strict=True)}
            columns[key] = pa.array(kvs, schema.field(key).type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names], schema=schema)
    return run


def _blocked_candidates(corpus: DataFrame, questions: DataFrame, key: str, keep: int, dim: int, min_slices: int,
                        question_block_bytes: int, slice_bytes: int, broadcast_max_bytes: int) -> DataFrame:
    """Shuffle form for a large question side: group (key, s, r) holds slice s of
    the key's corpus and block r of its questions, sized key by key. Rows arrive
    sorted by group, questions first, and are ranked as they stream by."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = corpus.sparkSession
    path = scratch_path(spark, "block-sizes")
    block_sizes(corpus, questions, key, 64 + 8 * dim, slice_bytes, question_block_bytes, min_slices).write.parquet(path)
    sizes = spark.read.parquet(path)
    if fits_broadcast(sizes, 128, max_bytes=broadcast_max_bytes):
        sizes = F.broadcast(sizes)
    schema = T.StructType.fromDDL(_cand_schema(corpus, questions, key))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return (_dealt(corpus, questions, sizes, key).repartition(n, key, "_s", "_r")
            .sortWithinPartitions(key, "_s", "_r", "_side")
            .mapInArrow(_stream_kernel(keep, key, to_arrow_schema(schema)), schema))


def _jvm_candidates(corpus: DataFrame, questions: DataFrame, key: str, small: bool,
                    salt: int) -> DataFrame:
    """Plain Spark form: equi-join on the key, distance by higher-order
    functions (materialises question x candidate rows)."""
    if small:
        pairs = spread(corpus).join(F.broadcast(questions), key)
    else:
        q = questions.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        c = corpus.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int"))
        pairs = c.join(q, [key, "_salt"])
    return pairs.select("qid", "id", l2_squared(F.col("vec"), F.col("qvec")).alias("distance"), key)


# Questions of a group, which a task holds, and corpus rows of a group, which stream by.
DEFAULT_QUESTION_BLOCK_BYTES = 32 * 1024 * 1024
DEFAULT_SLICE_BYTES = 256 * 1024 * 1024


def _candidates(c: DataFrame, q: DataFrame, key: str, keep: int, engine: str, salt: int,
                broadcast_max_bytes: int, question_block_bytes: int = DEFAULT_QUESTION_BLOCK_BYTES,
                slice_bytes: int = DEFAULT_SLICE_BYTES) -> tuple[DataFrame, int]:
    """Candidates (qid, id, distance, key) from one of the engines, and the
    measured number of questions (which bounds every later result)."""
    q = q.where(F.col(key).isNotNull() & F.col("qid").isNotNull())
    n_q, dim = measured_rows(q, "qvec")
    q = q.where(is_vector(F.col("qvec"), dim))
    c = c.where(F.col(key).isNotNull() & F.col("id").isNotNull() & is_vector(F.col("vec"), dim))
    q_bytes = n_q * (64 + 8 * max(dim, 1))
    small = q_bytes <= broadcast_max_bytes
    if engine == "jvm":
        return _jvm_candidates(c, q, key, small, salt), n_q
    if small:
        return _broadcast_candidates(c, q, key, keep), n_q
    return _blocked_candidates(c, q, key, keep, dim, salt, question_block_bytes, slice_bytes, broadcast_max_bytes), n_q


def _rank(scored: DataFrame, k: int, offset: int) -> DataFrame:
    # a row that several tasks held has one rank, and one row of it stays
    w = Window.partitionBy("qid").orderBy("distance", "id")
    ranked = scored.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= offset + k)
    if offset:
        ranked = ranked.filter(F.col("rank") > offset)
    return ranked.dropDuplicates(["qid", "rank"]).withColumn("rank", (F.col("rank") - offset).cast("long"))


def _fetch(ranked: DataFrame, fields: DataFrame, keys: list[str], n_ranked_max: int, broadcast_max_bytes: int) -> DataFrame:
    """Attach wide output fields to the (at most ``n_ranked_max``) ranked rows
    by key and id, broadcasting the ranked rows when that bound is small enough."""
    if n_ranked_max * 40 <= broadcast_max_bytes:
        ranked = F.broadcast(ranked)
    return fields.join(ranked, keys).dropDuplicates(["qid", "rank"])


def topk(corpus: DataFrame, questions: DataFrame, k: int = 10, *, key: str = "file_id",
         offset: int = 0, where: Column | None = None,
         output_fields: list[str] | None = None,
         id_col: str = "id", vec_col: str = "embedding",
         qid_col: str = "qid", qvec_col: str = "embedding",
         broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
         salt: int = 1, engine: str = "auto",
         question_block_bytes: int = DEFAULT_QUESTION_BLOCK_BYTES,
         fields: DataFrame | None = None) -> DataFrame:
    """Filtered exact top-k by L2 for every question.

    corpus: rows with ``id_col``, ``key``, ``vec_col`` and output fields.
    questions: rows with ``qid_col``, ``key``, ``qvec_col``.
    where: optional predicate on the corpus, applied before ranking (pushed
    into the scan by Catalyst when it is a plain comparison).
    engine: "auto" (NumPy kernel, broadcast or blocked by measured size) or
    "jvm" (join + higher-order functions).
    salt: least number of corpus slices of a key in the shuffle form (also that
    of the join's salt in the "jvm" engine).
    fields: optional table (``id`` + ``output_fields``) to fetch output
    fields from, when they live outside the vector table.
    Returns ``qid, rank (1-based), id, distance`` plus ``output_fields``.
    Ties are broken by id so the result is deterministic.
    """
    if where is not None:
        corpus = corpus.filter(where)
    c = corpus.select(F.col(id_col).alias("id"), F.col(key).alias(key), F.col(vec_col).alias("vec"))
    q = questions.select(F.col(qid_col).alias("qid"), F.col(key).alias(key),
                         F.col(qvec_col).alias("qvec"))
    scored, n_q = _candidates(c, q, key, offset + k, engine, salt,
                              broadcast_max_bytes, question_block_bytes)
    ranked = _rank(scored, k, offset)
    if not output_fields:
        return ranked.drop(key)
    # an id may be of use in one file only: the key is part of it where the fields have it
    keys = ["id"] if fields is not None and key not in fields.columns else ["id", key]
    src = (fields if fields is not None else corpus.withColumn("id", F.col(id_col))).select(
        *keys, *[c for c in output_fields if c not in keys])
    out = _fetch(ranked if key in keys else ranked.drop(key), src, keys, n_q * k, broadcast_max_bytes)
    return out.select("qid", "rank", "id", "distance", *[c for c in output_fields if c != "id"])


def topk_single(corpus: DataFrame, vector: list[float], k: int = 10, *,
                where: Column | None = None, output_fields: list[str] | None = None,
                id_col: str = "id", vec_col: str = "embedding", offset: int = 0) -> DataFrame:
    """One query vector: filter -> distance -> ordered limit (TakeOrderedAndProject)."""
    if where is not None:
        corpus = corpus.filter(where)
    qv = F.array(*[F.lit(float(x)).cast("float") for x in vector])
    good = corpus.where(is_vector(F.col(vec_col), len(vector)))
    scored = good.withColumn("distance", l2_squared(F.col(vec_col), qv))
    out = scored.orderBy("distance", id_col)
    if offset:
        out = out.offset(offset)
    cols = [id_col, "distance"] + list(output_fields or [])
    return out.limit(k).select(*cols)


# ---------------------------------------------------------------------------
# Approximate search: inverted-file index built with k-means cells.
# ---------------------------------------------------------------------------

def build_ivf(corpus: DataFrame, n_cells: int, *, vec_col: str = "embedding",
              seed: int = 7, max_iter: int = 20, train_fraction: float = 1.0):
    """Fit k-means cell centroids with pyspark.ml (distributed; at scale train
    on a fraction of the corpus, as IVF indexes usually do) and assign every
    corpus row to its nearest cell. Returns ``(centroids, assigned)`` where
    ``centroids`` is a list of ``n_cells`` vectors (size n_cells x dim, fixed by
    the caller) and ``assigned`` is the corpus plus an int ``cell``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = corpus.withColumn("_features", array_to_vector(F.col(vec_col)))
    train = feats if train_fraction >= 1.0 else feats.sample(fraction=train_fraction, seed=seed)
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol="cell").fit(train)
    assigned = model.transform(feats).drop("_features").withColumn("cell", F.col("cell").cast("int"))
    centroids = [[float(x) for x in c] for c in model.clusterCenters()]
    return centroids, assigned


def nearest_cells(spark, centroids: list[list[float]], nprobe: int):
    """Arrow-batched UDF: vector -> ids of the ``nprobe`` nearest cells.
    The centroid matrix (n_cells x dim, a parameter) is a broadcast value."""
    bc = spark.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    n = int(nprobe)

    @F.pandas_udf("array<int>")
    def _probe(vs: pd.Series) -> pd.Series:
        cm = bc.value
        x = np.stack([np.asarray(v, dtype=np.float64) for v in vs]) if len(vs) else \
            np.zeros((0, cm.shape[1]))
        d = (x * x).sum(1)[:, None] - 2.0 * x @ cm.T + (cm * cm).sum(1)[None, :]
        idx = np.argsort(d, axis=1, kind="stable")[:, :n]
        return pd.Series([r.astype("int32").tolist() for r in idx])

    return _probe


def topk_ivf(assigned: DataFrame, centroids: list[list[float]], questions: DataFrame,
             k: int = 10, nprobe: int = 10, *, key: str | None = "file_id",
             output_fields=None, id_col: str = "id", vec_col: str = "embedding",
             qid_col: str = "qid", qvec_col: str = "embedding",
             broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES, salt: int = 1,
             engine: str = "auto",
             question_block_bytes: int = DEFAULT_QUESTION_BLOCK_BYTES) -> DataFrame:
    """Probe the ``nprobe`` nearest cells of each question and rank exactly
    inside them (candidates are the probed cells only). With ``nprobe`` equal
    to the number of cells the result equals the exact search."""
    spark = questions.sparkSession
    probe = nearest_cells(spark, centroids, min(nprobe, len(centroids)))
    ckey = (F.concat_ws("|", F.col("cell").cast("string"), F.col(key)) if key
            else F.col("cell").cast("string"))
    q = (questions.select(F.col(qid_col).alias("qid"), *([F.col(key)] if key else []),
                          F.col(qvec_col).alias("qvec"))
         .withColumn("cell", F.explode_outer(probe(F.col("qvec"))))
         .filter(F.col("cell").isNotNull())
         .select("qid", ckey.alias("_ck"), "qvec"))
    c = assigned.select(F.col(id_col).alias("id"), ckey.alias("_ck"), F.col(vec_col).alias("vec"))
    scored, n_q = _candidates(c, q, "_ck", k, engine, salt, broadcast_max_bytes,
                              question_block_bytes)
    ranked = _rank(scored, k, 0)
    if not output_fields:
        return ranked.drop("_ck")
    fields = assigned.select(F.col(id_col).alias("id"), ckey.alias("_ck"), *output_fields)
    return _fetch(ranked, fields, ["id", "_ck"], n_q * k, broadcast_max_bytes).select(
        "qid", "rank", "id", "distance", *output_fields)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Fraction of exact (qid, id) hits found by the approximate search."""
    hit = exact.select("qid", "id").join(approx.select("qid", "id").withColumn("_h", F.lit(1)),
                                         ["qid", "id"], "left")
    return hit.agg((F.sum(F.coalesce("_h", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
