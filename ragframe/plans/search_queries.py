"""Registered vector-search and context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.vectors import l2_squared
from ragframe.operators.context import context_pack, ordered_concat
from ragframe.operators.model import apply_model, echo_user
from ragframe.operators.ivf import build_index, search_index
from ragframe.operators.lsh import flips, planes, topk_lsh
from ragframe.operators.search import build_ivf, topk, topk_ivf, topk_single
from ragframe.plans.chat import vector_collection, vector_questions
from ragframe.plans.registry import register
from ragframe.session import scratch_path
from ragframe.sources.tables import load_table

K = 10
N_CELLS = 8
PIVOTS, PIVOT_PROBES = 16, 6
TABLES, BITS, PROBES = 8, 3, 3

_DIST = """list_reduce(list_transform(range(1, len(c.vec) + 1),
             lambda i: (CAST(c.vec[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE))
                     * (CAST(c.vec[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE))), lambda a, b: a + b)"""

_RANKED_SQL = f"""
WITH c AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS file_id, embedding AS vec FROM embeddings),
q AS (SELECT vec_id AS qid, CAST(label AS VARCHAR) AS file_id, embedding AS qv FROM embeddings),
pairs AS (SELECT q.qid, c.id, {_DIST} AS distance FROM q JOIN c ON c.file_id = q.file_id),
ranked AS (SELECT qid, id, distance,
                  row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rnk FROM pairs)"""


def _vectors(spark, sf_dir):
    e = load_table(spark, "embeddings", sf_dir)
    corpus = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("file_id"), "embedding")
    qs = e.select(F.col("vec_id").alias("qid"), F.col("label").cast("string").alias("file_id"), "embedding")
    return corpus, qs


def _out(r: DataFrame) -> DataFrame:
    return r.select("qid", "rank", "id", F.round("distance", 6).alias("distance"))


@register("l2_distance", """
WITH a AS (SELECT vec_id, embedding AS vec FROM embeddings), b AS (SELECT vec_id, embedding AS qv FROM embeddings)
SELECT c.vec_id, round(list_reduce(list_transform(range(1, len(c.vec) + 1),
             lambda i: (CAST(c.vec[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE))
                     * (CAST(c.vec[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE))), lambda a, b: a + b), 6) AS distance
FROM a c JOIN b q ON q.vec_id = c.vec_id + 1
""")
def q_l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: squared L2 between consecutive vectors (a 1:1 equi-join)."""
    e = load_table(spark, "embeddings", sf_dir)
    a = e.select("vec_id", F.col("embedding").alias("vec"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("qv"))
    return a.join(b, "vec_id").select("vec_id", F.round(l2_squared(F.col("vec"), F.col("qv")), 6).alias("distance"))


@register("topk_batch", _RANKED_SQL + f"""
SELECT qid, CAST(rnk AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM ranked WHERE rnk <= {K}
""")
def q_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 (+F6, X16): every vector is a question against its own file."""
    corpus, qs = _vectors(spark, sf_dir)
    return _out(topk(corpus, qs, K, key="file_id"))


@register("topk_page", _RANKED_SQL + f"""
SELECT qid, CAST(rnk - {K} AS BIGINT) AS rank, id, round(distance, 6) AS distance
FROM ranked WHERE rnk > {K} AND rnk <= {2 * K}
""")
def q_topk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the second page (offset 10, limit 10)."""
    corpus, qs = _vectors(spark, sf_dir)
    return _out(topk(corpus, qs, K, key="file_id", offset=K))


@register("topk_single", f"""
WITH q AS (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
c AS (SELECT vec_id AS id, embedding AS vec FROM embeddings WHERE CAST(label AS VARCHAR) = '0')
SELECT c.id, round({_DIST}, 6) AS distance, CAST(label AS VARCHAR) AS file_id
FROM c CROSS JOIN q JOIN embeddings e ON e.vec_id = c.id
ORDER BY {_DIST}, c.id LIMIT {K}
""".replace("CAST(label AS VARCHAR) AS file_id\nFROM", "CAST(e.label AS VARCHAR) AS file_id\nFROM"))
def q_topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 + F6 + X16: one question vector (the first row's), predicate
    file_id == '0' applied with the search, nearest 10, projected fields."""
    e = load_table(spark, "embeddings", sf_dir)
    qv = e.orderBy("vec_id").select("embedding").first()[0]   # one vector: dim floats
    # the predicate is on the stored type, so that the scan takes it
    corpus = e.select(F.col("vec_id").alias("id"), F.col("label").alias("file_id"), "embedding")
    r = topk_single(corpus, qv, K, where=F.col("file_id") == 0, output_fields=["file_id"])
    return r.select("id", F.round("distance", 6).alias("distance"), F.col("file_id").cast("string").alias("file_id"))


@register("topk_ivf_full_probe", _RANKED_SQL + f"""
SELECT qid, CAST(rnk AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM ranked WHERE rnk <= {K}
""")
def q_topk_ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 with every cell probed: must equal the exact search."""
    corpus, qs = _vectors(spark, sf_dir)
    cents, assigned = build_ivf(corpus, N_CELLS)
    return _out(topk_ivf(assigned, cents, qs, K, nprobe=N_CELLS, key="file_id"))


@register("topk_ivf")
def q_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: a stored index of 8 fitted cells, built once, searched with its
    calibrated number of probes; only probed cells are read (recall is measured
    against the exact search in tests)."""
    corpus, qs = _vectors(spark, sf_dir)
    index = build_index(corpus, scratch_path(spark, "ivf"), N_CELLS, k=K)
    return _out(search_index(spark, index, qs, K))


@register("topk_ivf_stored", _RANKED_SQL[:_RANKED_SQL.index("pairs AS")] + f"""
pivots AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cell, vec AS qv FROM c QUALIFY row_number() OVER (ORDER BY id) <= {PIVOTS}),
near AS (SELECT c.id, q.cell, row_number() OVER (PARTITION BY c.id ORDER BY {_DIST}, q.cell) AS nth FROM c CROSS JOIN pivots q),
pairs AS (SELECT q.qid, c.id, {_DIST} AS distance FROM q JOIN c ON c.file_id = q.file_id
          JOIN near cn ON cn.id = c.id AND cn.nth = 1
          JOIN near qn ON qn.id = q.qid AND qn.nth <= {PIVOT_PROBES} AND qn.cell = cn.cell),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rnk FROM pairs)
SELECT qid, CAST(rnk AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM ranked WHERE rnk <= {K}
""")
def q_topk_ivf_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: a stored index around given centroids (the 16 first vectors), 6 cells
    probed per question; SQL assigns, probes and ranks the same way."""
    corpus, qs = _vectors(spark, sf_dir)
    pivots = [r[0] for r in corpus.orderBy("id").limit(PIVOTS).select("embedding").collect()]
    index = build_index(corpus, scratch_path(spark, "ivf"), centers=pivots, k=K)
    return _out(search_index(spark, index, qs, K, nprobe=PIVOT_PROBES))


_LSH_DIM = 64       # length of the vectors of ``embeddings``
_PLANES_SQL = ", ".join(f"({t}, {b}, {[float(x) for x in p]})" for t, of in enumerate(planes(_LSH_DIM, TABLES, BITS)) for b, p in enumerate(of))
_MASKS_SQL = ", ".join(f"({i}, {m}, {[(m >> b) & 1 for b in range(BITS)]})" for i, m in enumerate(flips(BITS)))


@register("topk_lsh", _RANKED_SQL[:_RANKED_SQL.index("pairs AS")] + f"""
planes(t, b, p) AS (VALUES {_PLANES_SQL}),
masks(i, mask, uses) AS (VALUES {_MASKS_SQL}),
margins AS (SELECT c.id, t, b, list_reduce(list_transform(range(1, {_LSH_DIM + 1}), lambda i: CAST(c.vec[i] AS DOUBLE) * CAST(p[i] AS DOUBLE)),
                                           lambda x, y: x + y) AS m FROM c CROSS JOIN planes),
codes AS MATERIALIZED (SELECT id, t, sum(CASE WHEN m > 0 THEN 1 << b ELSE 0 END)::BIGINT AS code, list(m * m ORDER BY b) AS costs FROM margins GROUP BY id, t),
looked AS (SELECT id AS qid, t, xor(code, mask) AS code FROM codes CROSS JOIN masks
           QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY list_sum(list_transform(range(1, {BITS + 1}), lambda j: costs[j] * uses[j])), i) <= {PROBES}),
met AS (SELECT DISTINCT qid, id FROM looked JOIN codes USING (t, code)),
pairs AS (SELECT q.qid, c.id, {_DIST} AS distance FROM met JOIN q ON q.qid = met.qid JOIN c ON c.id = met.id AND c.file_id = q.file_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rnk FROM pairs)
SELECT qid, CAST(rnk AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM ranked WHERE rnk <= {K}
""")
def q_topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, hash-table form: 8 tables of 3 random planes, the 3 cheapest buckets of
    each looked into; SQL hashes, probes and ranks the same way."""
    corpus, qs = _vectors(spark, sf_dir)
    return _out(topk_lsh(corpus, qs, K, tables=TABLES, bits=BITS, probes=PROBES))


@register("context_pack", _RANKED_SQL.replace(
    "c AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS file_id, embedding AS vec FROM embeddings)",
    "c AS (SELECT e.vec_id AS id, CAST(e.label AS VARCHAR) AS file_id, e.embedding AS vec, d.text AS content, "
    "CAST(ceil(length(d.text) / 4.0) AS BIGINT) AS num_tokens FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"
).replace("SELECT q.qid, c.id, ", "SELECT q.qid, c.id, c.content, c.num_tokens, ").replace(
    "SELECT qid, id, distance,\n", "SELECT qid, id, content, num_tokens, distance,\n") + f""",
kept AS (SELECT *, sum(num_tokens) OVER (PARTITION BY qid ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS run
         FROM ranked WHERE rnk <= {K}),
ctx AS (SELECT qid, count(*) AS n_chunks, sum(num_tokens) AS ctx_tokens,
               string_agg(content || chr(10), '' ORDER BY rnk) AS context FROM kept WHERE run < 10000 GROUP BY qid)
SELECT q.qid, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks, CAST(coalesce(ctx_tokens, 0) AS BIGINT) AS ctx_tokens,
       md5(coalesce(context, '')) AS context_md5
FROM q LEFT JOIN ctx ON q.qid = ctx.qid
""")
def q_context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: ranked chunks packed under a 10,000-token running total."""
    corpus = vector_collection(spark, sf_dir)
    qs = vector_questions(spark, sf_dir)
    ranked = topk(corpus, qs, K, key="file_id", output_fields=["num_tokens", "file_id"])
    p = context_pack(ranked, qs.select("qid"), contents=corpus, id_cols=("id", "file_id"))
    return p.select("qid", "n_chunks", "ctx_tokens", F.md5("context").alias("context_md5"))


@register("ordered_concat", """
SELECT conv_id, count(*) AS n_turns, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5
FROM conversations GROUP BY conv_id
""")
def q_ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered string concatenation per conversation."""
    c = load_table(spark, "conversations", sf_dir)
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"),
                                    F.md5(ordered_concat("turn", "text", "\n")).alias("text_md5"))


@register("apply_model_echo", """
SELECT conv_id, turn, md5(text) AS answer_md5, CAST(NULL AS VARCHAR) AS error FROM conversations
""")
def q_apply_model_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: a model applied to every prompt in Arrow batches (echo model)."""
    c = load_table(spark, "conversations", sf_dir).select("conv_id", "turn", F.col("text").alias("user"))
    out = apply_model(c, echo_user, ["user"], "answer")
    return out.select("conv_id", "turn", F.md5("answer").alias("answer_md5"), "error")
