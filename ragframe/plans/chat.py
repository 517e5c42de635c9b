"""Chat pipeline over a whole table of questions: validate -> search the
question's file -> pack a token-budgeted context -> prompt -> model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.tokens import chars4
from ragframe.operators.context import DEFAULT_BUDGET, build_prompts, context_pack
from ragframe.operators.model import apply_model, echo_user
from ragframe.operators.search import topk
from ragframe.plans.registry import register
from ragframe.sources.tables import load_table


def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection rows from the test tables: ``embeddings`` gives the vectors,
    ``label`` acts as file id, the document with ``doc_id = vec_id`` gives
    the content, and tokens are counted on the content."""
    emb = load_table(spark, "embeddings", sf_dir)
    docs = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    return (emb.join(docs, emb.vec_id == docs.doc_id)
            .select(F.col("vec_id").alias("id"),
                    F.col("label").cast("string").alias("file_id"),
                    "embedding",
                    F.col("text").alias("content"),
                    chars4(F.col("text")).alias("num_tokens")))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding row is a question against its own file."""
    emb = load_table(spark, "embeddings", sf_dir)
    docs = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    return (emb.join(docs, emb.vec_id == docs.doc_id, "left")
            .select(F.col("vec_id").alias("qid"),
                    F.col("label").cast("string").alias("file_id"),
                    "embedding",
                    F.coalesce(F.col("text"), F.lit("")).alias("question")))


def chat(corpus: DataFrame, questions: DataFrame, *, k: int = 10, budget: int = DEFAULT_BUDGET,
         model=echo_user, fields: DataFrame | None = None) -> DataFrame:
    """questions(qid, file_id, embedding, question) -> per question: chunk
    count, context tokens, prompt and model answer. ``fields`` (id, content,
    num_tokens) is where content is fetched from when the vector table does
    not carry it."""
    contents = corpus if fields is None else fields
    # an id may be of use in one file only
    file = [c for c in ("file_id",) if c in contents.columns]
    ranked = topk(corpus, questions, k, key="file_id", output_fields=["num_tokens", *file], fields=fields)
    packed = context_pack(ranked, questions.select("qid"), budget=budget, contents=contents, id_cols=("id", *file))
    prompts = build_prompts(packed.join(questions.select("qid", "file_id", "question"), "qid"))
    return apply_model(prompts, model, ["system", "user"], "answer")


CHAT_SQL = r"""
WITH corpus AS (
  SELECT e.vec_id AS id, CAST(e.label AS VARCHAR) AS file_id, e.embedding AS vec,
         d.text AS content, CAST(ceil(length(d.text) / 4.0) AS BIGINT) AS num_tokens
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
q AS (
  SELECT e.vec_id AS qid, CAST(e.label AS VARCHAR) AS file_id, e.embedding AS qv,
         coalesce(d.text, '') AS question
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id),
pairs AS (
  SELECT q.qid, c.id, c.content, c.num_tokens,
         list_reduce(list_transform(range(1, len(c.vec) + 1),
             lambda i: (CAST(c.vec[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE))
                     * (CAST(c.vec[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE))),
             lambda a, b: a + b) AS distance
  FROM q JOIN corpus c ON c.file_id = q.file_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rnk FROM pairs
  QUALIFY rnk <= 10),
kept AS (
  SELECT *, sum(num_tokens) OVER (PARTITION BY qid ORDER BY rnk
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM ranked),
ctx AS (
  SELECT qid, count(*) AS n_chunks, sum(num_tokens) AS ctx_tokens,
         string_agg(content || chr(10), '' ORDER BY rnk) AS context
  FROM kept WHERE run < 10000 GROUP BY qid),
p AS (
  SELECT q.qid, q.file_id, CAST(coalesce(ctx.n_chunks, 0) AS BIGINT) AS n_chunks,
         CAST(coalesce(ctx.ctx_tokens, 0) AS BIGINT) AS ctx_tokens,
         '{sp}' || coalesce(ctx.context, '') || '{ss}' AS system,
         '{up}' || q.question AS "user"
  FROM q LEFT JOIN ctx ON q.qid = ctx.qid)
SELECT qid, file_id, n_chunks, ctx_tokens, md5(system) AS system_md5,
       md5("user") AS user_md5, md5("user") AS answer_md5
FROM p
"""


def _sql_lit(s: str) -> str:
    return s.replace("'", "''").replace("\n", "' || chr(10) || '")


def _chat_sql() -> str:
    from ragframe.operators.context import SYSTEM_PREFIX, SYSTEM_SUFFIX, USER_PREFIX
    return CHAT_SQL.replace("{sp}", _sql_lit(SYSTEM_PREFIX)).replace(
        "{ss}", _sql_lit(SYSTEM_SUFFIX)).replace("{up}", _sql_lit(USER_PREFIX))


@register("pipeline_chat", _chat_sql())
def pipeline_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z2 (flagship): every vector is a question on its own file; top 10 by
    L2, context under 10,000 tokens, grounded prompt, model answer. The search
    reads only (id, file, vector) of vectors that have a document (a semi-join
    on doc_id); content is fetched for the ranked ids only."""
    emb = load_table(spark, "embeddings", sf_dir)
    docs = load_table(spark, "documents", sf_dir)
    vectors = (emb.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
               .select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("file_id"),
                       "embedding"))
    contents = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"),
                           chars4(F.col("text")).alias("num_tokens"))
    out = chat(vectors, vector_questions(spark, sf_dir), fields=contents)
    return out.select("qid", "file_id", "n_chunks", "ctx_tokens",
                      F.md5("system").alias("system_md5"), F.md5("user").alias("user_md5"),
                      F.md5("answer").alias("answer_md5"))
