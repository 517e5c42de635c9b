"""Registered streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.text import NEWLINE_PATTERN
from ragframe.operators.collection import load_collection, load_rejected
from ragframe.operators.partitioning import spread
from ragframe.plans.chunk_queries import LIMIT, _LINES_SQL
from ragframe.plans.ingest_queries import DIM, _embed_stats, _embed_stats_sql
from ragframe.plans.registry import register
from ragframe.plans.section_queries import _rule, _sections_sql
from ragframe.session import scratch_path
from ragframe.sources.tables import load_table
from ragframe.sources.docx import text_to_docx
from ragframe.sources.files import write_files
from ragframe.streaming.ingest import stream_ingest, stream_word_files
from ragframe.streaming.reassemble import reassemble_stream, to_deltas

N_LANDING_FILES = 4        # at least
LANDING_FOLDERS = 1024     # of Word files: tasks create theirs in different folders, which are listed in parallel


def _landing_files(spark: SparkSession) -> int:
    """Files that the rows land in: enough for every core to write and read some of them, whatever their size."""
    return max(N_LANDING_FILES, 2 * spark.sparkContext.defaultParallelism)


@register("reassemble_stream", """
SELECT conv_id, turn, CAST(len(string_split(text, ' ')) + 1 AS BIGINT) AS n_deltas, md5(text) AS text_md5
FROM conversations
""")
def q_reassemble_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 as a stateful stream: answers arrive as word deltas plus a closing
    null in files, some of them twice; each message is written to a table once
    complete and its state dropped."""
    c = load_table(spark, "conversations", sf_dir)
    landing = scratch_path(spark, "deltas")
    d = to_deltas(c, ["conv_id", "turn"])
    # every fifth part is sent twice
    # dealt by a hash: a round-robin deal would sort all parts first
    d.unionByName(d.where("seq % 5 = 0")).repartition(_landing_files(spark), "conv_id", "turn", "seq").write.parquet(landing)
    out = scratch_path(spark, "reassembled")
    reassemble_stream(spark, landing, "conv_id long, turn long, seq long, delta string, last boolean",
                      ["conv_id", "turn"], scratch_path(spark, "ckpt-reassemble"), out)
    return spark.read.parquet(out).select("conv_id", "turn", "n_deltas", F.md5("text").alias("text_md5"))


@register("stream_ingest", _LINES_SQL + "," + _embed_stats_sql("chunks", ["doc_id", "chunk_no"], "chunk") + """
SELECT CAST(c.doc_id AS VARCHAR) AS file_id, c.chunk_no, CAST(ceil(length(c.chunk) / 4.0) AS BIGINT) AS num_tokens,
       coalesce(st.n_buckets, 0) AS n_buckets, coalesce(st.max_weight, 0.0) AS max_weight, st.top_bucket
FROM chunks c LEFT JOIN st USING (doc_id, chunk_no)
WHERE length(c.chunk) <= 30000
""")
def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents land as files; a stream chunks, enriches and appends
    each micro-batch to the collection (replay-safe); the collection equals
    the batch result."""
    d = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    landing = scratch_path(spark, "landing")
    d.repartition(_landing_files(spark)).write.parquet(landing)
    collection = scratch_path(spark, "stream-collection")
    stream_ingest(spark, landing, "doc_id long, text string", collection,
                  scratch_path(spark, "ckpt-ingest"), limit=LIMIT, pattern=NEWLINE_PATTERN, dim=DIM)
    col = load_collection(spark, collection)
    out = _embed_stats(col, ["file_id", "chunk_no"])
    return out.withColumn("top_bucket", F.when(F.col("n_buckets") > 0, F.col("top_bucket")))


@register("stream_word_files", _sections_sql(False) + """,
good AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, section_no AS chunk_no, md5(content) AS content_md5,
                CASE WHEN length(content) <= 30000 THEN 'ok' ELSE 'content_too_long' END AS status FROM sections WHERE doc_id % 50 <> 7)
SELECT * FROM good
UNION ALL
SELECT CAST(doc_id AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'corrupt_file' FROM documents WHERE doc_id % 50 = 7
""")
def q_stream_word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z1 + T2 + S9: every document lands as a Word file, some of them cut short; a
    binary file stream reads them, cuts them into sections and appends to the
    collection; the corrupt ones are in its quarantine."""
    d = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    name = F.concat_ws("/", F.pmod(F.xxhash64("doc_id"), F.lit(LANDING_FOLDERS)).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".docx")))
    files = spread(d).select(name.alias("name"), "doc_id", text_to_docx(F.col("text")).alias("content"))
    files = files.withColumn("content", F.when(F.col("doc_id") % 50 == 7, F.substring("content", 1, 20)).otherwise(F.col("content")))
    landing, collection = scratch_path(spark, "word-files"), scratch_path(spark, "word-collection")
    write_files(files, landing)
    stream_word_files(spark, landing, collection, scratch_path(spark, "ckpt-word"), dim=DIM, rule=_rule)
    out = load_collection(spark, collection).withColumn("status", F.lit("ok")).unionByName(load_rejected(spark, collection), allowMissingColumns=True)
    return out.select("file_id", "chunk_no", F.md5("content").alias("content_md5"),
                      F.regexp_replace("status", "^corrupt_file: .*", "corrupt_file").alias("status"))
