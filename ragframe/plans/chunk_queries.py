"""Registered chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.text import NEWLINE_PATTERN, sentence_units
from ragframe.operators.chunking import (OVERLAP_PERCENTAGE, char_pieces, chunk_counts,
                                         chunk_documents, word_pieces)
from ragframe.operators.partitioning import spread
from ragframe.plans.registry import register
from ragframe.plans.sqlgen import chunks_sql, fold_sql, heads_sql, leaves_sql, sentence_units_sql, tok
from ragframe.sources.tables import load_table

# Query parameters (fixed for every run): token limit 100 with the
# reference's derived limits (words = limit, chars = 4 x limit), chars4 tokens.
LIMIT = 100
WORDS = LIMIT
CHARS = 4 * LIMIT
OV_LIMIT = int(LIMIT * OVERLAP_PERCENTAGE)


def _docs(spark, sf_dir):
    return load_table(spark, "documents", sf_dir).select("doc_id", "text")


_SENT_SQL = ("WITH RECURSIVE" + leaves_sql("documents", ["doc_id"], "text", LIMIT, WORDS, CHARS, "",
                                          units="sentence")
             + "," + fold_sql(["doc_id"], LIMIT, "") + "," + chunks_sql(["doc_id"], ""))


@register("chunk_documents", _SENT_SQL + f"""
SELECT doc_id, chunk_no, chunk, {tok('chunk')} AS n_tokens FROM chunks
""")
def q_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units -> greedy packing with word/char fallback (Z4 without
    overlap). The oracle rebuilds the look-behind splitter from per-character
    facts (SQL engines without look-behind)."""
    return chunk_documents(_docs(spark, sf_dir), limit=LIMIT)


@register("chunk_overlap", _SENT_SQL + ","
          + leaves_sql("chunks", ["doc_id", "chunk_no"], "chunk", OV_LIMIT, WORDS, CHARS, "h_",
                       units="sentence")
          + "," + heads_sql(["doc_id", "chunk_no"], OV_LIMIT, "h_") + f"""
SELECT c.doc_id, c.chunk_no, c.chunk || coalesce(h.head, '') AS chunk,
       {tok("c.chunk || coalesce(h.head, '')")} AS n_tokens
FROM chunks c LEFT JOIN h_head h ON h.doc_id = c.doc_id AND h.chunk_no = c.chunk_no + 1
""")
def q_chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence chunks with 34 % forward overlap."""
    return chunk_documents(_docs(spark, sf_dir), limit=LIMIT, overlap=OVERLAP_PERCENTAGE)


@register("sentence_units", "WITH " + sentence_units_sql("documents", ["doc_id"], "text", "") + """
SELECT doc_id, count(*) AS n_units, md5(string_agg(t, chr(57345) ORDER BY ui)) AS units_md5,
       md5(string_agg(t, '' ORDER BY ui)) AS text_md5
FROM u GROUP BY doc_id
""")
def q_sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit boundaries (units joined by U+E001) and lossless
    reassembly (units concatenate to the text)."""
    d = spread(_docs(spark, sf_dir))
    u = d.select("doc_id", sentence_units(F.col("text")).alias("u"))
    return u.select("doc_id", F.size("u").cast("long").alias("n_units"),
                    F.md5(F.array_join(F.col("u"), "\ue001")).alias("units_md5"),
                    F.md5(F.array_join(F.col("u"), "")).alias("text_md5"))


@register("word_pieces", f"""
WITH w0 AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
w1 AS (SELECT doc_id, ws, unnest(range(0, len(ws), {WORDS})) AS s FROM w0)
SELECT doc_id, CAST(s // {WORDS} AS BIGINT) AS piece_no,
       CASE WHEN s = 0 THEN '' ELSE ' ' END || array_to_string(ws[s + 1 : s + {WORDS}], ' ') AS piece
FROM w1
""")
def q_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 over whole documents."""
    d = spread(_docs(spark, sf_dir))
    return (d.select("doc_id", F.posexplode_outer(word_pieces(F.col("text"), WORDS))
                     .alias("piece_no", "piece"))
            .withColumn("piece_no", F.col("piece_no").cast("long")))


@register("char_pieces", f"""
WITH c0 AS (SELECT doc_id, text, unnest(range(0, length(text), {CHARS})) AS s FROM documents)
SELECT doc_id, CAST(s // {CHARS} AS BIGINT) AS piece_no, substr(text, s + 1, {CHARS}) AS piece
FROM c0
""")
def q_char_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 over whole documents."""
    d = spread(_docs(spark, sf_dir))
    return (d.select("doc_id", F.posexplode_outer(char_pieces(F.col("text"), CHARS))
                     .alias("piece_no", "piece"))
            .filter(F.col("piece_no").isNotNull())
            .withColumn("piece_no", F.col("piece_no").cast("long")))


_LINES_SQL = ("WITH RECURSIVE" + leaves_sql("documents", ["doc_id"], "text", LIMIT, WORDS, CHARS, "")
              + "," + fold_sql(["doc_id"], LIMIT, "") + "," + chunks_sql(["doc_id"], ""))


@register("chunk_lines", _LINES_SQL + f"""
SELECT doc_id, chunk_no, chunk, {tok('chunk')} AS n_tokens FROM chunks
""")
def q_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + C5 with newline units: greedy packing, word and char fallback."""
    return chunk_documents(_docs(spark, sf_dir), limit=LIMIT, pattern=NEWLINE_PATTERN)


@register("chunk_counts", _LINES_SQL + """
SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id
""")
def q_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of chunks per document."""
    return chunk_counts(chunk_documents(_docs(spark, sf_dir), limit=LIMIT,
                                        pattern=NEWLINE_PATTERN))


@register("chunk_lines_overlap", _LINES_SQL + ","
          + leaves_sql("chunks", ["doc_id", "chunk_no"], "chunk", OV_LIMIT, WORDS, CHARS, "h_")
          + "," + heads_sql(["doc_id", "chunk_no"], OV_LIMIT, "h_") + f"""
SELECT c.doc_id, c.chunk_no, c.chunk || coalesce(h.head, '') AS chunk,
       {tok("c.chunk || coalesce(h.head, '')")} AS n_tokens
FROM chunks c LEFT JOIN h_head h ON h.doc_id = c.doc_id AND h.chunk_no = c.chunk_no + 1
""")
def q_chunk_lines_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 with newline units: each chunk is extended by the first piece of
    the next chunk re-packed with limit int(100 * 0.34)."""
    return chunk_documents(_docs(spark, sf_dir), limit=LIMIT, pattern=NEWLINE_PATTERN,
                           overlap=OVERLAP_PERCENTAGE)
