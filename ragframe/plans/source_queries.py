"""Registered file-source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators.partitioning import spread
from ragframe.plans.registry import register
from ragframe.sources.docx import docx_paragraphs, text_to_docx
from ragframe.session import scratch_path
from ragframe.sources.files import read_text_files, scan_files, write_files
from ragframe.sources.tables import load_table


@register("docx_paragraphs", """
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS para_idx, parts[i] AS text
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
""")
def q_docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rendered as a Word file (one paragraph per line)
    and parsed back into paragraphs in body order."""
    d = spread(load_table(spark, "documents", sf_dir).select("doc_id", "text"))
    files = d.select("doc_id", text_to_docx(F.col("text")).alias("content"))
    return docx_paragraphs(files, "doc_id", "content")



TOP_FOLDERS = 128     # more than 32: their files are listed by tasks


def _as_files(spark: SparkSession, sf_dir: str, top_folders: int | None = None) -> str:
    """Every document a text file in a folder of its language, some with Windows line ends; the folder.
    With ``top_folders`` the folders of languages are in so many others, by a hash of the id."""
    d = spread(load_table(spark, "documents", sf_dir).select("doc_id", "text", "lang"))
    name = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/doc "), F.col("doc_id").cast("string"), F.lit(" +100%.txt"))
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    if top_folders:
        name = F.concat_ws("/", F.pmod(F.xxhash64("doc_id"), F.lit(top_folders)).cast("string"), name)
    root = scratch_path(spark, "text-files")
    write_files(d.select(name.alias("name"), F.coalesce(text, F.lit("")).alias("content")), root)
    return root


_NAME_SQL = "coalesce(lang, 'none') || '/doc ' || doc_id || ' +100%.txt'"


@register("file_tree", f"""
SELECT {_NAME_SQL} AS relpath,
       CAST(strlen(CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) ELSE coalesce(text, '') END) AS BIGINT) AS length
FROM documents
""")
def q_file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a file; the tree scanned, contents unread."""
    return scan_files(spark, _as_files(spark, sf_dir), "*.txt").select("relpath", "length")


@register("text_files", f"""
SELECT {_NAME_SQL} AS relpath, md5(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5 FROM documents
""")
def q_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a file and read whole, line ends made one."""
    root = _as_files(spark, sf_dir, TOP_FOLDERS)
    files = read_text_files(spark, root)
    return files.select(F.substring_index("path", "/", -2).alias("relpath"), F.md5("text").alias("text_md5"))
