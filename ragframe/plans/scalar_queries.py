"""Registered scalar / filter / validation queries (X*, F*, K3, K4, K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.text import (code_blocks, file_id_from_path, marker,
                                     sanitise_ascii, sanitise_unicode, section_markers,
                                     description_lines, basename)
from ragframe.functions.tokens import WORD_PATTERN, chars4, words
from ragframe.functions.vectors import parse_vector, vector_to_text
from ragframe.operators.collection import (append_registry, columns_to_rows, fold_extras, load_registry, rows_to_columns,
                                           stable_id)
from ragframe.operators.partitioning import spread
from ragframe.operators.validation import collection_status, question_status, upload_status
from ragframe.plans.chat import vector_collection
from ragframe.plans.registry import register
from ragframe.plans.section_queries import RULE_LEN, _paras_sql
from ragframe.operators.sections import kept_paragraphs
from ragframe.session import scratch_path
from ragframe.sources.tables import load_table

DIM = 64


@register("sanitise_unicode", r"""
SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g') AS name FROM documents
""")
def q_sanitise_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep letters, numbers and '_' (Python isalnum) over whole texts."""
    d = spread(load_table(spark, "documents", sf_dir))
    return d.select("doc_id", sanitise_unicode(F.col("text")).alias("name"))


@register("sanitise_ascii", r"""
SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9_]', '', 'g') AS name FROM documents
""")
def q_sanitise_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII collection-name sanitiser over whole texts."""
    d = spread(load_table(spark, "documents", sf_dir))
    return d.select("doc_id", sanitise_ascii(F.col("text")).alias("name"))


@register("token_counts", f"""
SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS chars4,
       CAST(len(regexp_extract_all(text, '{WORD_PATTERN}')) AS BIGINT) AS words
FROM documents
""")
def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two built-in token counters."""
    d = spread(load_table(spark, "documents", sf_dir))
    return d.select("doc_id", chars4(F.col("text")).alias("chars4"), words(F.col("text")).alias("words"))


@register("file_id_from_path", r"""
WITH b AS (SELECT page_id, url, regexp_extract(url, '[^/]*$', 0) AS base FROM pages)
SELECT page_id, base AS filename,
       CASE WHEN regexp_matches(base, '^\.*[^.].*\.[^.]*$')
            THEN regexp_extract(base, '^(.*)\.[^.]*$', 1) ELSE base END AS file_id
FROM b
""")
def q_file_id_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base name without the last extension (splitext rules)."""
    p = load_table(spark, "pages", sf_dir)
    return p.select("page_id", basename(F.col("url")).alias("filename"),
                    file_id_from_path(F.col("url")).alias("file_id"))


@register("upload_registry", r"""
WITH b AS (SELECT page_id, regexp_extract(url, '[^/]*$', 0) || CASE WHEN length(html) % 2 = 0 THEN '.docx' ELSE '' END AS filename,
                  html FROM pages)
SELECT page_id, filename,
       CASE WHEN ends_with(filename, '.docx') THEN 'ok' ELSE 'not_a_word_document' END AS status,
       CASE WHEN ends_with(filename, '.docx') THEN sha256(html) END AS file_uuid,
       CASE WHEN ends_with(filename, '.docx') THEN 'wordDoc/' || sha256(html) || '.docx' END AS storage_path
FROM b
""")
def q_upload_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 + X6 + K7: only '.docx' uploads are registered, under a
    content-addressed name; others are quarantined. Pages of even length are
    named as Word files. The batch is appended twice, as on a retry, and what
    the registry then holds is joined to the uploads."""
    name = F.concat(basename(F.col("url")), F.when(F.length("html") % 2 == 0, ".docx").otherwise(""))
    p = load_table(spark, "pages", sf_dir).select("page_id", name.alias("filename"), F.sha2("html", 256).alias("uid"))
    p = p.withColumn("status", upload_status(F.col("filename")))
    accepted = p.where("status = 'ok'").select(F.col("uid").alias("file_uuid"), "filename", F.concat(
        F.lit("wordDoc/"), F.col("uid"), F.lit(".docx")).alias("storage_path"))
    path = scratch_path(spark, "registry")
    for _ in range(2):
        append_registry(accepted, path)
    stored = load_registry(spark, path).select("file_uuid", "storage_path")
    return p.join(stored, (p["uid"] == stored["file_uuid"]) & (p["status"] == "ok"), "left").select(
        "page_id", "filename", "status", "file_uuid", "storage_path")


def _answers(spark, sf_dir) -> DataFrame:
    """Model-style answers derived from documents: a fenced python block
    listing the markers of short paragraphs (the stand-in boundary model)."""
    d = spread(load_table(spark, "documents", sf_dir))
    paras = F.transform(kept_paragraphs(F.col("text")), lambda x, i: F.struct(i.alias("m"), x["text"].alias("t")))
    picked = F.filter(paras, lambda p: (p["m"] == 0) | (F.length(p["t"]) < RULE_LEN))
    items = F.transform(picked, lambda p: F.concat(F.lit("'"), marker(p["m"]), F.lit("'")))
    ans = F.concat(F.lit("Sections below.\n```python\nsections = ["), F.array_join(items, ", "),
                   F.lit("]\n```\nDone."))
    return d.select("doc_id", ans.alias("answer"))


_ANSWERS_SQL = "WITH " + _paras_sql(True) + f""",
pick AS (SELECT doc_id, string_agg('''' || '【' || marker_no || '†source】' || '''', ', ' ORDER BY marker_no) AS items
         FROM kept WHERE marker_no = 0 OR length(text) < {RULE_LEN} GROUP BY doc_id),
ans AS (SELECT d.doc_id, 'Sections below.' || chr(10) || '```python' || chr(10) || 'sections = ['
               || coalesce(p.items, '') || ']' || chr(10) || '```' || chr(10) || 'Done.' AS answer
        FROM documents d LEFT JOIN pick p USING (doc_id))"""


@register("section_markers", _ANSWERS_SQL + r""",
blk AS (SELECT doc_id, regexp_extract_all(answer, '``` ?[Pp]ython\n(?s:.+?)\n```') AS blocks FROM ans),
cln AS (SELECT doc_id, list_transform(blocks, lambda b: regexp_replace(regexp_replace(b, '^[` \n]+|[` \n]+$', '', 'g'), '^(?i:python)[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]*', '')) AS c FROM blk),
sec AS (SELECT doc_id, list_filter(c, lambda b: starts_with(b, 'sections')) AS s FROM cln)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_blocks,
       CAST(len(regexp_extract_all(s[-1], '【(\d+)†source】', 1)) AS BIGINT) AS n_markers,
       array_to_string(regexp_extract_all(s[-1], '【(\d+)†source】', 1), ',') AS markers
FROM sec
""")
def q_section_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 + X9 + X10 over one answer per document: fenced blocks, cleanup,
    last 'sections' block wins, marker numbers without eval."""
    a = _answers(spark, sf_dir)
    ms = section_markers(F.col("answer"))
    blocks = F.transform(code_blocks(F.col("answer")), lambda b: b)
    return a.select("doc_id",
                    F.size(F.filter(blocks, lambda b: F.regexp_replace(b, r"^[` \n]+", "").startswith("python")
                                    | F.regexp_replace(b, r"^[` \n]+", "").startswith("Python"))).cast("long").alias("n_blocks"),
                    F.size(ms).cast("long").alias("n_markers"),
                    F.array_join(F.transform(ms, lambda x: x.cast("string")), ",").alias("markers"))


@register("parse_descriptions", r"""
WITH a AS (SELECT p_partkey, p_name || ': ' || p_type || chr(10) || p_brand || ': ' || p_size || ': '
                  || p_partkey || chr(10) || p_type AS answer FROM part),
l AS (SELECT p_partkey, string_split(regexp_replace(answer, '^[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]+|[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]+$', '', 'g'), chr(10)) AS lines FROM a),
x AS (SELECT p_partkey, unnest(range(1, len(lines) + 1)) AS i, lines FROM l),
y AS (SELECT p_partkey, i - 1 AS line_no, string_split(lines[i], ': ') AS parts FROM x)
SELECT p_partkey, CAST(line_no AS BIGINT) AS line_no, parts[1] AS column_name,
       CASE WHEN len(parts) >= 2 THEN parts[2] END AS description,
       CASE WHEN len(parts) >= 2 THEN 'ok' ELSE 'no_separator' END AS status
FROM y
""")
def q_parse_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11 + X12: 'name: description' lines -> rows; text after a second
    separator is dropped (reference behaviour); a line without separator is
    quarantined instead of failing."""
    p = load_table(spark, "part", sf_dir)
    ans = F.concat_ws("\n", F.concat_ws(": ", "p_name", "p_type"),
                      F.concat_ws(": ", "p_brand", F.col("p_size").cast("string"),
                                  F.col("p_partkey").cast("string")), "p_type")
    return parse_description_rows(p.select("p_partkey", ans.alias("answer")), "p_partkey")


def parse_description_rows(df: DataFrame, key: str, answer_col: str = "answer") -> DataFrame:
    lines = df.select(key, F.posexplode(description_lines(F.col(answer_col))).alias("line_no", "line"))
    parts = F.split(F.col("line"), ": ", -1)
    ok = F.size(parts) >= 2
    return lines.select(key, F.col("line_no").cast("long").alias("line_no"),
                        F.get(parts, 0).alias("column_name"),
                        F.when(ok, F.get(parts, 1)).alias("description"),
                        F.when(ok, F.lit("ok")).otherwise(F.lit("no_separator")).alias("status"))


@register("validate_questions", """
SELECT c.conv_id, c.turn,
       CASE WHEN c.text IS NULL OR c.text = '' THEN 'missing_question'
            WHEN c.role <> 'user' THEN 'missing_user'
            WHEN d.source IS NULL OR d.source = '' THEN 'missing_file'
            ELSE 'ok' END AS status
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id
""")
def q_validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 over conversation turns as requests: question = text, user = the
    conversation for user turns only, file = the source of the document with
    the conversation's id."""
    c = load_table(spark, "conversations", sf_dir)
    d = load_table(spark, "documents", sf_dir).select("doc_id", "source")
    r = c.join(d, c.conv_id == d.doc_id, "left")
    user = F.when(F.col("role") == "user", F.col("conv_id").cast("string"))
    return r.select("conv_id", "turn", question_status(F.col("text"), user, F.col("source")).alias("status"))


@register("conform_collection", f"""
SELECT e.vec_id AS id,
       CASE WHEN length(d.text) > 30000 THEN 'content_too_long'
            WHEN len(e.embedding) <> {DIM} THEN 'bad_dimension'
            WHEN list_bool_or(list_transform(e.embedding, lambda x: x IS NULL OR isnan(x))) THEN 'bad_vector_value'
            ELSE 'ok' END AS status
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id
""")
def q_conform_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 + V2: schema limits (2000 / 30000 characters) and dimension 64."""
    c = vector_collection(spark, sf_dir)
    return c.select("id", collection_status(F.col("file_id"), F.col("content"), F.col("embedding"),
                                            DIM).alias("status"))


@register("parse_vectors", """
WITH t AS (SELECT vec_id, CAST(CAST(embedding AS VARCHAR) AS FLOAT[]) AS v FROM embeddings)
SELECT vec_id, CAST(len(v) AS BIGINT) AS dim,
       round(list_reduce(list_transform(v, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b), 6) AS vsum
FROM t
""")
def q_parse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector text '[f, f, ...]' -> array<float> round trip."""
    e = load_table(spark, "embeddings", sf_dir)
    v = parse_vector(vector_to_text(F.col("embedding")))
    return e.select("vec_id", F.size(v).cast("long").alias("dim"),
                    F.round(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 6)
                    .alias("vsum"))


@register("auto_ids", """
SELECT label AS file_id, count(*) AS n_rows, count(*) AS n_ids FROM embeddings GROUP BY label
""")
def q_auto_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: ids from xxhash64(file_id, chunk_no) are unique and stable."""
    e = load_table(spark, "embeddings", sf_dir)
    ids = e.select(F.col("label").alias("file_id"), stable_id(F.col("label").cast("string"), F.col("vec_id")).alias("id"))
    return ids.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"))


@register("columns_to_rows", f"""
SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim,
       md5(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',')) AS values_md5
FROM embeddings
""")
def q_columns_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: columnar insert batches (bounded: one file, 100 ids) -> rows, with every
    component (in millionths) of the vector that belongs to the id."""
    e = load_table(spark, "embeddings", sf_dir).withColumn("_batch", (F.col("vec_id") / 100).cast("long"))
    batches = rows_to_columns(e, ["label", "_batch"], "vec_id", ["vec_id", "embedding"])
    rows = columns_to_rows(batches, ["vec_id", "embedding"], keep=["label"])
    millionths = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000000).cast("string"))
    return rows.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.md5(F.array_join(millionths, ",")).alias("values_md5"))


@register("fold_extras", """
SELECT event_id, k AS key, v AS value FROM (
  SELECT event_id, 'event_type' AS k, event_type AS v FROM events
  UNION ALL SELECT event_id, 'value', CAST(value AS VARCHAR) FROM events
  UNION ALL SELECT event_id, 'props', props FROM events) WHERE v IS NOT NULL
""")
def q_fold_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: columns outside the declared schema folded into a string map
    (shown exploded)."""
    ev = load_table(spark, "events", sf_dir)
    f = fold_extras(ev, ["event_id", "ts", "user_id"])
    return f.select("event_id", F.explode("extras").alias("key", "value"))
