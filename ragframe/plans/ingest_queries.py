"""Registered embedding / collection / file round-trip queries (E1, E2, K1,
K2, K5, S5, S6, Z1, Z5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.text import sanitise_ascii
from ragframe.functions.tokens import WORD_PATTERN
from ragframe.functions.vectors import parse_vector, vector_to_text
from ragframe.operators.collection import append_conformed, ingest_embedded_csv, load_collection, load_rejected, search_collection
from ragframe.operators.embed import enrich_chunks, hash_buckets
from ragframe.operators.sections import assemble_sections, global_markers
from ragframe.plans.chat import vector_collection
from ragframe.plans.chunk_queries import LIMIT, _LINES_SQL
from ragframe.plans.registry import register
from ragframe.plans.section_queries import _rule, _sections_sql
from ragframe.session import scratch_path
from ragframe.sources.files import read_chunk_csv, read_embedded_csv, write_csv
from ragframe.sources.tables import load_table
from ragframe.operators.chunking import chunk_documents
from ragframe.functions.text import NEWLINE_PATTERN

DIM = 64

_BUCKET = "CAST((('0x' || substr(md5(tok), 1, 8))::UBIGINT % {dim}) AS BIGINT)".format(dim=DIM)


def _embed_stats_sql(src: str, keys: list[str], text: str) -> str:
    k = ", ".join(keys)
    return f"""
tk AS (SELECT {k}, unnest(regexp_extract_all(replace({text}, chr(10), ' '), '{WORD_PATTERN}')) AS tok FROM {src}),
bk AS (SELECT {k}, {_BUCKET} AS bucket, count(*) AS cnt FROM tk GROUP BY ALL),
st AS (SELECT {k}, count(*) AS n_buckets,
              round(CAST(CAST(max(cnt) / sqrt(sum(cnt * cnt)) AS FLOAT) AS DOUBLE), 6) AS max_weight,
              arg_min(bucket, -cnt * 100000 + bucket) AS top_bucket
       FROM bk GROUP BY ALL)"""


def _embed_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Summary of each embedding: non-zero buckets, largest weight and its
    (smallest) bucket."""
    pos = F.filter(F.transform(F.col("embedding"), lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
                   lambda x: x["v"] > 0)
    top = F.array_max(F.transform(pos, lambda x: F.struct(x["v"].alias("v"), (-x["i"]).alias("ni"))))
    return df.select(*keys, "num_tokens",
                     F.size(pos).cast("long").alias("n_buckets"),
                     F.round(F.array_max(F.col("embedding")).cast("double"), 6).alias("max_weight"),
                     (-top["ni"]).cast("long").alias("top_bucket"))


@register("hash_embed", f"""
WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(10), ' '), '{WORD_PATTERN}')) AS tok
            FROM documents)
SELECT doc_id, {_BUCKET} AS bucket, count(*) AS cnt FROM tk GROUP BY ALL
""")
def q_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 (+X3): hashed bag-of-words buckets of whole documents."""
    d = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    return hash_buckets(d, ["doc_id"], "text", DIM)


@register("enrich_chunks", _LINES_SQL + "," + _embed_stats_sql("chunks", ["doc_id", "chunk_no"], "chunk") + """
SELECT c.doc_id, c.chunk_no, CAST(ceil(length(c.chunk) / 4.0) AS BIGINT) AS num_tokens,
       coalesce(st.n_buckets, 0) AS n_buckets, coalesce(st.max_weight, 0.0) AS max_weight, st.top_bucket
FROM chunks c LEFT JOIN st USING (doc_id, chunk_no)
""")
def q_enrich_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line chunks + embedding + token count."""
    d = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    ch = chunk_documents(d, limit=LIMIT, pattern=NEWLINE_PATTERN).withColumnRenamed("chunk", "content")
    e = enrich_chunks(ch.drop("n_tokens"), ["doc_id", "chunk_no"], dim=DIM)
    out = _embed_stats(e, ["doc_id", "chunk_no"])
    return out.withColumn("top_bucket", F.when(F.col("n_buckets") > 0, F.col("top_bucket")))


@register("pipeline_split_doc", _sections_sql(False) + "," + _embed_stats_sql("sections", ["doc_id", "section_no"], "content") + """
SELECT CAST(s.doc_id AS VARCHAR) AS file_id, s.section_no AS chunk_no,
       CAST(ceil(length(s.content) / 4.0) AS BIGINT) AS num_tokens,
       coalesce(st.n_buckets, 0) AS n_buckets, coalesce(st.max_weight, 0.0) AS max_weight, st.top_bucket,
       CASE WHEN length(s.content) <= 30000 THEN 'ok' ELSE 'content_too_long' END AS status
FROM sections s LEFT JOIN st USING (doc_id, section_no)
""")
def q_pipeline_split_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents -> semantic sections -> embed + count -> conform ->
    create-if-missing + append to a Parquet collection and its quarantine ->
    read both back."""
    d = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    secs = assemble_sections(d, _rule)
    rows = secs.select(F.col("doc_id").cast("string").alias("file_id"),
                       F.col("section_no").alias("chunk_no"), "content")
    path = scratch_path(spark, "collection")
    append_conformed(enrich_chunks(rows, ["file_id", "chunk_no"], dim=DIM), path, DIM)
    keys = ["file_id", "chunk_no", "status"]
    out = _embed_stats(load_collection(spark, path).withColumn("status", F.lit("ok")), keys).unionByName(
        _embed_stats(load_rejected(spark, path), keys))
    return out.withColumn("top_bucket", F.when(F.col("n_buckets") > 0, F.col("top_bucket")))


@register("csv_roundtrip", _sections_sql(False) + """,
counts AS (SELECT doc_id, count(*) AS n FROM sections GROUP BY doc_id),
offs AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS off FROM counts)
SELECT CAST(s.doc_id AS VARCHAR) AS documentTitle, '【' || (o.off + s.section_no) || '†source】' AS referenceMarker,
       s.content AS content
FROM sections s JOIN offs o USING (doc_id)
""")
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 + S5: combined section CSV (header, quoted multi-line content)
    written and read back with the third field taken by position."""
    d = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    s = global_markers(assemble_sections(d, _rule))
    out = s.select(F.col("doc_id").cast("string").alias("documentTitle"),
                   F.col("reference_marker").alias("referenceMarker"), "content")
    path = scratch_path(spark, "sections-csv")
    write_csv(out, path)
    back = read_chunk_csv(spark, path)
    return back.select(back.columns[0], back.columns[1], back.columns[2]).toDF(
        "documentTitle", "referenceMarker", "content")


@register("embedded_csv_roundtrip", """
SELECT e.vec_id AS id, md5(d.text) AS content_md5, CAST(len(e.embedding) AS BIGINT) AS dim,
       CAST(ceil(length(d.text) / 4.0) AS BIGINT) AS num_tokens,
       round(list_reduce(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b), 6) AS vsum,
       regexp_replace('emb-' || e.label || '/ed', '[^a-zA-Z0-9_]', '', 'g') AS collection
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id
""")
def q_embedded_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + X15 + X2 (Z5): chunks CSV with vector text and token counts,
    read by header name, vectors parsed, collection names sanitised."""
    c = vector_collection(spark, sf_dir)
    out = c.select("id", F.col("content").alias("chunks"), vector_to_text(F.col("embedding")).alias("embedding"),
                   "num_tokens", F.concat(F.lit("emb-"), F.col("file_id"), F.lit("/ed")).alias("collection"))
    path = scratch_path(spark, "embedded-csv")
    write_csv(out, path)
    back = read_embedded_csv(spark, path)
    v = parse_vector(F.col("embedding"))
    return back.select(F.col("id").cast("long").alias("id"), F.md5("chunks").alias("content_md5"),
                       F.size(v).cast("long").alias("dim"), F.col("num_tokens").cast("long").alias("num_tokens"),
                       F.round(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 6).alias("vsum"),
                       sanitise_ascii(F.col("collection")).alias("collection"))


@register("embedded_csv_ingest", """
WITH c AS (SELECT e.vec_id AS id, d.text, e.embedding, CAST(ceil(length(d.text) / 4.0) AS BIGINT) AS num_tokens, e.label
           FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
judged AS (SELECT *, CASE WHEN id % 10 = 6 THEN 'malformed_record' WHEN id % 10 = 4 THEN 'bad_num_tokens'
                          WHEN length(text) > 30000 THEN 'content_too_long'
                          WHEN id % 10 = 3 THEN 'missing_embedding' WHEN id % 10 = 5 THEN 'bad_dimension' ELSE 'ok' END AS status FROM c)
SELECT CASE WHEN status = 'malformed_record' THEN NULL ELSE 'emb' || label || 'ed' END AS file_id,
       CASE WHEN status <> 'malformed_record' THEN id END AS chunk_no,
       md5(CASE WHEN status = 'malformed_record' THEN CAST(id AS VARCHAR) || ',short' ELSE text END) AS content_md5,
       CASE WHEN status NOT IN ('malformed_record', 'bad_num_tokens') THEN num_tokens END AS num_tokens,
       CASE WHEN status = 'ok' THEN round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b), 6) END AS vsum,
       status
FROM judged
""")
def q_embedded_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV of embedded chunks, some of its vectors, counts and records broken,
    goes to a stored collection and its quarantine; both are read back."""
    c = vector_collection(spark, sf_dir).select("id", F.col("content").alias("chunks"), vector_to_text(F.col("embedding")).alias("embedding"),
                                                F.col("num_tokens").cast("string").alias("num_tokens"),
                                                F.concat(F.lit("emb-"), F.col("file_id"), F.lit("/ed")).alias("collection"))
    last = F.col("id") % 10
    broken = F.when(last == 3, F.lit("[1,x]")).when(last == 5, F.lit("[1,2]")).otherwise(F.col("embedding"))
    path, target = scratch_path(spark, "embedded-csv"), scratch_path(spark, "collection")
    write_csv(c.where("id % 10 <> 6").withColumn("embedding", broken)
              .withColumn("num_tokens", F.when(last == 4, F.lit("many")).otherwise(F.col("num_tokens"))), path)
    write_csv(c.where("id % 10 = 6").select("id", F.lit("short").alias("chunks")), path, mode="append")
    ingest_embedded_csv(spark, path, target, DIM, columns=c.columns)
    out = load_collection(spark, target).withColumn("status", F.lit("ok")).unionByName(load_rejected(spark, target), allowMissingColumns=True)
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return out.select("file_id", "chunk_no", F.md5("content").alias("content_md5"), "num_tokens",
                      F.when(F.col("status") == "ok", F.round(total, 6)).alias("vsum"), "status")


def _vectors_sql() -> str:
    """Dense hashed vectors of the sections in SQL (float, like the embedder)."""
    return f""",
nrm AS (SELECT doc_id, section_no, sqrt(sum(cnt * cnt)) AS norm FROM bk GROUP BY ALL),
grid AS (SELECT s.doc_id, s.section_no, b.b FROM sections s, range(0, {DIM}) b(b)),
vec AS (SELECT g.doc_id, g.section_no,
               list(CASE WHEN n.norm IS NULL THEN CAST(0.0 AS FLOAT)
                         ELSE CAST(coalesce(bk.cnt, 0) / n.norm AS FLOAT) END ORDER BY g.b) AS v
        FROM grid g LEFT JOIN bk ON bk.doc_id = g.doc_id AND bk.section_no = g.section_no AND bk.bucket = g.b
        LEFT JOIN nrm n ON n.doc_id = g.doc_id AND n.section_no = g.section_no
        GROUP BY g.doc_id, g.section_no)"""


@register("collection_search", _sections_sql(False) + "," + _embed_stats_sql("sections", ["doc_id", "section_no"], "content")
          + _vectors_sql() + f""",
ok AS (SELECT v.* FROM vec v JOIN sections s USING (doc_id, section_no) WHERE length(s.content) <= 30000),
pairs AS (SELECT q.doc_id * 100000 + q.section_no AS qid, c.section_no AS id,
                 list_reduce(list_transform(range(1, {DIM} + 1),
                     lambda i: (CAST(c.v[i] AS DOUBLE) - CAST(q.v[i] AS DOUBLE))
                             * (CAST(c.v[i] AS DOUBLE) - CAST(q.v[i] AS DOUBLE))), lambda a, b: a + b) AS distance
          FROM ok q JOIN ok c ON c.doc_id = q.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rnk FROM pairs)
SELECT qid, CAST(rnk AS BIGINT) AS rank, id, round(distance, 6) AS distance, s.content
FROM ranked r JOIN sections s ON s.doc_id = r.qid // 100000 AND s.section_no = r.id WHERE rnk <= 3
""")
def q_collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7 + V5 over a stored collection: the split-doc collection is written,
    then every stored section asks for the 3 nearest sections of its own
    document; only the bucket partitions of the questions' files are read."""
    d = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    rows = assemble_sections(d, _rule).select(F.col("doc_id").cast("string").alias("file_id"),
                                              F.col("section_no").alias("chunk_no"), "content")
    path = scratch_path(spark, "collection")
    append_conformed(enrich_chunks(rows, ["file_id", "chunk_no"], dim=DIM), path, DIM)
    stored = load_collection(spark, path)
    qs = stored.select((F.col("file_id").cast("long") * 100000 + F.col("chunk_no")).alias("qid"),
                       "file_id", "embedding")
    r = search_collection(spark, path, qs, 3, id_col="chunk_no", output_fields=["content"])
    return r.select("qid", "rank", "id", F.round("distance", 6).alias("distance"), "content")


@register("chunk_csv_roundtrip", _LINES_SQL + """
SELECT doc_id, chunk_no, chunk FROM chunks
""")
def q_chunk_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 + S5: the line chunks of every document written as a chunk CSV and
    read back byte for byte (they begin with their separators)."""
    d = load_table(spark, "documents", sf_dir).select("doc_id", "text")
    path = scratch_path(spark, "chunks-csv")
    write_csv(chunk_documents(d, limit=LIMIT, pattern=NEWLINE_PATTERN).select("doc_id", "chunk_no", "chunk"), path)
    back = read_chunk_csv(spark, path).toDF("doc_id", "chunk_no", "chunk")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")
