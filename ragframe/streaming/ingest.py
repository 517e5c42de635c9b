"""Incremental ingest. New document files are chunked (texts) or cut into
sections (Word files), enriched and appended to a collection by a Structured Streaming query; each micro-batch
writes its own collection partitions, so a replayed batch (after a failure)
overwrites them instead of duplicating rows."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.text import file_id_from_path
from ragframe.operators.chunking import chunk_documents
from ragframe.operators.collection import _fs, append_conformed, compact, create_if_missing, path_exists
from ragframe.operators.embed import enrich_chunks
from ragframe.operators.numbering import global_offsets
from ragframe.operators.sections import heading_rule, sections_from_rows
from ragframe.session import scratch_path
from ragframe.sources.docx import docx_paragraphs
from ragframe.sources.files import NAMES, list_files, read_contents, task_folder


def ingest_batch(batch: DataFrame, collection: str, *, limit: int, pattern: str, dim: int,
                 batch_id: int | None = None, replace_files: bool = False) -> None:
    ch = chunk_documents(batch, limit=limit, pattern=pattern).select(
        F.col("doc_id").cast("string").alias("file_id"), "chunk_no", F.col("chunk").alias("content"))
    enriched = enrich_chunks(ch, ["file_id", "chunk_no"], dim=dim)
    append_conformed(enriched, collection, dim, batch_id=batch_id, replace_files=replace_files)


def stream_batch_base(checkpoint: str) -> int:
    """Stable per-stream base for batch ids (same after a restart from the
    same checkpoint), so epoch n of this stream always writes batch base + n."""
    import zlib
    return zlib.crc32(checkpoint.rstrip("/").encode("utf-8")) << 24


def stream_ingest(spark: SparkSession, source: str, schema: str, collection: str, checkpoint: str, *,
                  limit: int, pattern: str, dim: int, max_files_per_trigger: int | None = None,
                  replace_files: bool = False, compact_every: int | None = None):
    """File source -> foreachBatch(chunk -> enrich -> conform -> append),
    processed until the input is exhausted (``availableNow``). Micro-batch n
    writes collection batch ``base + n``: a replayed epoch overwrites its own
    partitions only (exactly-once output without rewriting the collection)."""
    create_if_missing(spark, collection)
    base = stream_batch_base(checkpoint)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source)
    return _run(src, checkpoint, collection, compact_every, lambda df, epoch: ingest_batch(
        df, collection, limit=limit, pattern=pattern, dim=dim, batch_id=base + epoch, replace_files=replace_files))


def _run(src: DataFrame, checkpoint: str, collection: str, compact_every: int | None, write):
    """Runs ``write(batch, epoch)`` for each micro-batch until the input is exhausted."""
    base = stream_batch_base(checkpoint)

    def batch(df: DataFrame, epoch: int) -> None:
        write(df, epoch)
        if compact_every and (epoch + 1) % compact_every == 0:
            # this epoch is not committed yet: it stays open for a replay
            compact(df.sparkSession, collection, keep=0, newest=base + epoch)

    q = src.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# Files of an epoch of a stream of small files.
FILES_PER_EPOCH = 100_000
SMALL_FILE_BYTES = 64 * 1024     # what opening a small file counts for when files are dealt to tasks


@contextmanager
def _small_files(spark: SparkSession):
    """Settings for streams of many small files, which a stream takes over when it starts. By default
    Spark looks up each file of an epoch in a task of its own (up to 10,000) and reads 32 files a task."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism),
              "spark.sql.files.openCostInBytes": str(SMALL_FILE_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_word_files(files: DataFrame, collection: str, *, dim: int, rule=heading_rule, batch_id: int | None = None,
                      replace_files: bool = True) -> None:
    """Word files (path, content) -> paragraphs -> sections -> embedding -> collection; the
    file id is the file's name without extension. A file that cannot be read is a row of the
    quarantine with its error as status. A file that comes again replaces its earlier rows."""
    named = files.select(file_id_from_path(F.col("path")).alias("file_id"), "content")
    staging = scratch_path(files.sparkSession, "paragraphs")
    docx_paragraphs(named, "file_id", "content", errors=True).write.parquet(staging)      # files are read once
    paras = files.sparkSession.read.parquet(staging)
    broken = paras.where("error is not null").select("file_id", F.concat(F.lit("corrupt_file: "), "error").alias("status"))
    sections = sections_from_rows(paras.where("error is null"), rule, id_col="file_id")
    rows = enrich_chunks(sections.select("file_id", F.col("section_no").alias("chunk_no"), "content"), ["file_id", "chunk_no"], dim=dim)
    append_conformed(rows, collection, dim, batch_id=batch_id, rejected=broken, replace_files=replace_files)


def land_names(spark: SparkSession, root: str, suffix: str, folder: str, most: int) -> None:
    """The files below ``root`` that no name in ``folder`` stands for: their names (``NAMES``) go there, those of the oldest files
    first, in a Parquet file for each ``most`` of them. The files are written one after the other, the order a file stream takes them in."""
    path = F.concat_ws("/", "root", "relpath").alias("path")
    landed = spark.read.schema(NAMES).parquet(folder).select(path)
    staging = scratch_path(spark, "new-names")
    # never a broadcast: that would be all names
    list_files(spark, root, suffix).withColumn("path", path).join(landed.hint("merge"), "path", "left_anti").write.parquet(f"{staging}/new")
    new = spark.read.schema("path string, " + NAMES).parquet(f"{staging}/new")
    n = new.count()
    if n > most:
        numbered = global_offsets(new.withColumn("one", F.lit(1)), ["modified", "path"], "one", "number")
        numbered.withColumn("epoch", F.floor(F.col("number") / most)).drop("one", "number").write.partitionBy("epoch").parquet(f"{staging}/numbered")
    for k in range(math.ceil(n / most)):
        part = spark.read.schema(NAMES).parquet(f"{staging}/numbered/epoch={k}") if n > most else new.drop("path")
        part.coalesce(1).write.mode("append").parquet(folder)


def _named_files(names: DataFrame) -> DataFrame:
    """``NAMES`` -> the files as ``BINARY_FILES``."""
    return read_contents(names).select(F.concat_ws("/", "root", "relpath").alias("path"), F.timestamp_millis("modified").alias("modificationTime"),
                                       "length", "content")


def stream_word_files(spark: SparkSession, source: str, collection: str, checkpoint: str, *, dim: int, rule=heading_rule,
                      max_files_per_trigger: int | None = FILES_PER_EPOCH, replace_files: bool = True, compact_every: int | None = None):
    """Every ``*.docx`` that lands below ``source`` goes to the collection (``ingest_word_files``),
    epoch by epoch, replay-safe like ``stream_ingest``; an epoch has at most ``max_files_per_trigger`` files.

    Spark's file source holds the names of all files on the driver, whatever an epoch has. So tasks list the files, the names
    of new ones land in the checkpoint's folder ``files``, and the stream reads those, an epoch's names at a time; its tasks
    read the files. Spark's file source is left for what tasks cannot list (``task_folder``) and for checkpoints it began."""
    create_if_missing(spark, collection)
    base = stream_batch_base(checkpoint)
    folder = f"{checkpoint.rstrip('/')}/files"
    root = task_folder(spark, source)
    named = path_exists(spark, folder) or (root is not None and not path_exists(spark, f"{checkpoint.rstrip('/')}/offsets"))
    if named and root is None:
        raise ValueError(f"{source} is no folder that tasks can list, as it was for {checkpoint} before")
    with _small_files(spark):
        if named:
            path, fs = _fs(spark, folder)
            fs.mkdirs(path)
            land_names(spark, root, ".docx", folder, max_files_per_trigger or FILES_PER_EPOCH)
            reader = spark.readStream.schema(NAMES)
            src = (reader.option("maxFilesPerTrigger", 1) if max_files_per_trigger else reader).parquet(folder)
        else:
            reader = (spark.readStream.format("binaryFile").schema(BINARY_FILES).option("pathGlobFilter", "*.docx")
                      .option("recursiveFileLookup", "true"))
            if max_files_per_trigger:
                reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
            src = reader.load(source)
        return _run(src, checkpoint, collection, compact_every, lambda df, epoch: ingest_word_files(
            _named_files(df) if named else df, collection, dim=dim, rule=rule, batch_id=base + epoch, replace_files=replace_files))
