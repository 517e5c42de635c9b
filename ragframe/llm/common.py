"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``: whatever else the
    table holds cannot clash with an operator's own columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder below ``spark.checkpoint.dir`` and read
    again: cuts the lineage, and survives the loss of an executor."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 500   # whole texts that go to Python at once; Spark's own 10,000 are a whole input split


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session's Arrow batches have at most ``rows`` rows, as a plan
    runs when its caller writes it. A batch is held several times over (buffers of the
    executor and of its Python worker, strings). A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def in_training_part(id_col) -> "F.Column":
    """True where crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def semi_join_measured(df: DataFrame, keys: DataFrame, on: str,
                       max_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys``. The keys are counted first:
    up to ``max_rows`` of them (16 bytes each) are broadcast, more are joined
    by a shuffle. Both give the same rows."""
    if keys.limit(max_rows + 1).count() <= max_rows:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")
