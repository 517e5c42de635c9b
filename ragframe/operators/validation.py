"""Row-level validation: every rule yields a status column, and rows split
into an accepted and a quarantined DataFrame instead of failing a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference collection schema.
FILE_ID_MAX = 2000
DESCRIPTION_MAX = 2000
CONTENT_MAX = 30000
REFERENCE_DIM = 1536
UPLOAD_EXTENSION = ".docx"


def split_by_status(df: DataFrame, status_col: str = "status", ok: str = "ok"):
    return df.filter(F.col(status_col) == ok), df.filter(F.col(status_col) != ok)


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def question_status(question: Column, user_id: Column, pdf_id: Column) -> Column:
    """the first failing rule wins, in the order question, user, file."""
    return (F.when(_blank(question), F.lit("missing_question"))
            .when(_blank(user_id), F.lit("missing_user"))
            .when(_blank(pdf_id), F.lit("missing_file"))
            .otherwise(F.lit("ok")))


def upload_status(filename: Column, extension: str = UPLOAD_EXTENSION) -> Column:
    """case-sensitive extension check."""
    return F.when(filename.endswith(extension), F.lit("ok")).otherwise(F.lit("not_a_word_document"))


def _len(c: Column, unit: str) -> Column:
    return F.length(c) if unit == "chars" else F.octet_length(c)


def collection_status(file_id: Column, content: Column, embedding: Column, dim: int,
                      description: Column | None = None, length_unit: str = "chars") -> Column:
    """F8 / V2: length limits and vector dimension of the collection schema."""
    s = (F.when(file_id.isNull(), F.lit("missing_file_id"))
         .when(_len(file_id, length_unit) > FILE_ID_MAX, F.lit("file_id_too_long")))
    if description is not None:
        s = s.when(_len(description, length_unit) > DESCRIPTION_MAX, F.lit("description_too_long"))
    return (s.when(content.isNull(), F.lit("missing_content"))
            .when(_len(content, length_unit) > CONTENT_MAX, F.lit("content_too_long"))
            .when(embedding.isNull(), F.lit("missing_embedding"))
            .when(F.size(embedding) != dim, F.lit("bad_dimension"))
            .when(F.exists(embedding, lambda x: x.isNull() | F.isnan(x)), F.lit("bad_vector_value"))
            .otherwise(F.lit("ok")))


def with_collection_status(df: DataFrame, dim: int, *, length_unit: str = "chars") -> DataFrame:
    """Add ``status``: "ok" or the first rule a row breaks."""
    desc = F.col("description") if "description" in df.columns else None
    return df.withColumn("status", collection_status(F.col("file_id"), F.col("content"), F.col("embedding"), dim, desc,
                                                     length_unit))


def conform_collection(df: DataFrame, dim: int, *, length_unit: str = "chars"):
    """Add ``status`` and return ``(accepted, quarantined)``."""
    return split_by_status(with_collection_status(df, dim, length_unit=length_unit))
