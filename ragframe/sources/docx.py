"""Word documents -> paragraphs in body order.

The bytes come from ``binaryFile`` (or any binary column); each document is
parsed inside a task with the standard library (a .docx is a zip with
``word/document.xml``): body-level ``w:p`` elements in order, run text from
``w:t``, ``w:tab`` as a tab, ``w:br`` / ``w:cr`` as a newline."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs_of(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{W}body")
    out = []
    for p in (body if body is not None else []):
        if p.tag != f"{W}p":
            continue
        parts = []
        for el in p.iter():
            if el.tag == f"{W}t":
                parts.append(el.text or "")
            elif el.tag == f"{W}tab":
                parts.append("\t")
            elif el.tag in (f"{W}br", f"{W}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return out


def minimal_docx(paragraphs: list[str]) -> bytes:
    """A minimal valid .docx with one run per paragraph (used to derive Word
    files from text tables and in tests)."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in paragraphs)
    xml = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    ctype = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/'
             'package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/>'
             '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-'
             'officedocument.wordprocessingml.document.main+xml"/></Types>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", ctype)
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def _paragraph_texts(content: pd.Series) -> pd.DataFrame:
    rows = []
    for b in content:
        try:
            rows.append((None if b is None else paragraphs_of(bytes(b)), None))
        except Exception as e:  # noqa: BLE001 - a corrupt file is data
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["texts", "error"])


def _to_docx(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else minimal_docx(t.split("\n")) for t in text])


def docx_paragraph_texts(content):
    """Arrow-batched: .docx bytes -> paragraph texts in body order, or the error of a corrupt file."""
    return F.pandas_udf(_paragraph_texts, "texts array<string>, error string")(content)


def text_to_docx(text):
    """Arrow-batched: text -> .docx bytes, one paragraph per line."""
    return F.pandas_udf(_to_docx, "binary")(text)


def docx_paragraphs(df: DataFrame, key_col: str = "path", content_col: str = "content",
                    errors: bool = False) -> DataFrame:
    """Rows ``(key, para_idx, text)`` from a binary column of .docx bytes. With
    ``errors`` also ``error``, and a row with it for each file that can't be read."""
    read = df.select(key_col, docx_paragraph_texts(F.col(content_col)).alias("_d"))
    out = read.select(key_col, F.posexplode_outer("_d.texts").alias("para_idx", "text"), F.col("_d.error").alias("error"))
    out = out.filter(F.col("para_idx").isNotNull() | (F.col("error").isNotNull() if errors else F.lit(False)))
    out = out.withColumn("para_idx", F.col("para_idx").cast("long"))
    return out if errors else out.drop("error")


def read_docx_folder(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.docx`` below ``root`` -> paragraph rows keyed by path."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.docx").load(root))
    return docx_paragraphs(files, "path", "content")
