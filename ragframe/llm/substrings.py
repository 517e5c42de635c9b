"""Substring dedup by content-defined chunking.

A gear rolling hash of the last 16 bytes cuts a text wherever its mask bits are
0 (about every 16 bytes), except less than ``MIN_BYTES`` after another such place;
a stretch without a cut is cut every ``MAX_BYTES``. A cut thus depends on the
bytes before it alone, and chunks are the same again soon after an insertion.

Chunks are deduplicated by a 128-bit digest: a partial aggregate finds those
of several documents, and a join marks their places (the join of a hot chunk can
be split). Neighbouring marked chunks of a document make a span; spans of
``MIN_WORDS`` words or more are repeated passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import id_and_text, written

MASK = np.uint32(0b1111 << 12)    # four bits; the lowest depends on 13 bytes, the highest on 16
MIN_BYTES, MAX_BYTES = 16, 1024
MIN_WORDS = 12                    # of a passage of 50 words, chunks at its ends are lost: 1 in 10,000 keeps fewer
_GEAR = np.random.default_rng(2_024).integers(0, 2 ** 32, size=256, dtype=np.uint32)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """End offsets of the chunks of some bytes; the last is their number."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    at = np.flatnonzero((h & MASK) == 0) + 1
    at = at[np.diff(at, prepend=-MIN_BYTES) >= MIN_BYTES]
    ends = np.unique(np.append(at, len(data)))
    gap = np.diff(ends, prepend=0)
    if len(gap) and gap.max() > MAX_BYTES:
        more = [np.arange(e - g + MAX_BYTES, e, MAX_BYTES) for e, g in zip(ends[gap > MAX_BYTES], gap[gap > MAX_BYTES], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends[ends > 0]


def chunks(docs: DataFrame, places: bool) -> DataFrame:
    """(doc_id, d1, d2) of every chunk; with ``places`` also row, n (number of the chunk in its text),
    start and end (characters) and words (that begin in it)."""
    names = ["doc_id", "d1", "d2"] + (["row", "n", "start", "end", "words"] if places else [])

    def run(batches):
        for batch in batches:
            rows = batch.column("row")
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                if not raw:
                    continue
                data = np.frombuffer(raw, dtype=np.uint8)
                ends = chunk_ends(data)
                starts = np.r_[0, ends[:-1]]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[s:e]) for s, e in
                                                zip(starts.tolist(), ends.tolist(), strict=True)), dtype="<i8").reshape(-1, 2)
                m = len(ends)
                columns = [pa.array(np.full(m, doc_id)), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1]))]
                if places:
                    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                    blank = (data == 32) | ((data >= 9) & (data <= 13))
                    begins = np.r_[0, np.cumsum(~blank & np.r_[True, blank[:-1]])]
                    columns += [pa.array(np.full(m, rows[i].as_py())), pa.array(np.arange(m, dtype=np.int64)),
                                pa.array(chars[starts]), pa.array(chars[ends]), pa.array(begins[ends] - begins[starts])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return (docs.where("doc_id is not null").withColumn("row", F.monotonically_increasing_id())
            .mapInArrow(run, ", ".join(f"`{c}` long" for c in names)))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end (characters), n_words, n_chunks, first_doc, kept, cuts: a row
    per passage of a document row that other documents hold as well. ``first_doc``
    is the smallest id that holds a part of it; ``kept`` is true where this
    document is the first with all of it, so the passage may stay. ``cuts`` are the
    parts (start, end) that an earlier document holds and that may go: passages
    that adjoin here may have different first documents, or this one.

    Documents without one have no row: null and empty texts, null ids, an empty
    table. Repeated rows of an id are one document, each with rows of its own;
    what a text repeats within itself alone is none."""
    d = id_and_text(docs, id_col, text_col)
    shared = written(chunks(d, places=False).groupBy("d1", "d2")
                     .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
                     .where("first_doc < last_doc").drop("last_doc"), "shared-chunks")
    found = chunks(d, places=True).join(shared, ["d1", "d2"])
    w = Window.partitionBy("row").orderBy("n")
    new = F.coalesce(F.col("n") - F.lag("n").over(w) != 1, F.lit(True))
    first = F.col("first_doc") == F.col("doc_id")
    turn = new | (first != F.lag(first).over(w))
    return (found.withColumn("run", F.sum(new.cast("int")).over(w)).withColumn("span", F.sum(turn.cast("int")).over(w))
            .groupBy("row", "run", "span").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
                                               F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"),
                                               F.min("first_doc").alias("first_doc"))
            .groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
                                       F.sum("n_words").alias("n_words"), F.sum("n_chunks").alias("n_chunks"),
                                       F.min("first_doc").alias("first_doc"),
                                       F.array_sort(F.collect_list(F.when(F.col("first_doc") != F.col("doc_id"), F.struct("start", "end")))).alias("cuts"))
            .withColumn("kept", F.size("cuts") == 0)
            .where(F.col("n_words") >= min_words)
            .select("doc_id", "start", "end", "n_words", "n_chunks", "first_doc", "kept", "cuts"))


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of every document row without the cuts of its spans: the first document of each part keeps it."""
    cuts = (spans.select("doc_id", F.explode("cuts").alias("cut")).groupBy("doc_id")
            .agg(F.array_sort(F.collect_set("cut")).alias("cuts")))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(cuts, "doc_id", "left")
    parts = F.transform("cuts", lambda c, i: F.substring(
        F.col("text"), F.when(i == 0, 1).otherwise(F.col("cuts")[i - 1]["end"] + 1).cast("int"),
        (c["start"] - F.when(i == 0, 0).otherwise(F.col("cuts")[i - 1]["end"])).cast("int")))
    rest = F.expr("substring(text, cast(element_at(cuts, -1).end + 1 as int))")
    return d.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join(parts, ""), rest)).alias("text"))
