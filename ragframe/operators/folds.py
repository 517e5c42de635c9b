"""Sequential folds over per-document arrays, expressed with Spark's
higher-order functions (``transform`` / ``aggregate``) so they run inside the
JVM, row-locally: one document is one row, so no shuffle is needed and
documents are processed in parallel across partitions.

Every lambda body only uses its own lambda variables (never an outer array
expression), so each element is visited once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leaf struct produced by the chunker (see chunking.leaves):
#   t  text (separator included)   n  tokens
#   b  a chunk must start before this leaf   a  ... after this leaf
LEAF_FIELDS = ("t", "n", "b", "a")


def greedy_pack(leaves: Column, limit: int) -> Column:
    """GreedyFold over leaves -> array of chunk texts.

    A new chunk starts when the running token count would exceed ``limit``,
    and wherever the leaves demand it (around the pieces of an oversize
    element, which are packed from an empty chunk and whose remainder is
    flushed). This is the recursive fallback of the splitter chain written as
    one left-to-right pass. The first leaf never flushes, so an empty
    document gives one empty chunk."""
    init = F.struct(
        F.lit(False).alias("started"),
        F.lit(0).cast("long").alias("cur"),
        F.lit(False).alias("a"),
        F.lit("").alias("acc"),
        F.array().cast("array<string>").alias("out"))

    def step(s, x):
        new = s["started"] & (((s["cur"] + x["n"]) > F.lit(limit)) | x["b"] | s["a"])
        return F.struct(
            F.lit(True).alias("started"),
            F.when(new, x["n"]).otherwise(s["cur"] + x["n"]).alias("cur"),
            x["a"].alias("a"),
            F.when(new, x["t"]).otherwise(F.concat(s["acc"], x["t"])).alias("acc"),
            F.when(new, F.array_append(s["out"], s["acc"])).otherwise(s["out"]).alias("out"))

    return F.aggregate(leaves, init, step,
                       lambda s: F.when(s["started"], F.array_append(s["out"], s["acc"]))
                       .otherwise(s["out"]))


def greedy_head(leaves: Column, limit: int) -> Column:
    """The first chunk ``greedy_pack`` would produce, without building the
    others: accumulation stops at the first break."""
    init = F.struct(F.lit(False).alias("started"), F.lit(False).alias("done"),
                    F.lit(0).cast("long").alias("cur"), F.lit(False).alias("a"), F.lit("").alias("acc"))

    def step(s, x):
        brk = s["started"] & (((s["cur"] + x["n"]) > F.lit(limit)) | x["b"] | s["a"])
        stop = s["done"] | brk
        return F.struct(
            F.lit(True).alias("started"), stop.alias("done"),
            (s["cur"] + x["n"]).alias("cur"), x["a"].alias("a"),
            F.when(stop, s["acc"]).otherwise(F.concat(s["acc"], x["t"])).alias("acc"))

    return F.aggregate(leaves, init, step, lambda s: s["acc"])


def min_size_sections(paras: Column, min_chars: int = 128) -> Column:
    """MinSizeFold over paragraphs ``struct<len, start, ...>`` -> section id
    per paragraph: at a section start, the pending text is emitted when its
    length (joiners excluded) is > ``min_chars``; short sections merge forward.
    Returns array<struct<sid:int, last_start:int>> aligned with ``paras``
    (``last_start`` = number of emissions so far)."""
    init = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("sid"),
                    F.array().cast("array<int>").alias("ids"))

    def step(s, p):
        emit = p["start"] & (s["acc"] > F.lit(min_chars))
        sid = F.when(emit, s["sid"] + 1).otherwise(s["sid"])
        return F.struct(
            (F.when(emit, F.lit(0).cast("long")).otherwise(s["acc"]) + p["len"]).alias("acc"),
            sid.alias("sid"),
            F.array_append(s["ids"], sid).alias("ids"))

    return F.aggregate(paras, init, step, lambda s: s["ids"])
