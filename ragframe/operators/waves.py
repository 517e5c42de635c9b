"""Boundary decisions of a model, wave by wave over all documents.

Within a document excerpts follow one another: each begins at the last section
start that was decided. Across documents nothing waits: in every wave each open
document sends one excerpt, and all excerpts of a wave go to the model in shared
Arrow batches, with its time limit, its retries and its errors kept. Between waves
the state is a table of open documents with the paragraphs that no finished section
holds yet; sections leave it as soon as they are decided, so a wave costs what is
still open."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import marker, section_markers, strictly_increasing_prefix
from ragframe.operators.cuts import section_cuts
from ragframe.operators.model import ModelFn, model_answers
from ragframe.operators.partitioning import spread
from ragframe.operators.sections import MIN_SECTION_CHARS, PDF_GROUP, WORD_GROUP, kept_paragraphs, section_prompt
from ragframe.session import scratch_path

_PARA = "struct<m:int,text:string,page:int>"


def _new_cuts(min_chars: int):
    @F.pandas_udf("array<int>")
    def cuts(lengths: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([section_cuts(np.asarray(n, dtype=np.int64), np.asarray(s, dtype=np.int64), min_chars)
                          for n, s in zip(lengths, starts, strict=True)], dtype=object)
    return cuts


def _known_run(markers: Column, excerpt: Column) -> Column:
    """Places in the excerpt of the leading run of markers that are in it and increase."""
    first = F.get(excerpt, 0)["m"]
    run = F.transform(strictly_increasing_prefix(markers), lambda x: x - first)
    # the run increases: one that is not in the excerpt comes first, or all after it are not either
    return F.when(F.coalesce(F.get(run, 0) < 0, F.lit(True)), F.array().cast("array<int>")).otherwise(
        F.filter(run, lambda x: x < F.size(excerpt)))


def _table(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def semantic_waves(df: DataFrame, fn: ModelFn, *, id_col: str = "doc_id", text_col: str = "text", mode: str = "word",
                   group_size: int | None = None, min_chars: int = MIN_SECTION_CHARS, lines_per_page: int | None = None,
                   max_asks: int = 3, timeout_s: float | None = 10.0, max_retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """((id, section_no, content, first_marker, n_paras[, page_number]), (id, first_marker, error)).

    ``fn`` answers a frame with the column ``prompt`` (``section_prompt``). An answer
    that lists markers decides; one without a list, or a failed call, is asked for
    again in the next wave, ``max_asks`` times in all, and then decides nothing (failed
    calls are in the second table). An excerpt that decides nothing makes those after
    it longer by half a group. In PDF mode the last section joins the one before it.
    Ids may be of any type; documents without paragraphs have no row."""
    pdf = mode == "pdf"
    size0 = group_size or (PDF_GROUP if pdf else WORD_GROUP)
    kept = F.transform(kept_paragraphs(F.col(text_col), drop_images=not pdf, lines_per_page=lines_per_page if pdf else None),
                       lambda x, i: F.struct(i.alias("m"), x["text"].alias("text"), x["page"].alias("page")))
    nothing = F.array().cast(f"array<{_PARA}>")
    state = (spread(df.select(id_col, text_col)).select(id_col, kept.cast(f"array<{_PARA}>").alias("paras")).where(F.size("paras") > 0)
             .select(id_col, "paras", nothing.alias("held"), F.lit(size0).alias("size"), F.lit(0).alias("asks"), F.lit(0).alias("done")))
    sections, failures = [], []
    while True:
        # head: the excerpt, which sections are cut from; tail: what is only carried on
        parts = state.select(id_col, F.slice("paras", 1, F.col("size")).alias("head"),
                             F.slice("paras", F.col("size") + 1, F.size("paras")).alias("tail"), "held", "size", "asks", "done")
        lines = F.array_join(F.transform("head", lambda p: F.concat(marker(p["m"]), F.lit(" "), p["text"])), "\n")
        asked = parts.withColumn("_r", model_answers(fn, section_prompt(lines).alias("prompt"), timeout_s=timeout_s, max_retries=max_retries))
        asked = (asked.select("*", "_r.answer", "_r.error").drop("_r").withColumn("_listed", section_markers(F.col("answer")))
                 .withColumn("decides", F.col("_listed").isNotNull() | (F.col("asks") + 1 >= max_asks)))
        lengths = F.transform("head", lambda p: F.length(p["text"]))
        cuts = _new_cuts(min_chars)(lengths, _known_run(F.coalesce("_listed", F.array().cast("array<int>")), F.col("head")))
        # written once a wave: the model is asked once, and the next wave and the sections read it
        wave = _table(asked.withColumn("cuts", cuts).drop("answer", "_listed"), "wave")
        if wave.isEmpty():
            break
        failures.append(wave.where("error is not null").select(id_col, F.get("head", 0)["m"].cast("long").alias("first_marker"), "error"))
        wave = _decided(wave, id_col, pdf, size0)
        sections.append(_rows(wave.where("decides"), id_col, pdf))
        state = wave.where("not over").select(id_col, "paras", "held", "size", "asks", "done")
    if not sections:
        empty = state.select(id_col, "paras", F.lit(0).alias("before"), F.array().cast(f"array<array<{_PARA}>>").alias("out")).limit(0)
        return _rows(empty, id_col, pdf), empty.select(id_col, F.lit(0).cast("long").alias("first_marker"), F.lit("").alias("error"))
    out, errors = sections[0], failures[0]
    for more, failed in zip(sections[1:], failures[1:], strict=True):
        out, errors = out.unionByName(more), errors.unionByName(failed)
    return out, errors


def _decided(wave: DataFrame, id_col: str, pdf: bool, size0: int) -> DataFrame:
    """The state after the wave, with the sections ``out`` that leave it (none while an answer does not count)."""
    none = F.array().cast(f"array<array<{_PARA}>>")
    n = F.size("cuts")
    ends = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("cuts")).alias("a"), F.col("cuts").alias("b"))
    spans = F.transform(F.slice(ends, 1, n), lambda s: F.slice("head", s["a"] + 1, s["b"] - s["a"]))
    last = F.when(n > 0, F.element_at("cuts", -1)).otherwise(F.lit(0))
    wave = (wave.withColumn("over", F.col("decides") & (F.size("tail") == 0))
            .withColumn("_spans", F.concat(F.when(F.size("held") > 0, F.array("held")).otherwise(none), spans))
            .withColumn("_rest", F.slice("head", last + 1, F.size("head"))))
    k = F.size("_spans")
    if pdf:
        before = F.when(k > 0, F.slice("_spans", 1, k - 1)).otherwise(F.col("_spans"))
        newest = F.when(k > 0, F.element_at("_spans", -1)).otherwise(F.array().cast(f"array<{_PARA}>"))
        out = F.when(F.col("over"), F.concat(before, F.array(F.concat(newest, F.col("_rest"))))).otherwise(before)
        held = newest
    else:
        out = F.when(F.col("over"), F.concat(F.col("_spans"), F.array("_rest"))).otherwise(F.col("_spans"))
        held = F.array().cast(f"array<{_PARA}>")
    grown = F.when(n == 0, F.col("size") + size0 // 2).otherwise(F.col("size"))
    counts = lambda new, old: F.when(F.col("decides"), new).otherwise(old)
    return (wave.withColumn("out", counts(out, none))
            .select(id_col, F.concat(counts(F.col("_rest"), F.col("head")), "tail").alias("paras"), counts(held, F.col("held")).alias("held"),
                    counts(grown, F.col("size")).alias("size"), counts(F.lit(0), F.col("asks") + 1).alias("asks"),
                    (F.col("done") + F.size("out")).alias("done"), "decides", "over", "out", F.col("done").alias("before")))


def _rows(wave: DataFrame, id_col: str, pdf: bool) -> DataFrame:
    d = wave.select(id_col, "before", F.posexplode("out").alias("at", "ps"))
    cols = [id_col, (F.col("before") + F.col("at")).cast("long").alias("section_no"),
            F.array_join(F.transform("ps", lambda p: p["text"]), "\n").alias("content"),
            F.get("ps", 0)["m"].cast("long").alias("first_marker"), F.size("ps").cast("long").alias("n_paras")]
    if pdf:
        cols.append(F.get("ps", 0)["page"].cast("long").alias("page_number"))
    return d.select(*cols)
