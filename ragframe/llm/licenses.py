"""Licence scan by diagonal voting, in DataFrame functions only.

A licence is a word template. All rolling word k-gram hashes of a document are
joined to the templates' positions; a hit at document word p and template word
q votes for the diagonal p - q, the place where the template would start.
Neighbouring diagonals are merged (words put in or left out shift the diagonal)
and each merged span is verified by the share of the template's grams found.

Short phrases (``exact``) use 2-grams, take no merging and need every gram, so
a diagonal is a place where the phrase's words stand consecutively. Notices use
4-grams. Equality of words is equality of chained 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import id_and_text

# Separators of words in a text whose A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASE_K, NOTICE_K = 2, 4
MERGE_SLACK = 4          # words by which neighbouring diagonals may differ
MIN_COVERAGE = 0.6       # share of a notice's grams a span must hold


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


# The phrases and labels every scan has.
BASE_PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]

# Opening words of well-known public licence notices.
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy"
                           " of the license at"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the"
                    " gnu general public license as published by the free software foundation"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"
                    " and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"
                    " provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without"
                    " fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """Lower-cased words of a text. ``lower`` equals lower-casing A-Z here: the
    one other letter that lowers to ASCII is U+212A (k), which is in no base
    phrase, and no letter lowers to a separator."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def _rolled(df: DataFrame, text: str) -> DataFrame:
    """Adds ``n_words``, ``g2`` (hash of words i, i+1) and ``g4`` (of i..i+3)."""
    def pairs(a: str, step: int) -> Column:
        n = F.greatest(F.size(a) - step, F.lit(0))
        return F.zip_with(F.slice(a, 1, n), F.slice(a, 1 + step, n), lambda x, y: F.xxhash64(x, y))
    return (df.withColumn("h", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
            .withColumn("n_words", F.size("h").cast("long"))
            .withColumn("g2", pairs("h", 1)).withColumn("g4", pairs("g2", 2)).drop("h"))


def template_table(spark, templates: list[Template]) -> DataFrame:
    """One row per gram of each template: its hash, the template and position.
    Its size is that of the parameter ``templates``, so it can be broadcast."""
    rows = [(i, t.label, t.text, t.exact) for i, t in enumerate(templates)]
    t = _rolled(spark.createDataFrame(rows, "tid int, label string, text string, exact boolean"), "text")
    return (t.withColumn("grams", F.when(F.col("exact"), F.col("g2")).otherwise(F.col("g4")))
            .select("tid", "label", "exact", F.size("grams").alias("n_grams"),
                    F.posexplode("grams").alias("tpos", "gram"))
            .withColumn("k", F.when(F.col("exact"), PHRASE_K).otherwise(NOTICE_K)))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[Template] | None = None) -> DataFrame:
    """Verified spans and near misses: a row per (document row, template,
    merged span) with ``start``/``end`` (words), ``coverage`` and ``verified``;
    a document row also has one row whose ``tid`` is null, so none is lost.

    Nulls and empty texts have no word and only that row. Repeated rows are
    scanned each on their own (``row`` tells them apart)."""
    spark = docs.sparkSession
    templates = BASE_PHRASES + NOTICES if templates is None else templates
    grams = F.broadcast(template_table(spark, templates).select("gram", "k", "tid", "label", "exact", "n_grams", "tpos"))
    d = _rolled(id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "text")
    # one stream of grams: an empty first element that keeps the document, then the 2-grams, then the 4-grams
    exploded = (d.withColumn("n2", F.size("g2"))
                .select("row", "doc_id", "n_words", "n2",
                        F.posexplode(F.concat(F.array(F.lit(None).cast("long")), F.col("g2"), F.col("g4")))
                        .alias("i", "gram")))
    hit = (exploded.join(grams, "gram", "left")
           .where((F.col("i") == 0) | ((F.col("i") <= F.col("n2")) & (F.col("k") == PHRASE_K))
                  | ((F.col("i") > F.col("n2")) & (F.col("k") == NOTICE_K)))
           .withColumn("p", F.when(F.col("i") <= F.col("n2"), F.col("i") - 1).otherwise(F.col("i") - F.col("n2") - 1)))
    key = ["row", "doc_id", "n_words", "tid", "label", "exact", "n_grams"]
    diagonals = (hit.withColumn("diagonal", F.col("p") - F.col("tpos"))
                 .select(*key, "k", "diagonal", "p", "tpos").repartition("row")
                 .groupBy(*key, "k", "diagonal")
                 .agg(F.collect_set("tpos").alias("found"), F.min("p").alias("start"),
                      F.max(F.col("p") + F.col("k")).alias("end")))
    w = Window.partitionBy("row", "tid").orderBy("diagonal")
    jump = F.col("exact") | F.lag("diagonal").over(w).isNull() | (
        F.col("diagonal") - F.lag("diagonal").over(w) > MERGE_SLACK)
    spans = (diagonals.withColumn("jump", F.coalesce(jump, F.lit(True)).cast("int"))
             .withColumn("span", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*key, "span")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"),
                  F.min("start").alias("start"), F.max("end").alias("end"))
             .withColumn("coverage", F.when(F.col("tid").isNotNull(), F.col("n_found") / F.col("n_grams"))))
    return spans.withColumn("verified", F.col("coverage") >= F.when(F.col("exact"), 1.0).otherwise(MIN_COVERAGE))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[Template] | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels and score (the best coverage of any span, 0 without).
    Null and empty texts: no words, empty labels, score 0; a null id is kept."""
    spans = license_spans(docs, id_col, text_col, templates)
    base = F.col("verified") & F.col("exact")
    labelled = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return (spans.groupBy("row", "doc_id", "n_words")
            .agg(F.count(F.when(base, 1)).alias("n_base"),
                 F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
                 F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
                 labelled(base).alias("base_labels"), labelled(F.col("verified")).alias("labels"),
                 F.coalesce(F.max(F.when(F.col("verified") | ~F.col("exact"), F.col("coverage"))),
                            F.lit(0.0)).alias("score"))
            .drop("row"))
