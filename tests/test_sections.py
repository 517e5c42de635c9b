import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from ragframe.operators.numbering import global_offsets
from ragframe.operators.sections import (assemble_sections, heading_rule, paragraphs, rule_model,
                                         section_cuts, sections_by_model, semantic_chunks)


def test_para_edges(spark):
    text = "\n".join(["", "\t", "<image: x>", " padded text ", "keep", ""])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    word = [r.text for r in paragraphs(df).orderBy("marker_no").collect()]
    assert word == ["padded text", "keep"]
    pdf = [r.text for r in paragraphs(df, drop_images=False, lines_per_page=10).orderBy("marker_no").collect()]
    assert pdf == ["<image: x>", "padded text", "keep"]


def _texts(lengths):
    return [chr(ord("a") + i) * n for i, n in enumerate(lengths)]


def test_section_worked_example(spark):
    # lengths [50,60,100,40,200], starts at 0,2,3,4
    paras = _texts([50, 60, 100, 40, 200])
    starts = {0, 2, 3, 4}
    rule = lambda m, t: m.isin(list(starts))
    df = spark.createDataFrame([(1, "\n".join(paras))], "doc_id long, text string")
    word = assemble_sections(df, rule).orderBy("section_no").collect()
    assert [r.content for r in word] == ["\n".join(paras[:3]), "\n".join(paras[3:])]
    pdf = assemble_sections(df, rule, mode="pdf", lines_per_page=10).collect()
    assert [r.content for r in pdf] == ["\n".join(paras)] and pdf[0].page_number == 1
    assert section_cuts(np.array([50, 60, 100, 40, 200]), np.array([0, 2, 3, 4]), 128) == [3]


@pytest.mark.parametrize("group", [3, 5, 40, 150])
def test_state_machine_equals_single_pass_for_rule_model(spark, group):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    a = sorted(tuple(r) for r in assemble_sections(docs, heading_rule).collect())
    b = sorted(tuple(r) for r in semantic_chunks(docs, rule_model(60), group_size=group).collect())
    assert a == b


def test_group_growth_when_model_finds_nothing():
    paras = [("x" * 200, None)] * 10
    calls = []

    def fn(excerpt):
        calls.append(excerpt.count("\n") + 1)
        if len(calls) == 1:
            return "```python\nsections = []\n```"
        return "```python\nsections = ['【0†source】', '【5†source】']\n```"

    out = sections_by_model(paras, fn, group_size=4, min_chars=128, pdf=False)
    assert calls[0] == 4 and calls[1] == 6          # 4 -> 4 + 4 // 2
    assert [o[1] for o in out] == [0, 5]


def test_unparseable_answer_is_bounded():
    paras = [("y" * 10, None)] * 3
    n = []
    out = sections_by_model(paras, lambda e: n.append(1) or "no code", 150, 128, False)
    assert len(n) == 3 and out == [("\n".join(["y" * 10] * 3), 0, 3, None)]


def test_global_offsets_match_window(spark):
    df = spark.range(0, 500).select(F.col("id").alias("k"), ((F.col("id") * 7) % 5).alias("n"))
    got = {r.k: r.offset for r in global_offsets(df, ["k"], "n", partitions=7).collect()}
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    exp = {r.k: r.o for r in df.select("k", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("o")).collect()}
    assert got == exp


def test_bad_answers_cut_nothing_and_lose_nothing():
    """Unknown, repeated and falling markers end the run of an answer; all paragraphs stay."""
    answers = iter(["```python\nsections = ['【9†source】']\n```", "no block", None, "sections",
                    "```python\nsections = ['【0†source】', '【3†source】', '【3†source】', '【5†source】']\n```",
                    "```python\nsections = ['【4†source】', '【2†source】']\n```"])
    paras = [(f"{i}" * 150, None) for i in range(9)]
    out = sections_by_model(paras, lambda e: next(answers, "no block"), 4, 128, False)
    assert "\n".join(o[0] for o in out) == "\n".join(t for t, _ in paras)
    assert [o[1] for o in out] == [0, 3, 4]


def test_global_offsets_with_wide_rows_and_without_exchange_reuse(spark):
    n = 2_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), (F.col("id") % 5).alias("n"), F.md5(F.col("id").cast("string")).alias("wide"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = global_offsets(df, ["k"], "n", partitions=16)
        assert out.columns == ["k", "n", "wide", "offset"]
        total = df.agg(F.sum("n")).first()[0]
        # each offset is the one before and its count: the ends meet once, from 0 to the total
        ends = out.where("n > 0").agg(F.count("*"), F.count_distinct("offset"), F.min("offset"), F.max(F.col("offset") + F.col("n"))).first()
        assert tuple(ends) == (n - n // 5, n - n // 5, 0, total)
        w = Window.partitionBy(F.spark_partition_id()).orderBy("k")
        assert out.repartitionByRange(16, "k").withColumn("next", F.lead("offset").over(w)).where(
            F.col("next") != F.col("offset") + F.col("n")).count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
