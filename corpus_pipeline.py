"""A training corpus from ``documents``: toxicity, line dedup, MinHash near-dedup,
benchmark decontamination, BPE. Each stage takes all that the one before kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from ragframe.llm import bpe, decontam, lines, minhash, toxicity
from ragframe.llm.common import bounded_batches, table, written
from ragframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, learnt from ``labels``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are copies of an earlier one; one that is a copy throughout goes."""
    return lines.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer_path())


def _bounded(stage):
    """The stage, with few whole texts at once in Python."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [
    ("toxicity", _bounded(drop_toxic)),
    ("line_dedup", _bounded(dedup_lines)),
    ("minhash_near_dedup", _bounded(drop_near_copies)),
    ("decontamination", _bounded(drop_leaks)),
    ("bpe", _bounded(encode)),
]

# No SQL for learnt scores, SimHash joins and BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
