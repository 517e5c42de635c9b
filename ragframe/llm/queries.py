"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from ragframe.llm import (bpe, chat, codes, decontam, langid, licenses, lines, minhash, phrases, sharding, sql, substrings,
                          toxicity, vectors)
from ragframe.llm.common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return put


@query("op1_license_scan", sql.license_scan())
def op1_license_scan(spark, sf_dir):
    """Licence phrases and notices of every document, by diagonal voting."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op10_chat_perspectives", sql.chat_perspectives())
def op10_chat_perspectives(spark, sf_dir):
    """Every conversation rendered from each participant's perspective, with its mask."""
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def tokenizer_path() -> str:
    """The word-end BPE vocabulary of the installed tokenizer files."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_bpe_round_trip")
def op3_bpe_round_trip(spark, sf_dir):
    """Every document encoded by a pair occurrence index, and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    """Toxicity of every document: noisy-or of sentence scores, learnt from document labels."""
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    """Language of every document by words, then by shorter and shorter n-grams."""
    return langid.predictions(table(spark, sf_dir, "documents"))


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark, sf_dir):
    """Groups of near copies among all documents: 3-word shingles, similarity 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@query("op5_vector_near_dedup")
def op5_vector_near_dedup(spark, sf_dir):
    """Links, components and kept rows of all vectors at cosine 0.95 or more, by spherical-cap filters."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_line_dedup")
def op9_line_dedup(spark, sf_dir):
    """Every document without the lines that are fuzzy copies of an earlier one."""
    return lines.dedup_lines(table(spark, sf_dir, "documents"), short_copies=True).drop("row")


@query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark, sf_dir):
    """Benchmark items that documents hold, with their windows."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    """Passages that documents share, by content-defined chunks."""
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


@query("op11_phrase_collocations", sql.collocations())
def op11_phrase_collocations(spark, sf_dir):
    """Each language's first 2000 phrases of 2 to 4 words, from subtrees over groups of word prefixes."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_sharding", sql.shards())
def op12_sharding(spark, sf_dir):
    """All documents in 24 shards of near equal bytes, equal texts together, by minimax contiguous partition."""
    return sharding.shards_by_bytes(table(spark, sf_dir, "documents"))


@query("op13_vector_codes")
def op13_vector_codes(spark, sf_dir):
    """Product codes of all vectors, refined exactly over anchors-hierarchy ball trees."""
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))
