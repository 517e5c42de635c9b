"""Language identification with word-first backoff.

A known word scores the log of its relative frequency in each language. A word
never learnt falls back to its character n-grams, longest first: the n-grams of
the largest size of which any is known give their mean log frequency. A text
takes the language with the largest sum over its words.

Frequencies are counted in Spark over at most about ``SAMPLE_PER_LANG`` documents of
each language, taken by a hash of their id; the most frequent ``MAX_WORDS`` words
and ``MAX_GRAMS`` n-grams make the model. Prediction reads every whole text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import id_and_text, in_training_part

SAMPLE_PER_LANG = 5_000   # expected bound of the fitted sample, documents of each language
MAX_LANGS = 1_000
MAX_WORDS = 100_000
MAX_GRAMS = 100_000
GRAM_SIZES = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
CACHE_WORDS = 300_000
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single letters without marks."""
    w = f"<{word}>" if size > 1 else word
    return [w[i:i + size] for i in range(len(w) - size + 1)]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(text, lang) of the documents to learn from: of each language the share
    ``per_lang / its size`` (at most 1) of the ids' hash range."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang")).where(
        in_training_part("doc_id") & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    sizes = known.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(MAX_LANGS)
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    return (known.join(F.broadcast(sizes), "lang").where(hashed < per_lang / F.col("size"))
            .where(F.col("text").isNotNull()).select("text", "lang"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = SAMPLE_PER_LANG) -> dict:
    """The model: languages, token indexes and a matrix of log frequencies. Its
    size is bounded by MAX_WORDS, MAX_GRAMS and MAX_LANGS."""
    def count(batches):
        for b in batches:
            words = Counter((lang, w) for lang, text in zip(b["lang"], b["text"], strict=True) for w in split_words(text))
            parts = Counter()
            for (lang, w), n in words.items():
                for size in GRAM_SIZES:
                    for g in grams(w, size):
                        parts[lang, size, g] += n
            rows = [(0, w, lang, n) for (lang, w), n in words.items()]
            rows += [(size, g, lang, n) for (lang, size, g), n in parts.items()]
            yield pd.DataFrame(rows, columns=["size", "token", "lang", "n"])

    counts = (training_sample(docs, id_col, text_col, lang_col, per_lang)
              .mapInPandas(count, "size int, token string, lang string, n long")
              .groupBy("size", "token", "lang").agg(F.sum("n").alias("n")))
    by_token = (counts.groupBy("size", "token")
                .agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")))
    by_token = by_token.persist()
    try:
        top = lambda cond, most: by_token.where(cond & (F.col("total") > 1)).orderBy(
            F.desc("total"), "size", "token").limit(most).select("size", "token", "by_lang").collect()
        rows = top(F.col("size") == 0, MAX_WORDS) + top(F.col("size") > 0, MAX_GRAMS)
        # relative frequencies are against the counts of the whole sample
        sums = {(r.size, r.lang): r.n for r in by_token.select("size", F.explode("by_lang").alias("lang", "n"))
                .groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
        kinds = {r["size"]: r["count"] for r in by_token.groupBy("size").count().collect()}
    finally:
        by_token.unpersist()
    langs = sorted({lang for _, lang in sums})
    at = {lang: i for i, lang in enumerate(langs)}
    matrix = np.zeros((len(rows), len(langs)))
    for i, r in enumerate(rows):
        for lang, n in r.by_lang.items():
            matrix[i, at[lang]] = n
    size_of = [r["size"] for r in rows]
    if rows:
        base = {s: np.array([sums.get((s, x), 0) for x in langs]) + SMOOTHING * kinds[s] for s in set(size_of)}
        matrix = np.log((matrix + SMOOTHING) / np.stack([base[s] for s in size_of]))
    return {"langs": langs, "matrix": matrix,
            "words": {r.token: i for i, r in enumerate(rows) if r["size"] == 0},
            "grams": {(r["size"], r.token): i for i, r in enumerate(rows) if r["size"] > 0}}


class WordScores:
    """Score vectors of words: known ones from the model, others by backoff.
    Vectors worked out are kept, up to a bound."""

    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index = dict(self.model["words"])
        self.matrix = np.vstack([self.model["matrix"], np.zeros((1024, len(self.model["langs"])))])
        self.used = len(self.model["matrix"])
        self.first = self.used

    def backoff(self, word: str) -> np.ndarray:
        known = self.model["grams"]
        for size in GRAM_SIZES:
            found = [known[size, g] for g in grams(word, size) if (size, g) in known]
            if found:
                return self.model["matrix"][found].mean(axis=0)
        return np.zeros(len(self.model["langs"]))

    def total(self, words: list[str]) -> np.ndarray:
        if self.used - self.first > CACHE_WORDS:
            self.clear()
        for w in set(words).difference(self.index):
            if self.used == len(self.matrix):
                self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix[:self.used])])
            self.matrix[self.used] = self.backoff(w)
            self.index[w] = self.used
            self.used += 1
        ids = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        return self.matrix[ids].sum(axis=0)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (posterior of that language, all equally likely
    at first) for every document row. Null, empty and letterless texts give
    "und" with score 0, as does every text if nothing was learnt; equal
    scores go to the alphabetically first; repeated rows score alike."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores, langs = WordScores(held.value), held.value["langs"]
        for b in batches:
            best, share = [], []
            for text in b["text"]:
                words = split_words(text)
                if not words or not langs:
                    best.append(UNKNOWN)
                    share.append(0.0)
                    continue
                s = scores.total(words)
                i = int(s.argmax())
                best.append(langs[i])
                share.append(float(1 / np.exp(s - s[i]).sum()))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": best, "score": share})

    return id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; a null id was never learnt from, so it is held out."""
    return identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col).select(
        "doc_id", F.coalesce(~in_training_part("doc_id"), F.lit(True)).alias("held_out"), "lang_pred", "score")
