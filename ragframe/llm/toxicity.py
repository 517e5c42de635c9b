"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the bag has a label. A sentence
scores sigmoid(bias + sum of its words' weights), and the bag noisy-or
1 - prod(1 - sentence score); the weights are fitted to the document labels, and
the sentences that make a document toxic are then located by their own scores.
When texts are scored, the product leaves out sentences below a floor, or any
text would be toxic that is long enough. The floor rises with the number n of
sentences: it is the lowest score above which n sentences of the sample's clean
documents add ``ALLOWANCE`` at most to -log of the product. Short texts so have
none, and the floor of endless ones is the highest score of a clean sentence, at
most 0.5. A text's best sentence always counts, so every score is graded.

Words carry a feature of their own and two of their beginnings, so inflected
forms share weight. The fit uses at most ``SAMPLE_PER_CLASS`` labelled documents
of each class, the first in the order of a hash of the id, weighted back to the
classes' sizes; features are counted in Spark over that sample and the strongest
``MAX_FEATURES`` are kept. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import id_and_text, in_training_part, written

SAMPLE_PER_CLASS = 4_000     # bound of the fitted sample, documents of each class
MAX_FEATURES = 20_000        # bound of the model
MIN_DOCUMENTS = 3            # of the sample that must hold a feature
MIN_Z = 3.0                  # strength of a feature, in standard errors of its log-odds
PREFIXES = (4, 5)
ALLOWANCE = 0.05             # what the clean sentences of a text, whatever their number, may add
LENGTH_STEP = 1.05           # the floors are learnt for numbers of sentences that grow by so much
CACHE_WORDS = 300_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return ["w:" + word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n)]


def each_sentence(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of the sentences that have a word, one at a time."""
    for m in _SENTENCE.finditer(text):
        words = _WORD.findall(m.group().lower())
        if words:
            yield m.start(), m.end(), words


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    return list(each_sentence(text))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                    label_col: str, per_class: int) -> DataFrame:
    """(doc_id, text, y, weight): the bounded labelled sample. A document with
    several labels counts as toxic if one of them says so; one with several
    texts gives the smallest."""
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(in_training_part("doc_id") & F.col("y").isin(0, 1))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y, n in sorted(sizes.items()):
        part = (known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
                .withColumn("weight", F.lit(n / min(n, per_class))))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known.limit(0).withColumn("weight", F.lit(1.0))
    # at most 2 x per_class ids: a bounded broadcast, so the documents aren't shuffled
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    return written(rows.groupBy("doc_id", "y", "weight").agg(F.min("text").alias("text")), "toxic-sample")


def select_features(sample: DataFrame, max_features: int) -> list[str]:
    """The features whose document counts differ most between the classes."""
    def present(batches):
        for b in batches:
            for y, text in zip(b["y"], b["text"], strict=True):
                found = {f for _, _, ws in each_sentence(text) for w in set(ws) for f in word_features(w)}
                yield pd.DataFrame({"feature": sorted(found), "y": int(y)})
    total = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return []
    a, c = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    b, d = F.lit(n1) - F.col("a") + 0.5, F.lit(n0) - F.col("n") + F.col("a") + 0.5
    z = F.abs(F.log(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    rows = (sample.select("y", "text").mapInPandas(present, "feature string, y int")
            .groupBy("feature").agg(F.count("*").alias("n"), F.sum("y").alias("a"))
            .where(F.col("n") >= MIN_DOCUMENTS).withColumn("z", z).where(F.col("z") >= MIN_Z)
            .orderBy(F.desc("z"), "feature").limit(max_features).select("feature").collect())
    return [r.feature for r in rows]


def bags(sample: DataFrame, features: list[str]) -> pd.DataFrame:
    """Per document: y, weight, number of sentences, and the selected features
    of its sentences as index lists (other sentences are all alike)."""
    index = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def rows(batches):
        at = index.value
        for b in batches:
            out = []
            for y, weight, text in zip(b["y"], b["weight"], b["text"], strict=True):
                n, ids, sizes = 0, [], []
                for _, _, ws in each_sentence(text):
                    found = [at[f] for w in ws for f in word_features(w) if f in at]
                    n += 1
                    if found:
                        ids += found
                        sizes.append(len(found))
                out.append((y, weight, n, ids, sizes))
            yield pd.DataFrame(out, columns=["y", "weight", "n", "ids", "sizes"])
    return sample.select("doc_id", "y", "weight", "text").mapInPandas(
        rows, "y int, weight double, n int, ids array<int>, sizes array<int>").toPandas()


def fit_noisy_or(data: pd.DataFrame, n_features: int, steps: int = 300, rate: float = 0.1,
                 decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the bags' labels (Adam, full batches)."""
    y = data["y"].to_numpy(dtype=float)
    share = data["weight"].to_numpy(dtype=float)
    share = share / share.sum()
    sizes = [np.asarray(s, dtype=np.int64) for s in data["sizes"]]
    bag = np.repeat(np.arange(len(data)), [len(s) for s in sizes])
    plain = data["n"].to_numpy(dtype=float) - np.array([len(s) for s in sizes], dtype=float)
    flat = np.concatenate([*sizes, np.zeros(0, dtype=np.int64)])
    ids = np.concatenate([*(np.asarray(i, dtype=np.int64) for i in data["ids"]), np.zeros(0, dtype=np.int64)])
    sentence = np.repeat(np.arange(len(flat)), flat)
    w = np.zeros(n_features + 1)  # the last is the bias
    w[-1] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(sentence, w[ids], minlength=len(flat))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + plain * np.log1p(-p0)
        some = -np.expm1(clean)
        pull = share * np.where(y > 0, -np.exp(clean) / np.maximum(some, 1e-12), 1.0)
        by_sentence = pull[bag] * p
        g = np.append(np.bincount(ids, by_sentence[sentence], minlength=n_features), by_sentence.sum() + (pull * plain).sum() * p0)
        g[:-1] += decay * w[:-1] / max(len(y), 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w[:-1], float(w[-1])


def minus_log_clean(z: np.ndarray) -> np.ndarray:
    """-log of the probability that a sentence of the sum ``z`` is clean."""
    return -np.log1p(-np.minimum(1 / (1 + np.exp(-np.clip(z, -60, 60))), 1 - 1e-15))


def clean_floors(data: pd.DataFrame, weights: np.ndarray, bias: float) -> tuple[list[int], list[float]]:
    """Numbers of sentences, and for each the floor of texts of up to so many as
    -log(1 - score), from the clean bags; the last floor holds for all longer ones."""
    clean = data[data["y"] == 0]
    n = int(clean["n"].sum())
    found = [np.zeros(0)]
    for ids, sizes in zip(clean["ids"], clean["sizes"], strict=True):
        if len(sizes):
            found.append(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights[np.asarray(ids, dtype=np.int64)]))
    z = np.concatenate(found)
    levels = np.sort(minus_log_clean(bias + np.append(z, np.zeros(n - len(z)))))[::-1]
    half = float(np.log(2))
    if not n:
        return [1], [half]
    above = np.cumsum(levels) / n  # what a clean sentence adds, on average, if so many levels are above the floor
    lengths, floors, length = [], [], 1
    while True:
        k = int(np.searchsorted(above * float(length), ALLOWANCE, side="right"))
        lengths.append(length)
        floors.append(min(float(levels[k]), half) if k < len(levels) else 0.0)
        if k == 0:
            return lengths, floors
        length = max(length + 1, int(length * LENGTH_STEP))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, max_features: int = MAX_FEATURES) -> dict:
    """The model: {"bias", "weights", "lengths", "floors", "floor"}; its size is bounded
    by ``max_features``. ``floor`` is the last of the floors, as a score.
    Without labels of both classes nothing can be learnt: no weights, and a
    bias by which each text scores below 0.5 (or, with toxic labels alone, 1)."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, per_class)
    features = select_features(sample, max_features)
    if not features:
        only = [r.y for r in sample.select("y").distinct().collect()]
        return {"bias": 40.0 if only == [1] else -40.0, "floor": 0.5, "lengths": [1], "floors": [float(np.log(2))], "weights": {}}
    data = bags(sample, features)
    weights, bias = fit_noisy_or(data, len(features))
    lengths, floors = clean_floors(data, weights, bias)
    return {"bias": bias, "floor": float(-np.expm1(-floors[-1])), "lengths": lengths, "floors": floors,
            "weights": {f: float(x) for f, x in zip(features, weights, strict=True)}}


class _Words(dict):
    """Weight of a word, the sum over its features; filled as words come."""

    def __init__(self, weights: dict):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        x = sum(self.weights.get(f, 0.0) for f in word_features(word))
        self[word] = x
        return x


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences and ``offending`` (start, end, score of each
    sentence whose own score is 0.5 or more, and of the highest one of a
    document that scores so) for every document row. Null and empty
    texts have no sentence and score 0; repeated rows score alike."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs, id_col, text_col).mapInPandas(
        _scorer(held), "doc_id long, score double, n_sentences int, "
                       "offending array<struct<start: int, end: int, score: double>>")


def _scorer(held):
    def run(batches):
        bias, word = held.value["bias"], _Words(held.value["weights"])
        lengths, floors = held.value["lengths"], held.value["floors"]
        get = word.__getitem__
        for b in batches:
            scores, counts, offending = [], [], []
            for text in b["text"]:
                # numbers alone stay of a sentence, so a long text costs 16 bytes for each
                starts, ends, sums = array("i"), array("i"), array("d")
                for start, end, ws in each_sentence(text):
                    starts.append(start)
                    ends.append(end)
                    sums.append(sum(map(get, ws)))
                n = len(sums)
                adds = minus_log_clean(bias + np.array(sums, dtype=float))
                score, bad = 0.0, []
                if n:
                    floor = floors[min(bisect_left(lengths, n), len(floors) - 1)]
                    # a score at the floor may come out a little above it by the order of the sum
                    score = float(-np.expm1(-max(adds[adds > floor + 1e-9].sum(), adds.max())))
                    bad = np.flatnonzero(adds >= np.log(2)).tolist()
                    if score >= 0.5 and not bad:
                        bad = [int(adds.argmax())]
                scores.append(score)
                counts.append(n)
                offending.append([{"start": starts[i], "end": ends[i], "score": float(-np.expm1(-adds[i]))} for i in bad])
                if len(word) > CACHE_WORDS:
                    word.clear()
            # a nullable integer id would turn into a float in pandas: keep it as it came
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": scores, "n_sentences": counts,
                                "offending": offending})
    return run


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and n_offending of every document
    row; a null id was never learnt from, so it is held out."""
    scored = score_documents(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", F.coalesce(~in_training_part("doc_id"), F.lit(True)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("offending").alias("n_offending"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below 0.5. The score
    is computed beside the row, so no join and no clash of names is possible."""
    model = train(docs, labels, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        frames = (pd.DataFrame({"doc_id": pd.Series(range(len(texts)), dtype="Int64"), "text": texts.fillna("")}) for texts in batches)
        for scored in _scorer(held)(frames):
            yield scored["score"]

    return docs.where(score(F.col(text_col).cast("string")) < 0.5)
