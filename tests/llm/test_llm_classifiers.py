import math
import re
import zlib

import numpy as np
import pytest

from ragframe.llm import langid, toxicity
from ragframe.llm.queries import QUERIES
from conftest import SF01


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"](spark, SF01).collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held_out(r.doc_id) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in judged]) >= 0.9


def test_toxicity_rows_and_spans(spark):
    docs = [(i, f"Calm words here. {'You awful fool. ' if i % 2 else ''}More calm text", "en", 0.5) for i in range(60)]
    docs += [(None, "You awful fool", "en", 1.0), (100, None, None, None), (101, "", "en", 0.0), (7, docs[7][1], "en", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, 1, None), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    rows = toxicity.score_documents(df, model).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = next((t for i, t, _, _ in docs if i == r.doc_id), None) or ""
        assert (r.score >= 0.5) == ("fool" in text)
        assert all("fool" in text[o.start:o.end] for o in r.offending) and bool(r.offending) == ("fool" in text)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == sum("fool" not in (t or "") for _, t, _, _ in docs)
    assert toxicity.predictions(df.limit(0), labels).count() == 0
    none = toxicity.predictions(df, labels.limit(0)).collect()
    assert len(none) == len(docs) and all(r.predicted == 0 for r in none)


def test_long_clean_texts_stay(spark):
    """Clean texts of 10,000 sentences and more, without features and of real held-out documents."""
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    clean = docs.join(labels.where("toxic = 0").select("doc_id"), "doc_id").orderBy("doc_id").select("doc_id", "text")
    fine = {r.doc_id for r in toxicity.score_documents(clean, model).where("score < 0.5").collect()}
    texts = [r.text for r in clean.collect() if held_out(r.doc_id) and r.doc_id in fine]
    joined = "\n".join(texts)
    n = 10_000 // len(toxicity.sentences(joined)) + 1
    rows = [(1, "\n".join([joined] * n)), (2, "Zzqx zzqy. " * 20_000), (3, "Zzqx zzqy. " * 100_000)]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert all(r.n_sentences >= 10_000 and r.score < 0.5 and not r.offending for r in got)
    assert 0 < model["floor"] <= 0.5


def plain_scores(rows, model):
    """doc_id -> score, sentence by sentence from the model's weights, bias and floors."""
    out = {}
    for i, text in rows:
        logs = []
        for part in re.split(r"[.!?\n]", text or ""):
            words = re.findall(r"[^\W\d_]+", part.lower())
            if words:
                z = model["bias"] + sum(model["weights"].get(f, 0.0) for w in words
                                        for f in ["w:" + w, *(f"{n}:{w[:n]}" for n in (4, 5) if len(w) > n)])
                logs.append(-math.log1p(-min(1 / (1 + math.exp(-max(-60, min(60, z)))), 1 - 1e-15)))
        floor = next((f for n, f in zip(model["lengths"], model["floors"]) if len(logs) <= n), model["floors"][-1])
        out[i] = -math.expm1(-max(sum(x for x in logs if x > floor + 1e-9), max(logs))) if logs else 0.0
    return out


def test_toxicity_equals_plain_scores_and_ranks(spark):
    """On sf0.1 (97 held-out toxic documents; sf0.01 has too few to rank), fitted once: every
    score as computed plainly; held-out documents are ranked, not only split."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_scores(rows, model)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    y = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    bad, fine = ([got[i] for i in got if held_out(i) and y.get(i) == c] for c in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in fine]) >= 0.97
    assert np.mean([a >= 0.5 for a in bad]) >= 0.85 and np.mean([a >= 0.5 for a in fine]) <= 0.01
    ties = np.unique([round(got[i], 12) for i, t in rows if t], return_counts=True)[1]
    assert ties.max() <= 0.05 * len(rows)


def test_floors_bound_what_clean_sentences_add():
    import pandas as pd
    data = pd.DataFrame({"y": [0, 0, 1], "n": [500, 300, 9], "ids": [[0, 1], [1], [2]], "sizes": [[1, 1], [1], [1]]})
    lengths, floors = toxicity.clean_floors(data, np.array([6.0, 3.0, 12.0]), -8.0)
    clean = toxicity.minus_log_clean(np.array([-2.0, -5.0, -5.0] + [-8.0] * 797))
    assert floors == sorted(floors) and floors[0] == 0 and abs(floors[-1] - clean.max()) < 1e-12
    assert all(n * clean[clean > f].sum() / len(clean) <= toxicity.ALLOWANCE + 1e-9 for n, f in zip(lengths, floors))
    assert toxicity.clean_floors(data[data.y == 1], np.zeros(3), -8.0) == ([1], [float(np.log(2))])


def test_noisy_or_gradient():
    """The fit reaches the labels of bags whose one telling feature is known."""
    import pandas as pd
    data = pd.DataFrame({"y": [1, 0, 1, 0], "weight": [1.0] * 4, "n": [5, 5, 3, 3],
                         "ids": [[0, 1], [1], [0], [1, 1]], "sizes": [[1, 1], [1], [1], [1, 1]]})
    w, b = toxicity.fit_noisy_or(data, 2)
    assert w[0] + b > 0 > w[1] + b and b < 0


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op8_language_id"](spark, SF01).collect()
    assert len(rows) == len(lang)
    assert all(r.lang_pred in {*lang.values(), "und"} and r.held_out == held_out(r.doc_id) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) >= 0.95


def test_language_rows(spark):
    docs = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "x") for i in range(40)]
    docs += [(50, None, "en", "x"), (51, "", None, "x"), (52, "123 --", "de", "x"), (None, "the dog", "en", "x"),
             (54, "catdog thecat", None, "x"), (54, "catdog thecat", None, "x"), (55, "die katze " * 100_000, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    rows = langid.predictions(df).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    assert got[50].lang_pred == got[51].lang_pred == got[52].lang_pred == "und" and got[52].score == 0
    assert got[54].lang_pred == "en" and got[55].lang_pred == "de" and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.predictions(df.limit(0)).count() == 0
    unlearnt = langid.predictions(df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null")).collect()
    assert all(r.lang_pred == "und" for r in unlearnt)


@pytest.mark.parametrize("word", ["a", "ab", "abcdef"])
def test_grams(word):
    assert langid.grams(word, 1) == list(word)
    assert all(len(g) == 3 for g in langid.grams(word, 3))
