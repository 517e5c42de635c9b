"""Phrase collocations against counting phrase by phrase."""

import re
from collections import Counter

import numpy as np
import pytest

from ragframe.llm import phrases
from ragframe.llm.queries import QUERIES
from conftest import SF001


def brute(rows, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    out = []
    for (lang, words), a in f.items():
        if len(words) < 2 or a < min_count:
            continue
        score, k = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
        inside = any(g == lang and len(w) > len(words) and b >= min_count and 100 * b >= 80 * a
                     and any(w[i:i + len(words)] == words for i in range(len(w))) for (g, w), b in f.items())
        if not inside:
            out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0].encode(), -r[6], -r[2], r[1].encode()))
    ranked, seen = [], Counter()
    for lang, phrase, *numbers in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, *numbers))
    return sorted(ranked)


def texts():
    rng = np.random.default_rng(4)
    words = ["a", "b", "c", "The", "the", "é", "日本", "x\x01y", "\x00", "don't", "a-b", "İ"]
    rows = []
    for i in range(300):
        seps = rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ". ", "\x0b", "?"], size=30)
        rows.append((["en", "fr", None, "z z", "en\nx"][i % 5], "".join(w + s for w, s in zip(rng.choice(words, size=30), seps, strict=True))))
    return rows + [("en", None), ("en", ""), ("fr", " \t\n"), (None, "a b c the a b c the"), ("en", "solo"), *[("en", "one two three four")] * 40]


@pytest.mark.parametrize("budget", [20, 400_000])
def test_against_counting(spark, budget):
    rows = texts()
    df = spark.createDataFrame([(i, t, lang, "x", 3) for i, (lang, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, leaf string, n int").repartition(7)
    got = phrases.collocations(df, min_count=12, top=25, budget=budget).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = brute(rows, 12, 25)
    assert sorted(map(tuple, got.collect())) == want and len({r[0] for r in want}) >= 3
    # absorbed by the longer candidate, but not the other way round
    assert ("en", "one two three four") in {(r[0], r[2]) for r in want} and not {"one two", "two three four"} & {r[2] for r in want}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(df).count() == 0
    one = spark.createDataFrame([(1, "a b. a b", None), (2, None, "x")], "doc_id long, text string, lang string")
    assert phrases.collocations(one).count() == 0
    assert [tuple(r) for r in phrases.collocations(one, min_count=2).collect()] == [("und", 1, "a b", 2, 2, 2, 4, 1_000_000)]


@pytest.mark.parametrize("chunk", [7, 40, 1000, 10**9])
def test_long_texts_are_counted_the_same_in_slices(monkeypatch, chunk):
    """Windows do not depend on where a long text is cut: between pieces, at spaces, or around giant words."""
    import pyarrow as pa
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = texts() + [("en", "w" * 500 + " " + "v" * 90), ("en", "one two three four five six " * 60), ("en", ("a b c d. " * 50) + "e f g h " * 50)]

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run

    def emit(lang, w, windows):
        names = [None, *w.texts.to_pylist()]
        yield from ((lang, tuple(names[x] for x in row if x)) for row in windows)
    docs = Docs()
    phrases._by_chunk(docs, emit, None, "")
    table = pa.table({"lang": [lang or "und" for lang, _ in rows], "text": [t or "" for _, t in rows]})
    got = Counter(docs.run(table.to_batches(max_chunksize=50)))
    want = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", tuple(words[i:i + 4])) for i in range(len(words)))
    assert got == want


def test_pair_filter_lets_every_frequent_pair_through(spark, monkeypatch):
    df = spark.createDataFrame(texts(), "lang string, text string").fillna("und", ["lang"]).fillna("", ["text"])
    for bits in (1 << 31, 1 << 16):
        monkeypatch.setattr(phrases, "MAX_BITS", bits)
        bitmap = phrases._pair_filter(df, 12)
        assert 0 < np.unpackbits(bitmap).sum() <= 200 and len(bitmap) == 1 << 13


def test_query_runs_over_the_whole_table(spark):
    rows = QUERIES["op11_phrase_collocations"](spark, SF001).collect()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert sorted(map(tuple, rows)) == brute([(d.lang, d.text) for d in docs], 30, 2000)
