import random

import numpy as np

from ragframe.llm import decontam
from ragframe.llm.queries import QUERIES
from conftest import SF01


def brute(docs, items, threshold=0.8):
    """Best window of each item in each document, by every window."""
    out = set()
    known = [(i, decontam.split_words(t)) for i, t in items if i is not None]
    for doc_id, text in docs:
        words = decontam.split_words(text)
        grams = {tuple(words[p:p + 5]) for p in range(len(words) - 4)}
        for item_id, own in known:
            if len(own) < 5 or not any(tuple(own[p:p + 5]) in grams for p in range(len(own) - 4)):
                continue
            count = lambda ws: __import__("collections").Counter(tuple(ws[p:p + 5]) for p in range(len(ws) - 4))
            mine, best = count(own), None
            for s in range(len(words) - len(own) + 1):
                other = count(words[s:s + len(own)])
                weigh = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
                score = weigh(mine & other) / weigh(mine | other)
                if score >= threshold and (best is None or score > best[0]):
                    best = (score, s)
            if best:
                out.add((doc_id, item_id, best[1], best[1] + len(own), round(best[0], 9)))
    return out


def found(df):
    return {(r.doc_id, r.item_id, r.first_word, r.end_word, round(r.similarity, 9)) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want and found(QUERIES["op7_benchmark_decontamination"](spark, SF01)) == want


def test_edited_passages_and_rows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_CHARS", 2_000)  # several parts
    rng = random.Random(4)
    word = lambda: f"{rng.choice('abcdefg')}{rng.randrange(900)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 60)))) for i in range(40)]
    items += [(90, "too few words"), (91, None), (92, ""), (None, items[0][1]), (93, items[3][1]), (3, items[3][1])]
    docs = []
    for d in range(150):
        passage = rng.choice(items[:40])[1].split()
        for _ in range(rng.randrange(4)):
            passage[rng.randrange(len(passage))] = word()
        if d % 3 == 0:
            passage.insert(rng.randrange(len(passage)), word())
        docs.append((d, " ".join([word() for _ in range(rng.randrange(30))] + passage + [word() for _ in range(rng.randrange(30))])))
    docs += [(200, None), (201, ""), (202, "x"), (203, " ".join([items[5][1], word()] * 300)), (7, docs[7][1])]
    df = spark.createDataFrame([(i, t, 1, 0.5) for i, t in docs], "doc_id long, text string, item_id int, similarity double")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want, got = brute(docs, items), found(decontam.contaminated(df, bench))
    # fingerprints may miss what is just at the threshold; what is found is exact
    assert got <= want and len(got) >= 0.97 * len(want)
    left = decontam.drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in docs if i not in {g[0] for g in got})
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_every_fingerprint_within_the_radius_shares_a_block():
    rng = np.random.default_rng(2)
    for _ in range(500):
        bits = rng.integers(0, 2, 128)
        other = bits.copy()
        other[rng.choice(128, decontam.RADIUS, replace=False)] ^= 1
        a, b = (decontam.nibbles(np.packbits(x)[None, :].astype(np.uint8))[0] for x in (bits, other))
        assert (a == b).any()


def test_truncated_items_as_whole_documents(spark):
    """Documents that are an item less some words at either end, judged by exact similarity."""
    rng = random.Random(6)
    items = [(i, " ".join(f"{rng.choice('abcdefg')}{rng.randrange(900)}" for _ in range(rng.randrange(15, 60)))) for i in range(60)]
    docs = []
    for i, t in items:
        for less in range(1, 9):
            docs.append((1_000 * i + less, " ".join(t.split()[:-less])))
            docs.append((1_000 * i + 100 + less, " ".join(t.split()[less:])))
    want = set()
    for d, t in docs:
        text, item = t.split(), dict(items)[d // 1_000].split()
        grams = lambda ws: [tuple(ws[p:p + 5]) for p in range(len(ws) - 4)]
        weigh = lambda gs: sum(sum(map(len, g)) for g in gs)
        score = weigh(grams(text)) / weigh(grams(item))
        if score >= 0.8:
            want.add((d, d // 1_000, 0, len(text), round(score, 9)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = found(decontam.contaminated(df, bench))
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 400, (len(got), len(want))
    left = {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()}
    assert left == {d for d, _ in docs} - {x[0] for x in got}


def test_long_texts_are_fingerprinted_in_slices(monkeypatch):
    import tracemalloc
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([8, 8, 30])))) for i in range(20)]
    words = [f"w{rng.randrange(300)}" for _ in range(60_000)]
    for n, (_, text) in enumerate(items[:12]):
        words[5000 * n + 1020:5000 * n + 1020 + len(text.split())] = text.split()
    index, text = decontam.build_index(items), " ".join(words)
    tracemalloc.start()
    found = decontam.matches(index, text, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    assert {f[0] for f in found} >= set(range(12))
    assert all(f[1] == 5000 * f[0] + 1020 and f[3] == 1 for f in found if f[0] < 12)
    monkeypatch.setattr(decontam, "SLICE_WORDS", 7)
    assert decontam.matches(index, text, 0.8) == found
