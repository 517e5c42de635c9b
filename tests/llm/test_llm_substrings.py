import random
from collections import defaultdict

import numpy as np

from ragframe.llm import substrings
from ragframe.llm.queries import QUERIES
from conftest import SF01


def brute(rows, min_words=substrings.MIN_WORDS):
    """Spans from the chunks of all texts, chunk by chunk."""
    own, holders = {}, defaultdict(set)
    for i, text in rows:
        raw = (text or "").encode()
        if raw and i is not None:
            ends = substrings.chunk_ends(np.frombuffer(raw, dtype=np.uint8)).tolist()
            own[i] = [(s, e, raw[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            for *_, c in own[i]:
                holders[c].add(i)
    out = set()
    for i, cs in own.items():
        raw, run = b"".join(c for *_, c in cs), []
        for s, e, c in [*cs, (0, 0, None)]:
            if c is not None and len(holders[c]) > 1:
                run.append((s, e, c))
            elif run:
                a, b = run[0][0], run[-1][1]
                words = sum(1 for p in range(a, b) if raw[p] not in b" \t\n\v\f\r" and (p == 0 or raw[p - 1] in b" \t\n\v\f\r"))
                if words >= min_words:
                    out.add((i, len(raw[:a].decode("utf-8", "ignore")), words, len(run), min(min(holders[x]) for *_, x in run),
                             all(min(holders[x]) == i for *_, x in run)))
                run = []
    return out


def found(df):
    return {(r.doc_id, r.start, r.n_words, r.n_chunks, r.first_doc, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    want = brute([(i, t) for i, t in rows if t.isascii()] + [(i, t) for i, t in rows if not t.isascii()])
    got = found(QUERIES["op2_substring_dedup"](spark, SF01))
    # starts inside a character are not compared
    drop = lambda x: {(i, *rest) for i, _, *rest in x}
    assert want and drop(got) == drop(want)


def test_shared_passages_after_shifts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(51, 120))) for _ in range(40)]
    docs = []
    for d in range(120):
        own = [" ".join(word() for _ in range(rng.randrange(5, 200))) for _ in range(2)]
        docs.append((d, own[0] + " " + (passages[d // 2] if d < 80 else "") + " " + own[1]))
    repeated = "again and again the same words in one text only " * 50
    docs += [(200, None), (201, ""), (202, repeated), (203, "x"), (204, "z" * 50_000), (1, docs[1][1])]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs] + [(None, docs[0][1], "s", 1)],
                               "doc_id long, text string, start string, n int")
    rows = substrings.repeated_spans(df).collect()
    text = dict(docs)
    assert {r.doc_id for r in rows} == set(range(80))
    for r in rows:
        assert r.n_words >= substrings.MIN_WORDS and text[r.doc_id][r.start:r.end].strip() in passages[r.doc_id // 2] + " "
        assert r.kept == (r.doc_id % 2 == 0) and r.first_doc == r.doc_id // 2 * 2
    left = {r.doc_id: r.text for r in substrings.without_repeats(df, substrings.repeated_spans(df)).collect()}
    assert left[202] == repeated and left[200] is None
    for d in range(80):
        cut = [(r.start, r.end) for r in sorted(rows, key=lambda r: r.start) if r.doc_id == d and not r.kept]
        want, at = "", 0
        for s, e in dict.fromkeys(cut):
            want, at = want + text[d][at:s], e
        assert left[d] == want + text[d][at:]
    assert substrings.repeated_spans(df.limit(0)).count() == 0


def test_adjoining_passages_keep_one_copy(spark):
    """P in document 1, P directly followed by Q in 2, Q in 3: one copy of each stays."""
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    docs, parts = [], []
    for g in range(0, 60, 3):
        p, q = text(100), text(100)
        docs += [(g, f"{text(40)} {p} {text(40)}"), (g + 1, f"{text(40)} {p} {q} {text(40)}"), (g + 2, f"{text(40)} {q} {text(40)}")]
        parts += [(g, p), (g + 1, q)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = substrings.repeated_spans(df).collect()
    assert all(r.kept == (not r.cuts) for r in spans)
    left = {r.doc_id: r.text for r in substrings.without_repeats(df, substrings.repeated_spans(df)).collect()}
    # chunks at a passage's ends are lost, so its middle words are looked for
    for owner, passage in parts:
        middle = " ".join(passage.split()[30:70])
        assert [i for i, t in left.items() if middle in t] == [owner]


def test_cuts_are_local():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    a = substrings.chunk_ends(data)
    b = substrings.chunk_ends(np.concatenate([data[:100], data[50:60], data[100:]])) - 10
    assert set(a[a > 200]) == set(b[b > 200])
    long = substrings.chunk_ends(np.full(10_000, 120, dtype=np.uint8))
    assert long[-1] == 10_000 and np.diff(long, prepend=0).max() <= substrings.MAX_BYTES
