"""MinHash near-dedup and connected components against brute force."""

import random
from collections import defaultdict

import pytest

from ragframe.llm import buckets, minhash
from ragframe.llm.components import connected_components
from ragframe.llm.queries import QUERIES
from conftest import SF01


def components_of(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, k, percent):
    """All pairs that share a shingle, compared on their full sets."""
    sets = {i: shingles(t, k) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                shared[min(a, b), max(a, b)] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    group = components_of(sets, links)
    return {i: (len(s), group[i], group[i] == i) for i, s in sets.items()}, links


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5), (7, 6), (6, 7)]
    df = spark.createDataFrame(edges + [(None, 3), (3, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert got == components_of(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    want, links = brute(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_minhash_near_dedup"](spark, SF01).collect()}
    assert links and got == want


def chain(rng, n, words=60):
    """Texts of which each is a copy of the one before with a word changed."""
    text = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    for _ in range(n):
        yield " ".join(text)
        text = list(text)
        text[rng.randrange(words)] = f"v{rng.randrange(10 ** 6)}"


@pytest.mark.parametrize("block", [512, 4])
def test_chains_edges_and_clashing_columns(spark, monkeypatch, block):
    monkeypatch.setattr(buckets.open_members, "__defaults__", (block,))
    rng = random.Random(block)
    texts = [t for _ in range(6) for t in chain(rng, 12)] + ["same words here and there"] * 40
    texts += ["", " \n", None, "one", "One", "one two", "ONE\ttwo", "x " * 30_000, "X " * 30_000 + "y", "É é", "é é"]
    rows = [(i * 3 + 1, t, i, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, kept string")
    want, _ = brute([(i, t) for i, t, _, _ in rows], 3, 85)
    found = minhash.near_duplicates(df, k=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == want
    again = df.unionByName(df.where("doc_id = 4")).unionByName(spark.createDataFrame([(None, texts[0], 0, "k")], df.schema))
    found = minhash.near_duplicates(again, k=3, percent=85).collect()
    assert len(found) == len(rows) + 2 and [r.kept for r in found if r.doc_id is None] == [True]
    left = minhash.drop_near_duplicates(again, k=3, percent=85)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == sorted(i for i, x in want.items() if x[2])
    assert minhash.near_duplicates(df.limit(0)).count() == 0
