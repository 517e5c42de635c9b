import math

import numpy as np
import pytest

from ragframe.llm import vectors
from ragframe.llm.queries import QUERIES
from conftest import SF01
from test_llm_near import components_of

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, vector string"


def brute(rows, threshold=0.95):
    good = {i: np.array(v, dtype=float) for i, v in rows
            if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = set()
    for d in {len(v) for v in good.values()}:
        ids = [i for i in good if len(good[i]) == d]
        m = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
        links |= {(ids[x], ids[y]) for x, y in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1)), strict=True)}
    group = components_of([i for i, _ in rows], links)
    degree = dict.fromkeys(group, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {i: (degree[i], group[i], group[i] == i) for i in group}, len(links)


def planted(seed=5, dim=64, base=400):
    """Random vectors, copies at all closenesses around the threshold, a dense group, exact copies, and bad ones."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((base, dim))
    near = [m[rng.integers(base)] + rng.standard_normal(dim) * s for s in np.linspace(0.01, 0.4, 300)]
    dense = m[0] + rng.standard_normal((150, dim)) * 0.15
    rows = [v.astype(np.float32).tolist() for v in [*m, *near, *dense, *[m[1]] * 30]]
    rows += [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim,
             [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0], [3e38] * dim]
    return [(i + 10, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 16])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = planted()
    want, n = brute(rows)
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in got), "a link below the threshold"
    recall = sum(g[0] for g in got.values()) / (2 * n)
    assert recall >= 0.98, recall
    # exact copies and vectors apart from others never depend on the filters
    assert all(got[i] == want[i] for i in got if want[i][0] == 0)


def test_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0, 1, "x"), (1, [1.0, 0.0], 0, 1, "x"), (2, [2.0, 0.0], 0, 1, "x"),
                                (3, [-0.0, 1.0], 0, 1, "x"), (4, [0.0, 1.0], 0, 1, "x"), (None, [0.0, 1.0], 0, 1, "x")], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_vectors(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_list_decode_finds_every_direction():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((50, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rotation, cuts, code = vectors.product_code(12, 3, 5)
    row, at = vectors.list_decode(unit, 1.5, rotation, cuts, code)
    turned = unit @ rotation
    want = set()
    for n in range(125):
        words = [n // 25, n // 5 % 5, n % 5]
        product = sum(turned[:, c] @ w[i] for c, w, i in zip(cuts, code, words, strict=True))
        want |= {(r, n) for r in np.flatnonzero(product >= 1.5).tolist()}
    assert set(zip(row.tolist(), at.tolist(), strict=True)) == want


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op5_vector_near_dedup"](spark, SF01).collect()}
    assert got == brute(rows)[0]


@pytest.mark.parametrize("n", [1_000, 200_000, 20_000_000])
@pytest.mark.parametrize("dim", [8, 64])
def test_isolated_pairs_share_a_filter(n, dim):
    """Pairs just above the threshold, with the codes of a table of n vectors."""
    rng = np.random.default_rng(n + dim)
    x, y = rng.standard_normal((2, 3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + math.sqrt(1 - 0.951 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    codes, blocks, words = vectors.code_shape(n, dim, 0.95)
    shared = np.zeros(len(x), dtype=bool)
    for k in range(codes):
        code = vectors.product_code(dim, blocks, words, k)
        (a, at), (b, bt) = (vectors.list_decode(v, None, *code) for v in (x, y))
        assert len(set(a.tolist())) == len(x), "a vector without a filter"
        ours = set(zip(a.tolist(), at.tolist(), strict=True))
        shared[[r for r, d in zip(b.tolist(), bt.tolist(), strict=True) if (r, d) in ours]] = True
    print(n, dim, codes, blocks, words, 1 - shared.mean())
    assert shared.mean() >= 0.998, shared.mean()
