"""Vector codes against plain rounds in Python integers."""

import hashlib
from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from ragframe.llm import codes
from ragframe.llm.queries import QUERIES
from conftest import SF001

SCHEMA = "vec_id long, embedding array<float>, label int, code string, trees string"


def brute(rows, dim):
    kept = [(i, [floor(Fraction(float(np.float32(x))) * 4096) for x in v], lab) for i, v, lab in rows
            if v is not None and len(v) == dim and all(x is not None and isfinite(np.float32(x)) for x in v)]
    firsts = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        firsts.setdefault(i, v)
    seeds = [firsts[i] for i in sorted(firsts)[:16]]
    parts = [(dim * p // 8, dim * (p + 1) // 8) for p in range(8)]
    books = [[s[a:b] for s in seeds] for a, b in parts]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p, (a, b) in enumerate(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[nearest(v[a:b], books[p])[1]].append(v[a:b])
            for k, own in held.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, lab in kept:
        found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab])
        total[lab] += out[-1][2]
    long_ = lambda x: x if x < 2 ** 63 else None
    sums = {lab: long_(t) if all(o[2] < 2 ** 63 for o in out if o[3] == lab) else None for lab, t in total.items()}
    return sorted(((i, c, long_(e), sums[lab], digest) for i, c, e, lab in out), key=str)


def rows_of(dim, n, seed=2):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)) / 8
    m[n // 2:] = m[rng.integers(0, 5, n - n // 2)] + rng.standard_normal((n - n // 2, dim)) / 400      # dense groups: owned balls
    rows = [(int(i), [float(x) for x in v], int(i) % 3 if i % 7 else None) for i, v in zip(rng.permutation(n) + 5, m.astype(np.float32), strict=True)]
    bad = [(0, None, 1), (1, [], 1), (2, [None] + [0.5] * (dim - 1), 1), (3, [float("nan")] * dim, 1), (4, [float("inf")] * dim, 1), (0, [1.0] * (dim + 1), 1)]
    return rows + bad + [rows[3], rows[3], (None, [-0.0] * dim, 2), (rows[4][0], [0.125] * dim, 2)]


def got(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], SCHEMA)
    out = codes.vector_codes(df)
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("dim,n", [(64, 400), (8, 500), (12, 60), (3, 40), (16, 9)])
def test_codes_equal_plain_rounds(spark, dim, n):
    rows = rows_of(dim, n)
    assert got(spark, rows) == brute(rows, dim)


def test_huge_components_and_empty_tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * 10.0 ** (i % 40 - 2)], i % 4) for i in range(60)]
    assert got(spark, rows) == brute(rows, 8)
    assert any(r[2] is None for r in got(spark, rows))
    assert got(spark, []) == [] and got(spark, [(1, None, 1), (2, [None], 1)]) == []
    none = got(spark, [(None, [0.5] * 8, 1)] * 2)
    assert [r[:4] for r in none] == [(None, "00" * 8, 0, 0)] * 2


def test_balls_own_points_and_lists_shrink():
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (16, 8))
    x = (centers[rng.integers(0, 16, 2000)] + rng.integers(-60, 60, (2000, 8))).astype(np.int64)
    tree = codes.Tree(x)
    own, sums, counts, compared = tree.assign(centers)
    plain = codes.nearest(x, centers)
    assert (own == plain[tree.order]).all() and sorted(tree.order) == list(range(2000))
    assert all((sums[k] == x[plain == k].sum(axis=0)).all() and counts[k] == (plain == k).sum() for k in range(16))
    assert compared < 200            # nearly all are in wholly owned balls
    for i in range(len(tree.start)):
        inside = tree.points[tree.start[i]:tree.end[i]]
        assert np.sqrt(((inside - tree.center[i]) ** 2).sum(axis=1)).max() <= tree.radius[i]
        assert (tree.sums[i] == inside.sum(axis=0)).all()
    same = codes.Tree(np.ones((5000, 8), dtype=np.int64))
    assert same.assign(np.ones((16, 8), dtype=np.int64))[2].tolist() == [5000] + [0] * 15


def test_query_runs_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    out = QUERIES["op13_vector_codes"](spark, SF001)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, 64)
