import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ragframe.operators.context import context_pack
from ragframe.operators.search import build_ivf, recall_at_k, topk, topk_ivf, topk_single


def _vecs(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    c = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("file_id"), "embedding")
    q = e.select(F.col("vec_id").alias("qid"), F.col("label").cast("string").alias("file_id"), "embedding")
    return e, c, q


def _brute(e_rows, k, offset=0):
    out = {}
    for q in e_rows:
        cand = []
        for c in e_rows:
            if c.label != q.label:
                continue
            d = 0.0
            for x, y in zip(c.embedding, q.embedding):
                d += (float(x) - float(y)) * (float(x) - float(y))
            cand.append((d, c.vec_id))
        cand.sort()
        out[q.vec_id] = [i for _, i in cand[offset:offset + k]]
    return out


def test_topk_matches_brute_force_and_salted_path(spark):
    e, c, q = _vecs(spark)
    rows = e.collect()
    exp = _brute(rows, 10)
    for kw in ({}, {"broadcast_max_bytes": 0, "salt": 5}, {"broadcast_max_bytes": 0, "salt": 3, "question_block_bytes": 200000},
               {"engine": "jvm"}, {"engine": "jvm", "broadcast_max_bytes": 0, "salt": 5}):
        got = {}
        for r in topk(c, q, 10, **kw).collect():
            got.setdefault(r.qid, []).append((r.rank, r.id))
        assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == exp
    page = {}
    for r in topk(c, q, 10, offset=10).collect():
        page.setdefault(r.qid, []).append((r.rank, r.id))
    assert {k: [i for _, i in sorted(v)] for k, v in page.items()} == _brute(rows, 10, 10)


def test_topk_single_with_predicate(spark):
    e, c, _ = _vecs(spark)
    rows = e.collect()
    qv = rows[0].embedding
    got = [r.id for r in topk_single(c, qv, 5, where=F.col("file_id") == "0").collect()]
    cand = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(r.embedding, qv)), r.vec_id)
                  for r in rows if r.label == 0)
    assert got == [i for _, i in cand[:5]]


def test_ivf_full_probe_is_exact_and_recall_reported(spark):
    e, c, q = _vecs(spark)
    cents, assigned = build_ivf(c, 8)
    exact = topk(c, q, 10)
    full = topk_ivf(assigned, cents, q, 10, nprobe=8)
    assert sorted(exact.select("qid", "id").collect()) == sorted(full.select("qid", "id").collect())
    blocked = topk_ivf(assigned, cents, q, 10, nprobe=8, broadcast_max_bytes=50000, salt=3)
    assert sorted(exact.collect()) == sorted(blocked.collect())
    r = recall_at_k(topk_ivf(assigned, cents, q, 10, nprobe=2), exact).first().recall
    assert 0.2 < r <= 1.0


@pytest.mark.parametrize("tokens,expected", [([4000, 5000, 1000, 10], 2), ([10000], 0), ([], 0),
                                             ([9999, 1], 1), ([0, 0, 10000], 2)])
def test_budget_edges(spark, tokens, expected):
    ranked = spark.createDataFrame([(1, i + 1, f"c{i}", t) for i, t in enumerate(tokens)],
                                   "qid long, rank long, content string, num_tokens long")
    qs = spark.createDataFrame([(1,)], "qid long")
    r = context_pack(ranked, qs).first()
    assert r.n_chunks == expected
    assert r.context == "".join(f"c{i}\n" for i in range(expected))


def test_null_tokens_are_quarantined(spark):
    ranked = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", 5)],
                                   "qid long, rank long, content string, num_tokens long")
    r = context_pack(ranked, spark.createDataFrame([(1,)], "qid long")).first()
    assert r.context == "b\n"
    packed, rejected = context_pack(ranked, with_rejected=True)
    assert packed.first().context == "b\n"
    assert [(x.qid, x.rank, x.content, x.reject_reason) for x in rejected.collect()] == [(1, 1, "a", "bad_num_tokens")]


def test_arrow_engine_equals_jvm_engine(spark):
    e, c, q = _vecs(spark)
    a = sorted(tuple(r) for r in topk(c, q, 10, engine="jvm").collect())
    b = sorted(tuple(r) for r in topk(c, q, 10, engine="arrow").collect())
    assert a == b
    pa = sorted(tuple(r) for r in topk(c, q, 10, offset=10, engine="jvm").collect())
    pb = sorted(tuple(r) for r in topk(c, q, 10, offset=10, engine="arrow").collect())
    assert pa == pb


def test_kernel_chunks_questions_consistently():
    from ragframe.operators.search import kernel_candidates
    rng = np.random.default_rng(1)
    cm, qm = rng.normal(size=(50, 16)), rng.normal(size=(37, 16))
    ids, qids = np.arange(50), np.arange(100, 137)
    a = kernel_candidates(cm, ids, qm, qids, 5, q_chunk=256).sort_values(["qid", "distance"]).to_numpy()
    b = kernel_candidates(cm, ids, qm, qids, 5, q_chunk=4).sort_values(["qid", "distance"]).to_numpy()
    assert len(a) == 37 * 5
    assert (a == b).all()
    d = ((cm[:, None, :] - qm[None, :, :]) ** 2).sum(-1)
    best = np.sort(d, axis=0)[:5].T.ravel()
    assert np.allclose(np.sort(a.reshape(37, 5, 3)[:, :, 2], axis=1).ravel(), best)


def test_ties_resolved_by_id_like_the_jvm_engine(spark):
    rows = [(i, "f", [1.0, 2.0, 3.0]) for i in range(60, 0, -1)] + [(100, "f", [5.0, 5.0, 5.0])]
    c = spark.createDataFrame(rows, "id long, file_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(1, "f", [1.0, 2.0, 3.0])], "qid long, file_id string, embedding array<float>")
    a = [r.id for r in topk(c, q, 10, engine="jvm").orderBy("rank").collect()]
    b = [r.id for r in topk(c, q, 10).orderBy("rank").collect()]
    blocked = [r.id for r in topk(c, q, 10, broadcast_max_bytes=0, salt=2).orderBy("rank").collect()]
    assert a == b == blocked == list(range(1, 11))


BAD = [(8, "a", [1.0, 1.0]), (9, None, [1.0, 1.0]), (10, "a", None), (11, "a", [1.0]), (12, "a", [1.0, None]),
       (13, "a", [float("nan"), 1.0]), (14, "a", []), (15, "b", [2.0, 1.0]), (8, "a", [1.0, 1.0])]


@pytest.mark.parametrize("kw", [{}, {"engine": "jvm"}, {"broadcast_max_bytes": 1},
                                {"broadcast_max_bytes": 1, "engine": "jvm"}, {"broadcast_max_bytes": 1, "question_block_bytes": 80}])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_bad_rows_in_all_engines(spark, kw, kind):
    from ragframe.operators.search import rejected_vectors
    c = spark.createDataFrame([(str(i) if kind == "string" else i, f, v) for i, f, v in BAD],
                              f"id {kind}, file_id string, embedding array<float>")
    qs = spark.createDataFrame([("x", "a", [1.0, 1.0]), ("y", None, [1.0, 1.0]), ("z", "a", None), ("w", "b", [1.0, 1.0]),
                                ("v", "a", [1.0])], "qid string, file_id string, embedding array<float>")
    got = {(r.qid, int(r.id), r.rank) for r in topk(c, qs, 3, **kw).collect()}
    assert got == {("x", 8, 1), ("w", 15, 1)}
    wide = topk(c, qs, 3, output_fields=["file_id"], **kw).collect()
    assert sorted((r.qid, r.file_id) for r in wide) == [("w", "b"), ("x", "a")]
    assert sorted((int(r.id), r.reject_reason) for r in rejected_vectors(c, 2).collect()) == [
        (9, "missing_key"), (10, "missing_vector"), (11, "bad_vector"), (12, "bad_vector"), (13, "bad_vector"), (14, "bad_vector")]
    assert [int(r.id) for r in topk_single(c, [1.0, 1.0], 2, where=F.col("id") != "8").collect()] == [9, 15]


def test_candidates_are_bounded_per_task(spark):
    from ragframe.operators.search import _candidates
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        c = spark.range(200).select("id", F.lit("a").alias("file_id"), F.array(F.col("id").cast("float")).alias("vec")).repartition(4)
        q = spark.createDataFrame([(1, "a", [100.2])], "qid long, file_id string, qvec array<float>")
        n_tasks = 16    # the corpus is spread over at most 2 x 8 tasks
        found, _ = _candidates(c, q, "file_id", 10, "auto", 4, 1 << 20)
        rows = found.collect()
        assert len(rows) <= 10 * n_tasks and len(rows) < 200 and {r.id for r in rows} >= set(range(96, 105))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
