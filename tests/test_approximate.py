"""Stored IVF index, hash tables and the skew-sized exact form."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ragframe.operators.ivf import build_index, nearest_centers, open_index, search_index
from ragframe.operators.lsh import topk_lsh
from ragframe.operators.search import _dealt, block_sizes, topk
from ragframe.plans.search_queries import _RANKED_SQL
from ragframe.session import scratch_path


@pytest.fixture(scope="module")
def exact():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF01}/embeddings.parquet')")
    return set(con.sql(_RANKED_SQL + " SELECT qid, id FROM ranked WHERE rnk <= 10").fetchall())


def _vecs(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    c = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("file_id"), "embedding")
    return c, c.withColumnRenamed("id", "qid")


def _recall(found, exact):
    return len({(r.qid, r.id) for r in found} & exact) / len(exact)


def test_stored_index_recall_against_sql(spark, exact):
    c, q = _vecs(spark)
    index = build_index(c, scratch_path(spark, "t-ivf"), 8)
    found = search_index(spark, index, q, 10).collect()
    assert _recall(found, exact) >= 0.9 and index.recall >= 0.95
    assert _recall(search_index(spark, index, q, 10, nprobe=8).collect(), exact) == 1
    assert all(r.rank <= 10 for r in found)


def test_index_is_built_once_and_reads_probed_cells_only(spark):
    rows = [(i, "ab"[i % 2], [float(100 * (i % 5)), float(i) / 100]) for i in range(200)]
    bad = [(900, None, [1.0, 1.0]), (901, "a", None), (902, "a", [1.0]), (903, "a", [1.0, None]), (904, "b", [float("nan"), 1.0])]
    c = spark.createDataFrame(rows + bad, "id long, file_id string, embedding array<float>")
    path = scratch_path(spark, "t-ivf")
    build_index(c, path, 5, k=3, fields=["embedding"])
    index = open_index(spark, path)
    assert sorted((r.id, r.reject_reason) for r in index.rejected(spark).collect()) == [
        (900, "missing_key"), (901, "missing_vector"), (902, "bad_vector"), (903, "bad_vector"), (904, "bad_vector")]
    assert index.nprobe == 1 and index.recall == 1 and len(index.centers) == 5
    q = spark.createDataFrame([("x", "a", [201.0, 0.5]), ("y", "b", None), ("z", "c", [0.0, 0.0]), (None, "a", [0.0, 0.0])],
                              "qid string, file_id string, embedding array<float>")
    r = search_index(spark, index, q, 3)
    assert "PartitionFilters: [cell" in r._jdf.queryExecution().executedPlan().toString()
    read = index.rows(spark).where(F.col("id").isin([x.id for x in r.collect()])).select("cell").distinct().count()
    assert read == 1
    want = sorted((sum((a - b) ** 2 for a, b in zip(v, [201.0, 0.5])), i) for i, f, v in rows if f == "a")[:3]
    got = search_index(spark, index, q, 3, output_fields=["file_id", "embedding"]).orderBy("rank").collect()
    assert [(x.qid, x.rank, x.id, x.file_id) for x in got] == [("x", n + 1, i, "a") for n, (_, i) in enumerate(want)]
    with pytest.raises(Exception):
        build_index(c, path, 5)          # an index is never overwritten


def test_index_without_good_rows(spark):
    c = spark.createDataFrame([(1, None, [1.0]), (2, "a", None)], "id long, file_id string, embedding array<float>")
    q = spark.createDataFrame([(1, "a", [1.0])], "qid long, file_id string, embedding array<float>")
    for df in (c, c.limit(0)):
        index = build_index(df, scratch_path(spark, "t-ivf"), 4)
        assert search_index(spark, index, q, 3).count() == 0


def test_nearest_centers_breaks_ties_by_number():
    centers = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 1.0]])
    assert nearest_centers(np.array([[0.0, 0.0], [0.0, 2.0]]), centers, 4).tolist() == [[0, 1, 2, 3], [1, 3, 0, 2]]


def test_hash_tables_recall_against_sql(spark, exact):
    c, q = _vecs(spark)
    found = topk_lsh(c, q, 10, tables=16, bits=3, probes=4).collect()
    assert _recall(found, exact) >= 0.9
    assert len(found) == len({(r.qid, r.rank) for r in found}) == len({(r.qid, r.id) for r in found})
    shuffled = topk_lsh(c, q, 10, tables=16, bits=3, probes=4, broadcast_max_bytes=0, question_block_bytes=20_000, slice_bytes=20_000)
    assert sorted(shuffled.collect()) == sorted(found)
    wide = topk_lsh(c, q, 2, tables=2, bits=2, probes=7, output_fields=["embedding", "file_id"]).collect()
    assert {(r.qid, r.rank): r.id for r in wide if r.rank == 1} == {(r.qid, 1): r.qid for r in q.collect()}


def test_hash_tables_leave_bad_rows_out(spark):
    c = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, [1.0, 2.0]), (3, "a", None), (4, "a", [1.0]), (1, "a", [1.0, 2.0])],
                              "id long, file_id string, embedding array<float>")
    q = spark.createDataFrame([(7, "a", [1.0, 2.0]), (8, "b", [1.0, 2.0]), (9, "a", None)], "qid long, file_id string, embedding array<float>")
    assert [(r.qid, r.rank, r.id) for r in topk_lsh(c, q, 3).collect()] == [(7, 1, 1)]
    assert topk_lsh(c.limit(0), q, 3).count() == 0 and topk_lsh(c, q.limit(0), 3).count() == 0


def test_a_hot_key_is_cut_and_others_are_not_copied(spark):
    dim, n = 8, 6000
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 3 == 0 else f"f{i % 200}", rng.standard_normal(dim).tolist()) for i in range(n)]
    c = spark.createDataFrame(rows, "id long, file_id string, embedding array<float>")
    q = c.withColumnRenamed("id", "qid")
    row, slice_bytes, block_bytes = 64 + 8 * dim, 40_000, 25_000
    cc, qq = c.withColumnRenamed("embedding", "vec"), q.withColumnRenamed("embedding", "qvec")
    sizes = block_sizes(cc, qq, "file_id", row, slice_bytes, block_bytes)
    by = {r.file_id: (r._slices, r._blocks) for r in sizes.collect()}
    assert by["hot"][0] >= 6 and by["hot"][1] >= 10 and all(v == (1, 1) for k, v in by.items() if k != "hot")
    dealt = _dealt(cc, qq, sizes, "file_id")
    groups = dealt.groupBy("file_id", "_s", "_r", "_side").count().collect()
    # no group holds more than about its bytes of questions or corpus (hashing spreads them unevenly)
    assert max(r["count"] for r in groups if r._side == 0) * row < 2 * block_bytes
    assert max(r["count"] for r in groups if r._side == 1) * row < 2 * slice_bytes
    assert dealt.where("_side = 1 and file_id <> 'hot'").count() == c.where("file_id <> 'hot'").count()
    blocked = topk(c, q, 5, broadcast_max_bytes=0, question_block_bytes=block_bytes)
    assert sorted(blocked.collect()) == sorted(topk(c, q, 5).collect())
    plan = blocked._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
