from pyspark.sql import functions as F

from ragframe.functions.vectors import parse_vector
from ragframe.operators.collection import (append, columns_to_rows, create_if_missing, fold_extras,
                                           load_collection, rows_to_columns)
from ragframe.operators.validation import conform_collection, question_status
from ragframe.session import scratch_path


def test_vector_edges(spark):
    df = spark.createDataFrame([("[1.5, -2,3e-2]",), ("[]",), ("[1,x]",), ("[1,2,3]",)], "v string")
    rows = df.select(parse_vector(F.col("v")).alias("e")).collect()
    assert [round(x, 6) for x in rows[0].e] == [1.5, -2.0, 0.03]
    c = df.select(F.lit("f").alias("file_id"), F.lit("t").alias("content"),
                  parse_vector(F.col("v")).alias("embedding"))
    ok, bad = conform_collection(c, 3)
    assert ok.count() == 2 and sorted(r.status for r in bad.collect()) == ["bad_dimension", "missing_embedding"]
    ok1, bad1 = conform_collection(c.filter(F.size("embedding") == 3), 3)
    assert ok1.count() == 2 and bad1.count() == 0


def test_request_edges(spark):
    rows = [(None, "u", "f"), ("", None, None), ("q", "", "f"), ("q", "u", None), ("q", "u", "f")]
    df = spark.createDataFrame(rows, "q string, u string, f string")
    got = [r.s for r in df.select(question_status(F.col("q"), F.col("u"), F.col("f")).alias("s")).collect()]
    assert got == ["missing_question", "missing_question", "missing_user", "missing_file", "ok"]


def _rows(spark):
    return spark.createDataFrame([("a", i, f"t{i}", [0.1, 0.2]) for i in range(3)] + [("b", 0, "u", [0.3, 0.4])],
                                 "file_id string, chunk_no long, content string, embedding array<float>")


def test_append_same_batch_is_idempotent(spark):
    path = scratch_path(spark, "t-coll")
    create_if_missing(spark, path)
    df = _rows(spark)
    append(df, path, batch_id=7)
    append(df, path, batch_id=7)                       # retry / replay of batch 7
    assert load_collection(spark, path).count() == 4
    append(df, path)                                   # a new batch is an append
    assert load_collection(spark, path).count() == 8


def test_replace_files_removes_earlier_rows(spark):
    path = scratch_path(spark, "t-coll")
    create_if_missing(spark, path)
    df = _rows(spark)
    append(df, path)
    append(df.filter(F.col("file_id") == "a").filter(F.col("chunk_no") < 2), path, replace_files=True)
    col = load_collection(spark, path)
    assert sorted((r.file_id, r.chunk_no) for r in col.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    assert col.select("id").distinct().count() == 3


def test_columns_rows_round_trip(spark):
    df = spark.createDataFrame([(1, i, f"c{i}") for i in range(5)], "f long, n long, c string")
    cols = rows_to_columns(df, ["f"], "n", ["n", "c"])
    assert cols.first().c == ["c0", "c1", "c2", "c3", "c4"]
    back = columns_to_rows(cols, ["n", "c"], keep=["f"])
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_fold_extras(spark):
    df = spark.createDataFrame([(1, "x", None)], "id long, a string, b double")
    r = fold_extras(df, ["id"]).first()
    assert r.extras == {"a": "x"}


def test_search_collection_prunes_partitions(spark):
    from ragframe.operators.collection import search_collection
    path = scratch_path(spark, "t-coll")
    create_if_missing(spark, path, n_buckets=8)
    df = spark.createDataFrame([(f"f{i}", j, f"t{i}{j}", [float(i), float(j)]) for i in range(20) for j in range(3)],
                               "file_id string, chunk_no long, content string, embedding array<float>")
    append(df, path, n_buckets=8)
    qs = spark.createDataFrame([(1, "f3", [3.0, 0.2])], "qid long, file_id string, embedding array<float>")
    r = search_collection(spark, path, qs, 2, output_fields=["content"])
    assert [x.content for x in r.orderBy("rank").collect()] == ["t30", "t31"]
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(file_bucket" in plan


def test_upload_registry_append_is_replay_safe(spark):
    from ragframe.operators.collection import append_registry, load_registry
    path = scratch_path(spark, "t-registry")
    rows = spark.createDataFrame([("u1", "a.docx", "wordDoc/u1.docx"), ("u2", "b.docx", "wordDoc/u2.docx")],
                                 "file_uuid string, filename string, storage_path string")
    append_registry(rows, path)
    append_registry(rows, path)                         # replay
    more = spark.createDataFrame([("u3", "c.docx", "wordDoc/u3.docx"), ("u1", "a.docx", "wordDoc/u1.docx")],
                                 rows.schema)
    append_registry(more, path)
    assert sorted(r.file_uuid for r in load_registry(spark, path).collect()) == ["u1", "u2", "u3"]


def test_replayed_batch_replaces_all_of_it(spark):
    path = scratch_path(spark, "t-coll")
    wide = spark.createDataFrame([(f"f{i}", k, "t", [0.1, 0.2]) for i in range(6) for k in (0, 1)],
                                 "file_id string, chunk_no long, content string, embedding array<float>")
    append(wide, path, batch_id=7)
    append(wide, path, batch_id=8)
    append(wide.where("file_id = 'f3'"), path, batch_id=7)
    col = load_collection(spark, path)
    assert col.where("ingest_batch = 7").count() == 2 and col.where("ingest_batch = 8").count() == 12
    append(wide.limit(0), path, batch_id=8)
    assert load_collection(spark, path).where("ingest_batch = 8").count() == 0


def test_bucket_count_is_stored(spark):
    import pytest
    from ragframe.operators.collection import search_collection, stored_buckets
    path = scratch_path(spark, "t-coll")
    df = spark.createDataFrame([(f"f{i}", k, f"{i}-{k}", [float(i), float(k)]) for i in range(6) for k in (0, 1)],
                               "file_id string, chunk_no long, content string, embedding array<float>")
    append(df, path, n_buckets=8)
    append(df, path)                                   # the same rows again
    assert stored_buckets(spark, path) == 8
    qs = df.where("chunk_no = 0").select(F.col("content").alias("qid"), "file_id", "embedding")
    r = search_collection(spark, path, qs, 3, output_fields=["content"]).collect()
    assert sorted((x.qid, x.rank, x.content) for x in r) == sorted((f"{i}-0", k + 1, f"{i}-{k}") for i in range(6) for k in (0, 1))
    by_number = search_collection(spark, path, qs, 3, id_col="chunk_no", output_fields=["content"]).collect()
    assert sorted((x.qid, x.rank, x.content) for x in by_number) == sorted((x.qid, x.rank, x.content) for x in r)
    with pytest.raises(ValueError):
        search_collection(spark, path, qs, 3, n_buckets=64)
    with pytest.raises(ValueError):
        append(df, path, n_buckets=16)


def test_rejected_rows_are_kept_and_replaced_with_their_batch(spark):
    from ragframe.operators.collection import append_conformed, load_rejected
    path = scratch_path(spark, "t-coll")
    df = spark.createDataFrame([("a", 0, "ok", [0.1, 0.2]), ("a", 1, "x" * 30001, [0.1, 0.2]), ("b", 0, "no vector", None),
                                ("c", 0, "short", [0.1])], "file_id string, chunk_no long, content string, embedding array<float>")
    for _ in range(2):
        append_conformed(df, path, 2, batch_id=3)
    assert load_collection(spark, path).count() == 1
    assert sorted((r.file_id, r.chunk_no, r.status) for r in load_rejected(spark, path).collect()) == [
        ("a", 1, "content_too_long"), ("b", 0, "missing_embedding"), ("c", 0, "bad_dimension")]
    append_conformed(df.where("file_id = 'b'"), path, 2, batch_id=3)
    assert load_collection(spark, path).count() == 0 and load_rejected(spark, path).count() == 1


def _files(path):
    import glob
    return glob.glob(f"{path}/ingest_batch=*/**/*.parquet", recursive=True)


def test_replacing_one_file_of_many_writes_its_rows_only(spark):
    import os
    path = scratch_path(spark, "t-coll")
    wide = spark.range(1000).select(F.concat(F.lit("f"), F.col("id")).alias("file_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_no"),
                                    F.lit("text").alias("content"), F.array(F.lit(0.1), F.lit(0.2)).alias("embedding"))
    append(wide, path, batch_id=1, n_buckets=8)
    before = {f: os.path.getmtime(f) for f in _files(path)}
    new = spark.createDataFrame([("f7", 0, "new", [0.5, 0.5])], "file_id string, chunk_no long, content string, embedding array<float>")
    append(new, path, batch_id=2, replace_files=True)
    after = {f: os.path.getmtime(f) for f in _files(path)}
    assert {f: t for f, t in after.items() if f in before} == before and len(set(after) - set(before)) == 1
    col = load_collection(spark, path)
    assert col.count() == 1999 and [r.content for r in col.where("file_id = 'f7'").collect()] == ["new"]
    # batch 3 replaces the file again; replays of 2 and 1 bring nothing back and bury nothing more
    append(new.withColumn("content", F.lit("newer")), path, batch_id=3, replace_files=True)
    append(new, path, batch_id=2, replace_files=True)
    append(wide, path, batch_id=1)
    col = load_collection(spark, path)
    assert col.count() == 1999 and [r.content for r in col.where("file_id = 'f7'").collect()] == ["newer"]
    assert "PartitionFilters: [isnotnull(file_bucket" in col.where("file_bucket = 3")._jdf.queryExecution().executedPlan().toString()


def test_compaction_keeps_rows_and_bounds_files(spark):
    from ragframe.operators.collection import _compactions, compact, search_collection
    path = scratch_path(spark, "t-coll")
    create_if_missing(spark, path, 4)
    for b in range(40):
        rows = [(f"f{(b * 3 + j) % 20}", b, f"{b}-{j}", [float(b), float(j)]) for j in range(3)]
        append(spark.createDataFrame(rows, "file_id string, chunk_no long, content string, embedding array<float>").coalesce(1),
               path, batch_id=100 + b, replace_files=b == 30)
    qs = spark.createDataFrame([(i, f"f{i}", [3.0, 1.0]) for i in range(20)], "qid long, file_id string, embedding array<float>")

    def state():
        col = load_collection(spark, path)
        found = search_collection(spark, path, qs, 3, output_fields=["content"])
        return sorted(tuple(r) for r in col.drop("ingest_batch").collect()), sorted(tuple(r) for r in found.collect())
    before, n_files = state(), len(_files(path))
    merged = compact(spark, path, keep=2)
    assert state() == before and len(_files(path)) <= 4 + 2 * 4 < n_files
    assert {old for old, m in _compactions(spark, path) if m == merged} == set(range(100, 138))
    # a replay of a closed batch changes nothing, one of an open batch replaces it
    append(_rows(spark), path, batch_id=105)
    assert state() == before
    append(_rows(spark), path, batch_id=139)
    assert load_collection(spark, path).where("ingest_batch = 139").count() == 4
    assert compact(spark, path, keep=2) is None
    for b in range(5):
        append(_rows(spark), path, batch_id=200 + b)
    n = load_collection(spark, path).count()
    compact(spark, path, keep=0)
    assert load_collection(spark, path).count() == n and len(_files(path)) <= 4


def test_compaction_that_ends_early_loses_nothing(spark):
    from ragframe.operators.collection import _batch_folders, compact
    path = scratch_path(spark, "t-coll")
    for b in (1, 2, 3):
        append(_rows(spark), path, batch_id=b, n_buckets=2)
    # ended after the log, before the rename: the log names a folder that is not there
    spark.createDataFrame([(1, 77), (2, 77)], "old long, merged long").write.mode("append").parquet(f"{path}/_compactions")
    _rows(spark).write.parquet(f"{path}/_staging-77")
    assert load_collection(spark, path).count() == 12
    append(_rows(spark).limit(1), path, batch_id=2)          # still open
    assert load_collection(spark, path).count() == 9
    merged = compact(spark, path, keep=1)
    assert set(_batch_folders(spark, path)) == {merged, 3} and load_collection(spark, path).count() == 9
