"""Tests for the findings of FINDINGS_r04.md."""

import glob
import gzip
import os

from pyspark.sql import functions as F

from ragframe.session import scratch_path
from ragframe.sources.docx import minimal_docx
from ragframe.sources.files import list_files, read_text_files, task_folder, write_files


def test_text_files_are_listed_and_read_by_tasks(spark, tmp_path):
    root = str(tmp_path / "a b+1%")
    docs = [("top.txt", b"top\r\n"), ("x/empty.txt", b""), ("x/y/z/é [1].txt", "é\r1".encode()), ("x/bytes.txt", b"a\xff"), ("w.txt.gz", gzip.compress(b"one") + gzip.compress(b"\r\n2")),
            ("x/.hidden.txt", b"x"), ("_temporary/t.txt", b"x"), ("_k=1/p.txt", b"p")] + [(f"many/{i}/d.txt", str(i).encode()) for i in range(70)]
    write_files(spark.createDataFrame(docs, "name string, content binary"), root)
    texts = read_text_files(spark, root)
    # a scan of the files themselves has all their names on the driver
    assert not [f for f in texts.inputFiles() if f.endswith((".txt", ".gz"))]
    got = {r.path: bytes(r.bytes) for r in texts.select("path", F.col("text").cast("binary").alias("bytes")).collect()}
    wanted = {"top.txt": b"top\n", "x/empty.txt": b"", "x/y/z/é [1].txt": "é\n1".encode(), "x/bytes.txt": "a\ufffd".encode(), "w.txt.gz": b"one\n2", "_k=1/p.txt": b"p"}
    wanted |= {f"many/{i}/d.txt": str(i).encode() for i in range(70)}
    assert got == {f"file://{root}/{name}": text for name, text in wanted.items()} and texts.count() == len(wanted)
    names = list_files(spark, task_folder(spark, root), ".txt")
    assert {(r.relpath, r.length) for r in names.collect()} == {(n, len(b)) for n, b in docs if n in wanted and n.endswith(".txt")}
    # what tasks cannot read is left to Spark's reader
    one, two = (f"{root}/{n}" for n in ("top.txt", "many/1?/d.txt"))
    assert task_folder(spark, one) is None and read_text_files(spark, one).first().text == "top\n" and read_text_files(spark, two).count() == 10


def test_documents_without_text_are_text_files_too(spark):
    from ragframe.plans.source_queries import q_text_files
    sf = scratch_path(spark, "t-empty")
    spark.createDataFrame([(1, "a\r\nb", "en"), (2, "", "en"), (3, None, None)], "doc_id long, text string, lang string").write.parquet(f"{sf}/documents.parquet")
    empty = "d41d8cd98f00b204e9800998ecf8427e"
    got = {r.relpath: r.text_md5 for r in q_text_files(spark, sf).collect()}
    assert got["en/doc 2 +100%.txt"] == empty and got["none/doc 3 +100%.txt"] == empty and len(got) == 3


def _land(spark, folder, names, text, mtime):
    write_files(spark.createDataFrame([(n, minimal_docx([f"{text} {n}", "body " * 40])) for n in names], "name string, content binary"), folder)
    for k, n in enumerate(names):
        os.utime(f"{folder}/{n}", (mtime + k, mtime + k))


def test_word_stream_has_no_names_of_files_on_the_driver(spark):
    from ragframe.operators.collection import load_collection, load_rejected
    from ragframe.streaming.ingest import stream_word_files
    landing, coll, ck = (scratch_path(spark, n).removeprefix("file:") for n in ("t-word", "t-coll", "t-ck"))
    _land(spark, landing, ["old/b.docx", "b2/a b+%.docx"], "first", 1_000_000_000)
    _land(spark, landing, ["a/b.docx"], "second", 1_500_000_000)       # comes later, so it replaces old/b.docx
    write_files(spark.createDataFrame([("x/empty.docx", b""), ("x/n.txt", b"x"), ("_x/h.docx", b"x")], "name string, content binary"), landing)
    stream_word_files(spark, landing, coll, ck, dim=8, max_files_per_trigger=2)
    # Spark's file source logs what it holds: names of files of names here, one an epoch
    logged = [line for f in glob.glob(f"{ck}/sources/0/[0-9]*") for line in open(f, encoding="utf-8")]
    assert len(glob.glob(f"{ck}/commits/[0-9]*")) == 2 and sum(".parquet" in x for x in logged) == 2 and not any(".docx" in x for x in logged)
    heads = {r.file_id: r.content.split("\n")[0] for r in load_collection(spark, coll).collect()}
    assert heads == {"b": "second a/b.docx", "a b+%": "first b2/a b+%.docx"}
    # a file without a byte is one that cannot be read
    assert [(r.file_id, r.status.split(":")[0]) for r in load_rejected(spark, coll).collect()] == [("empty", "corrupt_file")]
    # nothing new; then one more, however old it is
    stream_word_files(spark, landing, coll, ck, dim=8, max_files_per_trigger=2)
    assert len(glob.glob(f"{ck}/commits/[0-9]*")) == 2
    _land(spark, landing, ["new/c.docx"], "third", 900_000_000)
    stream_word_files(spark, landing, coll, ck, dim=8, max_files_per_trigger=2)
    assert len(glob.glob(f"{ck}/commits/[0-9]*")) == 3
    assert sorted(r.file_id for r in load_collection(spark, coll).collect()) == ["a b+%", "b", "c"]


def test_word_stream_goes_on_from_a_checkpoint_of_the_file_source(spark, monkeypatch):
    from ragframe.operators.collection import load_collection
    from ragframe.streaming import ingest
    landing, coll, ck = (scratch_path(spark, n).removeprefix("file:") for n in ("t-word", "t-coll", "t-ck"))
    _land(spark, landing, ["a.docx"], "first", 1_700_000_000)
    real = ingest.task_folder
    monkeypatch.setattr(ingest, "task_folder", lambda *a: None)
    ingest.stream_word_files(spark, landing, coll, ck, dim=8, replace_files=False)
    monkeypatch.setattr(ingest, "task_folder", real)
    _land(spark, landing, ["b.docx"], "second", 1_700_000_100)
    ingest.stream_word_files(spark, landing, coll, ck, dim=8, replace_files=False)
    assert sorted(r.file_id for r in load_collection(spark, coll).collect()) == ["a", "b"]
