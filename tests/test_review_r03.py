"""Tests for the findings of FINDINGS_r03.md."""

from pyspark.sql import functions as F

from ragframe.session import scratch_path
from ragframe.sources.docx import minimal_docx
from ragframe.sources.files import read_text_files, scan_files, write_files


def test_word_stream_has_bounded_epochs_and_few_tasks(spark, monkeypatch):
    import inspect
    from ragframe.operators.collection import load_collection
    from ragframe.streaming import ingest
    assert inspect.signature(ingest.stream_word_files).parameters["max_files_per_trigger"].default == ingest.FILES_PER_EPOCH
    names = [("spark.sql.files.openCostInBytes", str(ingest.SMALL_FILE_BYTES)),
             ("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))]
    before, seen, real = [spark.conf.get(k) for k, _ in names], [], ingest.ingest_word_files

    def spy(files, *a, **kw):
        seen.append([files.sparkSession.conf.get(k) for k, _ in names])
        real(files, *a, **kw)
    monkeypatch.setattr(ingest, "ingest_word_files", spy)
    landing, coll, ck = (scratch_path(spark, n) for n in ("t-word", "t-coll", "t-ck"))
    docs = [(f"{i % 2}/d{i}.docx", minimal_docx([f"heading {i}", "body " * 40])) for i in range(40)]
    write_files(spark.createDataFrame(docs, "name string, content binary"), landing)
    ingest.stream_word_files(spark, landing, coll, ck, dim=8)
    assert seen == [[v for _, v in names]] and before == [spark.conf.get(k) for k, _ in names]
    assert sorted(r.file_id for r in load_collection(spark, coll).collect()) == sorted(f"d{i}" for i in range(40))


def test_many_small_files_are_read_by_few_tasks(spark, monkeypatch):
    docs = spark.range(300).select(F.format_string("%d/en/doc %d +100%%.txt", F.col("id") % 40, "id").alias("name"),
                                   F.concat(F.lit("a\r\n"), F.col("id").cast("string")).alias("content"))
    root = scratch_path(spark, "t-texts")
    write_files(docs, root)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        # a task for each file: 300 of them
        spark.conf.set("spark.sql.files.openCostInBytes", "256m")
        most = 32 * spark.sparkContext.defaultParallelism
        for df in (read_text_files(spark, root), scan_files(spark, root, "*.txt")):
            assert df.rdd.getNumPartitions() == min(300, most)
        got = read_text_files(spark, root).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert {(r.path[len("file://" + root) + 1:], r.text) for r in got} == {(f"{i % 40}/en/doc {i} +100%.txt", f"a\n{i}") for i in range(300)}


def test_lines_buckets_are_shuffled_once_and_fingerprints_are_the_same(spark):
    import random
    import numpy as np
    from ragframe.llm import lines
    for line in ("a b_c, d-1", "été à l'école", "", "x y"):
        assert [w if isinstance(w, str) else w.decode() for w in lines.words_of(line)] == lines._WORD.findall(line)
    words = [["ab", "longword"] * k + ["été", "x" * 9] for k in (1, 42, 43, 85, 86, 20_000)]
    as_bytes = [[w.encode() if w.isascii() else w for w in ws] for ws in words]
    assert (lines.simhashes(words) == lines.simhashes(as_bytes)).all()
    # three of six blocks: any three different bits leave one key at least equal
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        x = rng.getrandbits(64) - (1 << 63)
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        y = int((np.array([x], dtype=np.int64).view(np.uint64) ^ np.uint64(flips)).view(np.int64)[0])
        pairs.append((x, y))
    d = spark.createDataFrame(pairs, "x long, y long")
    assert sum(w for _, w in lines.MORE_BLOCKS) == 64
    both = F.arrays_overlap(lines.block_keys(F.col("x"), lines.MORE_BLOCKS), lines.block_keys(F.col("y"), lines.MORE_BLOCKS))
    assert d.where(both).count() == 60
    # buckets are read in one pass: no join of the keyed rows
    classes = spark.createDataFrame([(i, x) for i, x in enumerate([5, 5 ^ 1, 5 ^ 3, *(rng.getrandbits(63) for _ in range(50))])], "node long, simhash long")
    plans, real = [], lines.written

    def spy(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return real(df, name)
    lines.written = spy
    try:
        close, members = lines._candidates(classes)
        got = {(r.node, r.least) for r in members.collect()}
    finally:
        lines.written = real
    assert not any("Join" in p for p in plans) and {(0, 0), (1, 0), (2, 0)} <= got and close.where("a > 2").isEmpty()
    # ends that are alike, and letters of one alone, change no answer
    for _ in range(300):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(25)))
        k = rng.randrange(len(a) + 1)
        b = a[:k] + "".join(rng.choice("abz") for _ in range(rng.randrange(4))) + a[k + rng.randrange(4):]
        table = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            table, before = [i], table
            for j, e in enumerate(b, 1):
                table.append(min(before[j] + 1, table[-1] + 1, before[j - 1] + (c != e)))
        assert [lines.within_edits(a, b, m) for m in range(8)] == [table[-1] <= m for m in range(8)]
