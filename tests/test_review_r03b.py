"""Findings of round 3, second half."""

from __future__ import annotations

import random



def test_edit_test_settles_moved_words_without_the_table(monkeypatch):
    from ragframe.llm import lines
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(40)]
    moved = words[20:] + words[:20]
    changed = [w if k % 20 else "other" + w for k, w in enumerate(words)]

    class NoCounter:
        def __init__(self, _):
            raise AssertionError("settled before")
    monkeypatch.setattr(lines, "Counter", NoCounter)
    assert lines._similar(" ".join(words), " ".join(changed), 0.9)
    assert not lines._similar("x " + " ".join(words) + " y", "z " + " ".join(moved) + " w", 0.9)


def test_equal_lines_of_a_slice_are_fingerprinted_once(spark, monkeypatch):
    from ragframe.llm import lines
    rows = [(i, "uno dos tres été cinco\n\nshort line\none two three four five six") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    run = []
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, f, schema: run.append(f) or self, raising=True)
    lines._fingerprints(d, True)
    lines._fingerprints(d, False)
    monkeypatch.undo()
    seen, real = [], lines.simhashes
    monkeypatch.setattr(lines, "simhashes", lambda ws: seen.append(len(ws)) or real(ws))
    batch = d.toArrow().to_batches()
    for f, each in zip(run, (3, 2), strict=True):
        out = [r for b in f(iter(batch)) for r in b.to_pylist()]
        assert len(out) == 20 * each and len({(r["digest"], r["simhash"]) for r in out}) == each
        assert {r["line"] for r in out} == ({0, 2, 3} if each == 3 else {0, 3})
    assert seen == [2, 2]


def test_pipeline_stages_bound_the_texts_of_a_batch(spark):
    import corpus_pipeline
    from ragframe.llm.common import BATCH_ROWS
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    try:
        for set_, want in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("7", 7)):
            spark.conf.set(name, set_)
            dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, "")
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)


def test_small_groups_are_ranked_like_large_ones_and_leave_in_few_batches(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F
    from ragframe.operators import search
    rng = np.random.default_rng(2)
    for n in (1, 3, 64, 65, 200):
        cm = rng.integers(0, 2, size=(n, 3)).astype(float)       # many ties
        ids = rng.permutation(n) // 2 * 2 if n != 64 else rng.permutation(n)
        cm = cm[np.unique(ids, return_index=True)[1]][np.unique(ids, return_inverse=True)[1]]
        qm, qids = rng.random((30, 3)), np.arange(30) + 7
        want = [(q, i, d) for q, x in zip(qids.tolist(), qm, strict=True)
                for d, i in sorted({(float(np.add.accumulate((c - x) ** 2)[-1]), int(i)) for c, i in zip(cm, ids, strict=True)})[:5]]
        got = search.nearest(cm, ids, qm, qids, 5)
        assert [(int(q), int(i), float(d)) for q, i, d in zip(*got, strict=True)] == want
        cut = n // 2
        parts = search._best(search.nearest(cm[:cut], ids[:cut], qm, qids, 5) if cut else None, search.nearest(cm[cut:], ids[cut:], qm, qids, 5), 5)
        assert [(int(q), int(i), float(d)) for q, i, d in zip(*parts, strict=True)] == want
    rows = spark.range(600).select("id", F.format_string("k%d", F.expr("id div 3")).alias("file_id"),
                                   F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    sizes, real = [], search._in_bulk

    def spy(found):
        for kvs, columns in real(found):
            sizes.append(len(kvs))
            yield kvs, columns
    kernel = search._stream_kernel(2, "file_id", __import__("pyarrow").schema([("qid", "int64"), ("id", "int64"), ("distance", "float64"), ("file_id", "string")]))
    monkeypatch.setattr(search, "_in_bulk", spy)
    c = rows.select("id", "file_id", F.col("embedding").alias("vec"))
    q = rows.select(F.col("id").alias("qid"), "file_id", F.col("embedding").alias("qvec"))
    sizes_of = search.block_sizes(c, q, "file_id", 80, 10_000, 10_000)
    dealt = search._dealt(c, q, sizes_of, "file_id").orderBy("file_id", "_s", "_r", "_side").toArrow().combine_chunks().to_batches()
    out = [r for b in kernel(iter(dealt)) for r in b.to_pylist()]
    assert sizes == [1200] and len(out) == 1200
    for limit in (0, 1 << 30):       # by blocks, by broadcast
        got = {(r.qid, r["rank"]): (r.id, r.distance) for r in search.topk(rows, rows.withColumnRenamed("id", "qid"), 2, broadcast_max_bytes=limit).collect()}
        assert len(got) == 1200
        for i in range(600):
            near = sorted(((j - i) ** 2, j) for j in range(i // 3 * 3, i // 3 * 3 + 3))[:2]
            assert [got[i, k] for k in (1, 2)] == [(j, float(d)) for d, j in near]


def test_contents_are_fetched_for_kept_rows_in_parts_that_follow_their_size(spark, monkeypatch):
    from ragframe.operators import context
    from ragframe.plans.chat import chat
    # ids of use in one file only, a row stored twice, one too long to be kept
    rows = [(i, f, [float(i)], f"{f}{i} " * 5, 4) for i in (1, 2, 3) for f in "ab"]
    rows = [*rows, rows[0], (4, "a", [4.0], "long", 50)]
    corpus = spark.createDataFrame(rows, "id long, file_id string, embedding array<float>, content string, num_tokens long")
    qs = spark.createDataFrame([(10, "a", [0.0], "?"), (11, "b", [0.0], "!"), (12, "c", [0.0], ".")],
                               "qid long, file_id string, embedding array<float>, question string")
    seen, real = [], context._with_contents

    def spy(*a):
        out = real(*a)
        seen.append((sorted(a[0].columns), out.rdd.getNumPartitions()))
        return out
    monkeypatch.setattr(context, "_with_contents", spy)
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for part, want in ((1 << 25, least), (1, 24 * context.TOKEN_BYTES)):
        monkeypatch.setattr(context, "PART_BYTES", part)
        got = {r.qid: (r.n_chunks, r.ctx_tokens, r.context) for r in chat(corpus, qs, budget=20).collect()}
        assert got == {q: (3, 12, "".join(f"{f}{i} " * 5 + "\n" for i in (1, 2, 3))) for q, f in ((10, "a"), (11, "b"))} | {12: (0, 0, "")}
        assert seen.pop() == (["file_id", "id", "num_tokens", "qid", "rank"], want)


def test_a_wave_is_written_once_and_its_sections_need_the_excerpt_alone(spark, monkeypatch):
    from ragframe.operators import waves
    written, real = [], waves._table
    monkeypatch.setattr(waves, "_table", lambda df, name: written.append((name, df.columns)) or real(df, name))

    def model(prompts):
        return ["sections = ['【0†source】']"] * len(prompts)
    docs = spark.createDataFrame([(1, "\n".join(f"paragraph {i} of some length" for i in range(7)))], "doc_id long, text string")
    out = waves.semantic_waves(docs, model, group_size=4, min_chars=1)[0]
    assert "\n".join(r.content for r in sorted(out.collect())) == docs.first().text
    # nothing but the waves is written; carried paragraphs are apart from the excerpt
    assert {name for name, _ in written} == {"wave"} and all({"head", "tail"} <= set(c) for _, c in written)
