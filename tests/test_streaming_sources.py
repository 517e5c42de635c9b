import os

from pyspark.sql import functions as F

from ragframe.functions.text import NEWLINE_PATTERN
from ragframe.operators.collection import load_collection
from ragframe.session import scratch_path
from ragframe.sources.docx import minimal_docx, paragraphs_of, read_docx_folder
from ragframe.sources.files import read_chunk_csv, read_text_files, scan_files, write_csv
from ragframe.sources.tables import TableNotFound, load_table
from ragframe.streaming.ingest import stream_ingest
from ragframe.streaming.reassemble import reassemble, reassemble_stream, to_deltas

import pytest


def test_delta_edges(spark):
    d = spark.createDataFrame([(1, 2, " world"), (1, 0, "Hel"), (1, 3, None), (1, 1, "lo"), (1, 0, "Hel"), (1, 0, "Hel")],
                              "rid long, seq long, delta string")
    assert tuple(reassemble(d, ["rid"]).first()) == (1, 4, "Hello world")


def test_deltas_split_each_text_once(spark):
    c = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "rid long, text string")
    d = to_deltas(c, ["rid"])
    assert sorted(tuple(r) for r in d.where("rid < 3").na.fill("-", ["delta"]).collect()) == [
        (1, 0, "a", False), (1, 1, " b", False), (1, 2, "-", True), (2, 0, "", False), (2, 1, "-", True)]
    assert [tuple(r) for r in d.where("rid = 3").collect()] == [(3, None, None, None)]
    # not again for each of its parts, above the Generate
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_parts_sent_with_different_texts_or_none_first():
    import pandas as pd
    from ragframe.streaming.reassemble import _assembler

    class State:
        hasTimedOut, exists = False, False

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False
    step, state = _assembler(["k"], None), State()
    first = pd.DataFrame({"seq": [1, 1, 0], "delta": [None, "b", "x"], "last": [False] * 3})
    assert not list(step((5,), iter([first]), state)) and state.exists
    rest = pd.DataFrame({"seq": [0, 2, 1], "delta": ["y", None, None], "last": [False, True, False]})
    rows = pd.concat(list(step((5,), iter([rest]), state)))
    assert rows.to_dict("records") == [{"k": 5, "n_deltas": 3, "text": "yb", "complete": True}] and not state.exists


def test_stream_reassembly(spark):
    c = spark.createDataFrame([(1, 0, "a b  c"), (1, 1, ""), (2, 0, "x")], "conv_id long, turn long, text string")
    landing, out = scratch_path(spark, "t-deltas"), scratch_path(spark, "t-out")
    d = to_deltas(c, ["conv_id", "turn"])
    d.unionByName(d.where("seq = 0")).repartition(3).write.parquet(landing)   # parts may be sent twice
    reassemble_stream(spark, landing, "conv_id long, turn long, seq long, delta string, last boolean",
                      ["conv_id", "turn"], scratch_path(spark, "t-ck"), out)
    rows = spark.read.parquet(out).collect()
    assert {(r.conv_id, r.turn): r.text for r in rows} == {(1, 0): "a b  c", (1, 1): "", (2, 0): "x"}
    assert len(rows) == 3 and all(r.complete for r in rows)


def test_evicted_messages_are_written_out():
    import pandas as pd
    from ragframe.streaming.reassemble import _assembler

    class State:
        hasTimedOut, exists, get = True, True, ([1, 0], ["b", "a"], -1)

        def remove(self):
            self.exists = False
    rows = pd.concat(list(_assembler(["k"], 10)((5,), iter([]), State())))
    assert rows.to_dict("records") == [{"k": 5, "n_deltas": 2, "text": "ab", "complete": False}]


def test_stream_ingest_and_epoch_replay(spark):
    from ragframe.streaming.ingest import ingest_batch, stream_batch_base
    docs = spark.createDataFrame([(i, f"line one {i}\nline two") for i in range(6)], "doc_id long, text string")
    landing = scratch_path(spark, "t-landing")
    docs.repartition(3).write.parquet(landing)
    coll = scratch_path(spark, "t-coll")
    ck = scratch_path(spark, "t-ck")
    stream_ingest(spark, landing, "doc_id long, text string", coll, ck, limit=100,
                  pattern=NEWLINE_PATTERN, dim=16, max_files_per_trigger=1)
    col = load_collection(spark, coll)
    n1 = col.count()
    assert n1 == 6 and col.select("ingest_batch").distinct().count() == 3
    # replaying epoch 0 (as after a crash before the commit) overwrites its partitions
    first = col.filter(F.col("ingest_batch") == stream_batch_base(ck)).select("file_id").distinct()
    replay = docs.join(first.select(F.col("file_id").cast("long").alias("doc_id")), "doc_id")
    ingest_batch(replay, coll, limit=100, pattern=NEWLINE_PATTERN, dim=16, batch_id=stream_batch_base(ck))
    assert load_collection(spark, coll).count() == n1


def test_docx_min(spark, tmp_path):
    data = minimal_docx(["first", "", "tab\there", "last"])
    assert paragraphs_of(data) == ["first", "", "tab\there", "last"]
    os.makedirs(tmp_path / "sub")
    (tmp_path / "sub" / "a.docx").write_bytes(data)
    (tmp_path / "note.txt").write_text("x")
    rows = read_docx_folder(spark, str(tmp_path)).orderBy("para_idx").collect()
    assert [r.text for r in rows] == ["first", "", "tab\there", "last"]
    rel = sorted(r.relpath for r in scan_files(spark, str(tmp_path)).collect())
    assert rel == ["note.txt", "sub/a.docx"]


def test_whole_text_universal_newlines(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(b"a\r\nb\rc\n")
    assert read_text_files(spark, str(tmp_path)).first().text == "a\nb\nc\n"


def test_csv_round_trip_quotes_and_newlines(spark):
    df = spark.createDataFrame([("t", "【0†source】", 'say "hi"\nnext line'), ("u", "m", ""), ("v", "m", None),
                                ("w", " \t", " \n lead and trail  "), ("x", '""', "a\r\nb\rc, d\\\"")],
                               "documentTitle string, referenceMarker string, content string")
    p = scratch_path(spark, "t-csv")
    write_csv(df, p)
    back = read_chunk_csv(spark, p)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_missing_table(spark):
    with pytest.raises(TableNotFound):
        load_table(spark, "no_such_table")


def test_per_file_lines_in_section_order(spark, tmp_path):
    from ragframe.operators.sections import per_file_lines, write_per_file
    df = spark.createDataFrame([(f, k, f" part {k} ") for f in "ab" for k in (2, 0, 11, 1)], "doc_id string, section_no long, content string")
    write_per_file(per_file_lines(df), str(tmp_path))
    write_per_file(per_file_lines(df.where("doc_id = 'b' and section_no < 2")), str(tmp_path))
    for f, keys in (("a", (0, 1, 2, 11)), ("b", (0, 1))):
        own = read_chunk_csv(spark, f"{tmp_path}/doc_id={f}").collect()
        assert [r[0] for r in own] == [f"【{k}†source】  part {k} " for k in keys]


def test_corrupt_docx_is_an_error_row(spark):
    from ragframe.sources.docx import docx_paragraphs
    df = spark.createDataFrame([("good", minimal_docx(["a", "b"])), ("bad", b"not a zip"), ("none", None)], "path string, content binary")
    assert sorted((r.path, r.text) for r in docx_paragraphs(df).collect()) == [("good", "a"), ("good", "b")]
    bad = [r for r in docx_paragraphs(df, errors=True).collect() if r.error]
    assert [(r.path, r.para_idx) for r in bad] == [("bad", None)]


def test_one_bad_prompt_costs_no_other(spark):
    import time
    import pandas as pd
    from ragframe.operators.model import apply_model

    def model(prompts):
        if (prompts["p"] == "bad").any():
            raise ValueError("bad prompt")
        if (prompts["p"] == "slow").any():
            time.sleep(3)
        return pd.Series(["<" + p + ">" for p in prompts["p"]])
    df = spark.createDataFrame([(p,) for p in ["a", "bad", "b", "slow"]], "p string").coalesce(1)
    got = {r.p: (r.answer, (r.error or "").split(":")[0]) for r in
           apply_model(df, model, ["p"], max_retries=1, timeout_s=1.0, backoff_s=0).collect()}
    assert got == {"a": ("<a>", ""), "b": ("<b>", ""), "bad": (None, "ValueError"), "slow": (None, "TimeoutError")}


def test_streamed_documents_land_in_files_for_every_core(spark, monkeypatch):
    import ragframe.plans.stream_queries as queries
    from conftest import SF001

    class Landed(Exception):
        pass

    def landed(spark, landing, *args, **kw):
        raise Landed(len([f for f in os.listdir(landing) if f.endswith(".parquet")]))
    monkeypatch.setattr(queries, "stream_ingest", landed)
    with pytest.raises(Landed) as seen:
        queries.q_stream_ingest(spark, SF001)
    assert seen.value.args[0] >= spark.sparkContext.defaultParallelism
