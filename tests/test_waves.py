"""The boundary model in waves, and the new ways into collections."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ragframe.operators.sections import rule_model, semantic_chunks
from ragframe.operators.waves import semantic_waves
from ragframe.session import scratch_path


def _by_prompt(answer):
    return lambda prompts: pd.Series([answer(p) for p in prompts["prompt"]])


@pytest.mark.parametrize("mode,group", [("word", 3), ("word", 40), ("pdf", 5)])
def test_waves_equal_the_state_machine(spark, mode, group):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    kw = {"mode": mode, "group_size": group, "lines_per_page": 10 if mode == "pdf" else None}
    model = rule_model(60)

    def answer(prompts):
        # the excerpt is what comes before the instruction
        return pd.Series([model(p) for p in prompts["prompt"]])
    a = sorted(tuple(r) for r in semantic_chunks(docs, model, **kw).collect())
    rows, failures = semantic_waves(docs, answer, **kw)
    assert sorted(tuple(r) for r in rows.collect()) == a and failures.count() == 0


def test_bad_answers_failures_and_growth(spark):
    paras = lambda n: "\n".join(f"{i}" * 150 for i in range(n))
    docs = spark.createDataFrame([("grow", paras(10)), ("none", paras(3)), ("fail", paras(9)), ("blank", " \n"), (None, paras(2)), ("null", None)],
                                 "doc_id string, text string")
    seen = scratch_path(spark, "t-asked")

    def answer(p):
        import os
        import uuid
        lines = [x for x in p.split("\n") if x.startswith("【")]
        os.makedirs(seen, exist_ok=True)
        open(f"{seen}/{len(lines)}-{uuid.uuid4().hex}", "w").close()
        if len(lines) == 9:
            raise ValueError("no luck")
        if len(lines) == 3:
            return "no block"
        if len(lines) == 4:
            return "```python\nsections = ['【999†source】', '【2†source】']\n```"        # unknown first: no cut
        return "```python\nsections = ['【0†source】', '【3†source】', '【3†source】', '【5†source】']\n```"
    rows, failures = semantic_waves(docs, _by_prompt(answer), group_size=4, max_retries=1, max_asks=2)
    got = {}
    for r in rows.collect():
        got.setdefault(r.doc_id, []).append((r.section_no, r.first_marker, r.n_paras))
    # "grow": 4 paragraphs decide nothing, 6 decide one cut, the next excerpt begins there
    assert sorted(got["grow"])[:2] == [(0, 0, 3), (1, 3, 7)] and sorted(got["none"]) == [(0, 0, 3)]
    assert got[None] == [(0, 0, 2)] and "blank" not in got and "null" not in got
    assert sum(n for _, _, n in got["fail"]) == 9
    import os
    asked = [int(f.split("-")[0]) for f in os.listdir(seen)]
    assert 4 in asked and 6 in asked and asked.count(3) == 2       # asked again, no more than twice
    assert failures.columns == ["doc_id", "first_marker", "error"]


def test_failed_calls_are_kept_and_cost_no_other_document(spark):
    docs = spark.createDataFrame([("good", "a" * 200 + "\nb\n" + "c" * 200), ("bad", "boom\nx\ny")], "doc_id string, text string").coalesce(1)

    def answer(prompts):
        if prompts["prompt"].str.contains("boom").any():
            raise ValueError("boom")
        return pd.Series(["```python\nsections = ['【1†source】']\n```"] * len(prompts))
    rows, failures = semantic_waves(docs, answer, max_asks=2)
    assert sorted((r.doc_id, r.section_no, r.n_paras) for r in rows.collect()) == [("bad", 0, 3), ("good", 0, 1), ("good", 1, 2)]
    assert [(r.doc_id, r.first_marker) for r in failures.collect()] == [("bad", 0)] * 2
    assert all("ValueError: boom" in r.error for r in failures.collect())


def test_no_documents(spark):
    rows, failures = semantic_waves(spark.createDataFrame([], "doc_id long, text string"), _by_prompt(lambda p: ""), mode="pdf")
    assert rows.count() == 0 and failures.count() == 0 and rows.columns[-1] == "page_number"


def test_word_stream_replaces_quarantines_and_compacts(spark):
    import os
    from ragframe.operators.collection import load_collection, load_rejected
    from ragframe.sources.docx import minimal_docx
    from ragframe.sources.files import write_files
    from ragframe.streaming.ingest import stream_word_files
    landing, coll, ck = (scratch_path(spark, n) for n in ("t-word", "t-coll", "t-ck"))
    docs = [(f"d{i}.docx", minimal_docx([f"heading {i}", "body " * 40])) for i in range(6)] + [("bad.docx", b"not a zip"), ("note.txt", b"x")]
    write_files(spark.createDataFrame(docs, "name string, content binary"), landing)
    assert sorted(f for f in os.listdir(landing) if not f.startswith(".")) == sorted(n for n, _ in docs)
    stream_word_files(spark, landing, coll, ck, dim=8, max_files_per_trigger=1, compact_every=3)
    col = load_collection(spark, coll)
    assert sorted(r.file_id for r in col.collect()) == [f"d{i}" for i in range(6)]
    assert [(r.file_id, r.status.split(":")[0]) for r in load_rejected(spark, coll).collect()] == [("bad", "corrupt_file")]
    assert col.select("ingest_batch").distinct().count() <= 4       # seven epochs, the earlier ones merged
    # the same name again, elsewhere: the file's rows are replaced
    os.makedirs(f"{landing}/again")
    write_files(spark.createDataFrame([("d2.docx", minimal_docx(["only this " * 20]))], "name string, content binary"), f"{landing}/again")
    stream_word_files(spark, landing, coll, ck, dim=8, max_files_per_trigger=1, compact_every=3)
    col = load_collection(spark, coll)
    assert [r.content[:9] for r in col.where("file_id = 'd2'").collect()] == ["only this"] and col.count() == 6


def test_malformed_records_go_to_the_quarantine(spark, tmp_path):
    from ragframe.operators.collection import ingest_embedded_csv, load_collection, load_rejected
    (tmp_path / "a.csv").write_text('id,chunks,embedding,num_tokens,collection\n1,"two\nlines","[1,2]",3,a/b\n2,short\n'
                                    '3,c,"[1]",1,x\n4,d,"[1,2]",many,x\n5,e,"[1,2]",,x\n6,f,"[1,2]",1,x,y,z\n', encoding="utf-8")
    path = scratch_path(spark, "t-coll")
    for _ in range(2):                # a replay changes nothing
        ingest_embedded_csv(spark, str(tmp_path), path, 2, batch_id=5)
    good = {(r.file_id, r.chunk_no, r.content, r.num_tokens) for r in load_collection(spark, path).collect()}
    assert good == {("ab", 1, "two\nlines", 3), ("x", 5, "e", None)}
    assert sorted((r.status, r.content) for r in load_rejected(spark, path).collect()) == [
        ("bad_dimension", "c"), ("bad_num_tokens", "d"), ("malformed_record", "2,short"), ("malformed_record", '6,f,"[1,2]",1,x,y,z')]
