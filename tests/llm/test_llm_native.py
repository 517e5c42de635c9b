"""Licence scan and chat formatting: SQL on sf0.01, and edge rows by brute force."""

import re

import duckdb
import pytest

from ragframe.llm import chat, licenses
from ragframe.llm.queries import ORACLE, QUERIES
from conftest import SF01
from tools.oracle_check import table_hash


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df, rel = QUERIES[name](spark, SF01), con.sql(ORACLE[name])
    rows, want = [tuple(r) for r in df.collect()], rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert table_hash(df.columns, rows)[0] == table_hash(rel.columns, want)[0]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, t.label) for t in licenses.BASE_PHRASES for n in [len(t.text.split())]
             for i in range(len(words) - n + 1) if words[i:i + n] == t.text.split()]
    return (len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None),
            ",".join(sorted({label for _, label in found})))


def test_license_rows(spark):
    bsd = next(t.text for t in licenses.NOTICES if t.label == "bsd")
    cut = bsd.split()
    texts = ["MIT License", "mit-license, MIT  LICENSE!", "the mit licenses", "CC BY cc by-sa", "by cc", "", None, "...",
             "GNU General Public License " * 300 + "x" * 50_000, "gnu general public mit license apache license", "MİT license",
             "Redistribution and use: " + bsd, " ".join(cut[:9] + ["indeed"] + cut[9:]), " ".join(cut[:5]), "ccby", "cc\nby", "Ünï cc by"]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, "cc by", "x", 1), (0, "MIT License", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, tid int")
    got = licenses.scan_licenses(df).collect()
    base = lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), *map(str, base(r))) for r in got) == sorted(
        ((-1 if i is None else i), *map(str, places(t))) for i, t, *_ in rows)
    by = {r.doc_id: r for r in got}
    assert "bsd" in by[11].labels and by[11].score == 1 and "bsd" in by[12].labels and 0.6 <= by[12].score < 1
    assert by[13].labels == "" and 0 < by[13].score < 0.6 and by[6].score == 0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    plan = licenses.scan_licenses(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_chat_rows(spark):
    turns = [(1, 0, "alice", "hi"), (1, 1, "bob", "yo\nthere"), (1, 2, "carol", None), (1, 3, "alice", "é😀"), (1, 0, "system", "be kind"),
             (2, 0, "system", "alone"), (3, None, None, "who"), (3, 5, " ", ""), (4, 7, "a", "same"), (4, 7, "a", "same"), (4, 7, "b", "x"),
             (None, 0, "a", "lost"), (None, 1, "b", "found")] + [(5, i, "ab"[i % 2], f"t{i}") for i in range(23)]
    df = spark.createDataFrame([(*t, "z", 9) for t in turns], "conv_id long, turn long, role string, text string, assistant string, segment int")
    rows = chat.rotate_perspectives(df, segment_turns=10).collect()
    assert {(r.conv_id, r.assistant) for r in rows} == {
        (1, "alice"), (1, "bob"), (1, "carol"), (3, "unknown"), (4, "a"), (4, "b"), (None, "a"), (None, "b"), (5, "a"), (5, "b")}
    for r in rows:
        own = [(t if t is not None else -1, (ro or "").strip() or "unknown", x or "") for c, t, ro, x in turns if c == r.conv_id
               and (t or 0) // 10 == r.segment]
        own = sorted(own)[10 * r.part:10 * r.part + 10]
        want, spans = "", []
        for _, role, text in own:
            want += ("<|assistant|>" if role == r.assistant else "<|system|>" if role == "system" else f"<|user name={role}|>") + "\n"
            if role == r.assistant:
                spans.append((len(want), len(want) + len(text) + len("<|end|>")))
            want += text + "<|end|>\n"
        assert r.rendered == want and list(zip(r.mask_start, r.mask_end)) == spans
        assert (r.n_turns, r.n_masked) == (len(own), len(spans))
    assert len([r for r in rows if r.conv_id == 5]) == 2 * 3
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", chat.rotate_perspectives(df)._jdf.queryExecution().toString())
