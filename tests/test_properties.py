"""Randomised properties."""

import random

import pytest
from pyspark.sql import functions as F

from brute import assert_overlapped, assert_packed, assert_sections
from ragframe.operators.chunking import chunk_documents
from ragframe.operators.sections import assemble_sections

PIECES = ["a", "bb", "Word", "x" * 30, "y" * 450, " ", " ", " ", "  ", ". ", "? ", "!: ", "! ",
          "\n", "\n\n", "\t", "Mr. ", "e.g. ", "U.S. ", "​", ".", "?", "é", "名", "\x01"]


def _docs(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.choice([0, 1, 3, 10, 40, 120])
        out.append((i, "".join(rnd.choice(PIECES) for _ in range(k))))
    return out


@pytest.mark.parametrize("limit,overlap", [(3, None), (7, 0.34), (25, 0.34), (60, None)])
def test_random_documents_are_packed(spark, limit, overlap):
    rows = _docs(300, seed=limit)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    def collected(**kw):
        out = {}
        for r in chunk_documents(df, limit=limit, **kw).collect():
            out.setdefault(r.doc_id, {})[r.chunk_no] = r.chunk
        return {i: [c[k] for k in sorted(c)] for i, c in out.items()}
    plain, overlapped = collected(), collected(overlap=overlap) if overlap else None
    for i, t in rows:
        assert_packed(t, plain[i], limit)
        if overlap:
            assert_overlapped(plain[i], overlapped[i], limit, overlap)


def test_random_sections(spark):
    rnd = random.Random(5)
    rows, parts = [], {}
    for d in range(120):
        n = rnd.randint(1, 25)
        lens = [rnd.choice([1, 5, 20, 60, 130, 200]) for _ in range(n)]
        paras = [chr(97 + (j % 26)) * ln for j, ln in enumerate(lens)]
        rows.append((d, "\n".join(paras)))
        parts[d] = (paras, [(j == 0) or ln < 60 for j, ln in enumerate(lens)])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rule = lambda m, t: (m == 0) | (F.length(t) < 60)
    got = {}
    for r in assemble_sections(df, rule).collect():
        got.setdefault(r.doc_id, {})[r.section_no] = r.content
    exp = {d: [x[k] for k in sorted(x)] for d, x in got.items()}
    for d, (paras, starts) in parts.items():
        assert_sections(paras, starts, exp[d])
    # PDF mode: the tail joins the previous section
    pdf = {}
    for r in assemble_sections(df, rule, mode="pdf", lines_per_page=4).collect():
        pdf.setdefault(r.doc_id, {})[r.section_no] = r.content
    for d, own in exp.items():
        want = own if len(own) == 1 else own[:-2] + [own[-2] + "\n" + own[-1]]
        assert [pdf[d][k] for k in sorted(pdf[d])] == want


def test_sections_partition_the_kept_paragraphs(spark):
    from conftest import SF01
    from ragframe.operators.sections import heading_rule, paragraphs
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    paras = {}
    for r in paragraphs(docs).collect():
        paras.setdefault(r.doc_id, {})[r.marker_no] = r.text
    for mode in ("word", "pdf"):
        secs = {}
        for r in assemble_sections(docs, heading_rule, mode=mode, lines_per_page=10).collect():
            secs.setdefault(r.doc_id, {})[r.section_no] = (r.content, r.first_marker, r.n_paras)
        for d, ps in paras.items():
            ordered = [secs[d][k] for k in sorted(secs[d])]
            assert "\n".join(c for c, _, _ in ordered) == "\n".join(ps[m] for m in sorted(ps))
            assert sum(n for _, _, n in ordered) == len(ps)
            firsts = [f for _, f, _ in ordered]
            assert firsts == sorted(firsts) and firsts[0] == 0
