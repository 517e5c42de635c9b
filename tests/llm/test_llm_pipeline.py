"""Each stage of the pipeline against brute force on its own input, and the whole."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from conftest import SF001
from test_llm_leaks import brute as leaks
from test_llm_lines import brute as line_copies
from test_llm_near import brute as near


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [docs.collect()]
    for _, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, SF001), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    return out


def test_stages(spark, steps):
    start, clean, lined, single, safe = ({r.doc_id: r.text for r in s} for s in steps)
    assert set(clean) <= set(start) and len(clean) >= 0.7 * len(start) and all(start[i] == t for i, t in clean.items())
    want, _ = line_copies(list(clean.items()))
    assert lined == {i: t for i, (n, gone, t) in want.items() if len(gone) < n}
    want, _ = near(list(lined.items()), 5, 80)
    assert single == {i: t for i, t in lined.items() if want[i][2]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    held = {x[0] for x in leaks(list(single.items()), items)}
    assert safe == {i: t for i, t in single.items() if i not in held}


def test_run(spark, steps):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in P.run(spark, SF001).collect()}
    assert rows.keys() == {r.doc_id for r in steps[-1]}
    for r in steps[-1]:
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
