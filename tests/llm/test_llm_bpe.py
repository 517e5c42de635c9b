import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ragframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = ["", " \n\t", "Hello World's <|endoftext|> ok<|startoftext|>", "ΑΣ ΣΑΣ ς", "a\x1cb\x1db a\x85b​ c　d",
         "İstanbul ẞ ǅ", "½ ² 12345 ٣ Ⅷ", "é É", "don't DON'T 'S ''s", "😀‍😀 漢字かな 한국어", "aaaaaaaaaaaaa" * 50,
         "x" * 100_000, "<|endoftext|", "\x00\x01 a", "!!!???...", "ab" * 999 + "c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digests(t, text):
    ids = t.encode(text, add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_equals_library_on_edges_and_random_text(library):
    rng = random.Random(7)
    alphabet = "aabcdeéèßΣİſ'’ \n\t019½漢😀́­-_<|>"
    texts = EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]
    coded = bpe.Encoder(bpe.load_vocabulary(PATH)).encode(texts)
    for t, c in zip(texts, coded, strict=True):
        assert np.frombuffer(c, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_cache_bound_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    e = bpe.Encoder(bpe.load_vocabulary(PATH))
    for t in ["one two three four", "two five", "five one"]:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_round_trip_rows(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(EDGES)] + [(None, "null id", 2, "x"), (3, None, 3, "x"), (3, None, 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe.round_trip(df, PATH).collect())
    want = sorted((i if i is not None else -1, *digests(library, t or "")) for i, t, _, _ in rows)
    assert got == want
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_query_equals_library(spark, library):
    from conftest import SF01
    from ragframe.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op3_bpe_round_trip"](spark, SF01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, texts[r.doc_id] or "")
