import pytest
from pyspark.sql import functions as F

from brute import assert_overlapped, assert_packed, char_pieces, sentence_pieces, word_pieces
from conftest import SF01
from ragframe.functions.text import sentence_units
from ragframe.operators.chunking import chunk_documents
from ragframe.operators.folds import greedy_pack


def _spark_chunks(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = chunk_documents(df, **kw).orderBy("doc_id", "chunk_no").collect()
    res = {}
    for r in out:
        res.setdefault(r.doc_id, []).append(r.chunk)
    return res


SENTENCE_EDGES = ["Hello! World.", "Mr. X went home. Then left.", "Use e.g. this one. Ok.",
                  "Yes!: ok. Fine.", "a\n\nb", "a\tb", "", "\nlead", "Why? Because. ",
                  "End.  \n  Next"]


def test_sentence_units_match_python_regex(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SENTENCE_EDGES)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", sentence_units(F.col("t")).alias("u")).collect()}
    for i, t in enumerate(SENTENCE_EDGES):
        assert got[i] == sentence_pieces(t), t


def test_sentence_edge_rules(spark):
    df = spark.createDataFrame([(t,) for t in SENTENCE_EDGES], "t string")
    got = {r.t: r.u for r in df.select("t", sentence_units(F.col("t")).alias("u")).collect()}
    assert got["Hello! World."] == ["Hello! World."]          # no split after "!"
    assert got["Mr. X went home. Then left."] == ["Mr. X went home.", " Then left."]
    assert got["Use e.g. this one. Ok."] == ["Use e.g. this one.", " Ok."]
    assert got["Yes!: ok. Fine."] == ["Yes!:", " ok.", " Fine."]
    assert got["a\n\nb"] == ["a", "\n\nb"]
    assert got["a\tb"] == ["a", "\tb"]
    assert got[""] == [""]
    assert got["\nlead"] == ["", "\nlead"]


def _leaf(t, n, before=False, after=False):
    return {"t": t, "n": n, "b": before, "a": after}


LEAF_SCHEMA = "l array<struct<t:string,n:long,b:boolean,a:boolean>>"


def test_pack_worked_example(spark):
    # sizes [4,6,1,12,3,8] with limit 10, no fallback: ids [0,0,1,2,3,4]
    sizes = [4, 6, 1, 12, 3, 8]
    leaves = [_leaf(str(i), n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(leaves,)], LEAF_SCHEMA)
    got = df.select(greedy_pack(F.col("l"), 10).alias("c")).first().c
    assert got == ["01", "2", "3", "4", "5"]
    # the 12 as an oversize unit split into pieces of 10 and 2 -> the 2 is flushed alone
    leaves2 = leaves[:3] + [_leaf("3a", 10, before=True), _leaf("3b", 2, after=True)] \
        + [_leaf(str(i), n) for i, n in [(4, 3), (5, 8)]]
    df2 = spark.createDataFrame([(leaves2,)], LEAF_SCHEMA)
    got2 = df2.select(greedy_pack(F.col("l"), 10).alias("c")).first().c
    assert got2 == ["01", "2", "3a", "3b", "4", "5"]


def test_custom_splitter_chain(spark):
    from ragframe.operators.chunking import chars_splitter, pack_units, words_splitter
    from ragframe.functions.text import newline_units
    text = "alpha beta gamma delta\n" + "w " * 30 + "\n" + "z" * 50
    df = spark.createDataFrame([(text,)], "t string")
    # a three-level chain: words by 4, then words by 2, then characters by 8
    chain = [words_splitter(4), words_splitter(2), chars_splitter(8)]
    got = df.select(pack_units(newline_units(F.col("t")), 5, chain=chain).alias("c")).first().c
    import regex
    assert_packed(text, got, 5, regex.compile("\n"),
                  [lambda t: word_pieces(t, 4), lambda t: word_pieces(t, 2), lambda t: char_pieces(t, 8)])


OVERSIZE = [
    "word " * 300 + "end.",                      # oversize sentence -> word pieces
    "x" * 9000 + " tail. More text here.",       # giant word -> char pieces
    "\n" + "y " * 700 + "z.",                    # leading newline + oversize sentence
    "",
    "Short one. " * 40,
]


def test_oversize(spark):
    rows = [(i, t) for i, t in enumerate(OVERSIZE)]
    plain = _spark_chunks(spark, rows, limit=100)
    overlapped = _spark_chunks(spark, rows, limit=100, overlap=0.34)
    for i, t in rows:
        assert_packed(t, plain[i], 100)
        assert_overlapped(plain[i], overlapped[i], 100, 0.34)


def test_empty_document_gives_one_empty_chunk(spark):
    got = _spark_chunks(spark, [(1, "")], limit=100)
    assert got[1] == [""]


@pytest.mark.parametrize("limit,overlap", [(100, 0.34), (1000, 0.34), (37, None)])
def test_whole_sf001_documents(spark, limit, overlap):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")

    def collected(**kw):
        out = {}
        for r in chunk_documents(docs, limit=limit, **kw).collect():
            out.setdefault(r.doc_id, {})[r.chunk_no] = r.chunk
        return {i: [c[k] for k in sorted(c)] for i, c in out.items()}
    plain, overlapped = collected(), collected(overlap=overlap) if overlap else None
    for r in docs.collect():
        assert_packed(r.text, plain[r.doc_id], limit)
        if overlap:
            assert_overlapped(plain[r.doc_id], overlapped[r.doc_id], limit, overlap)


def test_concatenation_is_lossless(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    ch = chunk_documents(docs, limit=100)
    back = ch.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))),
                                 lambda x: x["chunk"]), "").alias("t"))
    bad = back.join(docs, "doc_id").filter(F.col("t") != F.col("text")).count()
    assert bad == 0


def test_partition_count_independent(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    base = sorted(chunk_documents(docs, limit=100).collect())
    for n in (1, 17):
        assert sorted(chunk_documents(docs.repartition(n), limit=100).collect()) == base


def test_private_use_characters_stay(spark):
    texts = ["a\ue000b. c", "\ue000", "\ue001. \ue000\ue001x", "\ue001\ue002 \ue001\ue003. y", "Mr.\ue000 Z. q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.u for r in df.select("doc_id", sentence_units(F.col("text")).alias("u")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sentence_pieces(t)
    chunks = _spark_chunks(spark, list(enumerate(texts)), limit=100)
    assert all("".join(chunks[i]) == t for i, t in enumerate(texts))


def test_time_grows_with_the_length_of_a_document(spark):
    import time
    from ragframe.operators.chunking import char_pieces, word_pieces

    def seconds(mb, col):
        df = spark.createDataFrame([("word " * (200_000 * mb),)], "t string").persist()
        df.count()
        took = []
        for _ in range(2):
            t0 = time.time()
            df.select(col(F.col("t")).alias("p")).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t0)
        df.unpersist()
        return min(took)
    for col in (lambda t: word_pieces(t, 100), lambda t: char_pieces(t, 400)):
        assert seconds(4, col) < 4 * seconds(1, col) + 1.5


def _timed(df, make, tries=2):
    import time
    took = []
    for _ in range(tries):
        t0 = time.time()
        make(df).write.format("noop").mode("overwrite").save()
        took.append(time.time() - t0)
    return min(took)


def test_chunks_and_sections_grow_in_proportion(spark):
    """Documents of 0.5 to 4 MB, also without any heading: eight times the text takes about eight times as long."""
    from ragframe.operators.sections import assemble_sections, excerpt_groups
    line = "Some words of a longer line that goes on for a while. Then it ends here, at last.\n"
    makers = [lambda d: chunk_documents(d, limit=100), lambda d: chunk_documents(d, limit=1000, overlap=0.34),
              lambda d: assemble_sections(d, lambda m, t: m == 0), assemble_sections, excerpt_groups]
    sized = {}
    for mb in (0.5, 4):
        text = (line * (1 + int(mb * 1e6) // len(line)))[:int(mb * 1e6)]
        df = spark.createDataFrame([(1, text)], "doc_id long, text string").persist()
        df.count()
        sized[mb] = [_timed(df, m) for m in makers]
        df.unpersist()
    for small, large in zip(sized[0.5], sized[4], strict=True):
        assert large < 8 * small * 1.6 + 2 and large < 20, sized


def test_a_python_tokenizer_drives_the_packer(spark):
    from ragframe.functions.tokens import PythonCounter
    calls = spark.sparkContext.accumulator(0)

    def sizes(texts):
        import re
        return [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]

    def counted(texts):
        calls.add(1)
        return sizes(texts)
    docs = [(1, "One two three. Four five. Six seven eight nine ten eleven twelve. End."), (2, ""), (3, None),
            (4, "a b c d e f g h i j. k."), (5, "x,y,z,u,v,w,a,b,c,d,e,f,g,h. Ok.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = chunk_documents(df, limit=6, counter=PythonCounter(counted), word_limit=4, char_limit=10).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.chunk_no or 0)):
        got.setdefault(r.doc_id, []).append((r.chunk, r.n_tokens))
    assert got == {
        1: [("One two three.", 4), (" Four five.", 3), (" Six seven eight", 3), (" nine ten eleven twelve.", 5), (" End.", 2)],
        2: [("", 0)], 3: [(None, None)],
        4: [("a b c d", 4), (" e f g h", 4), (" i j.", 3), (" k.", 2)],
        # one word of 29 tokens: pieces of ten characters, each still over the limit, stand alone
        5: [("x,y,z,u,v,", 10), ("w,a,b,c,d,", 10), ("e,f,g,h.", 8), (" Ok.", 2)]}
    assert 0 < calls.value <= 3 * 2 * 16       # a few per Arrow batch, not one per piece
    over = {}
    for r in chunk_documents(df.where("doc_id = 1"), limit=6, counter=PythonCounter(sizes), word_limit=4,
                             char_limit=10, overlap=0.5).collect():
        over[r.chunk_no] = r.chunk
    # heads under a limit of three tokens
    assert [over[i] for i in range(5)] == ["One two three. Four five.", " Four five. Six seven eight",
                                           " Six seven eight nine ten eleven", " nine ten eleven twelve. End.", " End."]


@pytest.mark.parametrize("overlap", [None, 0.34])
def test_python_and_jvm_counters_agree(spark, overlap):
    from ragframe.functions.tokens import PythonCounter
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    same = PythonCounter(lambda texts: [-(-len(t) // 4) for t in texts], batch_chars=20_000)
    a = chunk_documents(docs, limit=100, overlap=overlap)
    b = chunk_documents(docs, limit=100, overlap=overlap, counter=same)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
