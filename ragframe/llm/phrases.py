"""Phrase collocation mining by vertical partitioning of a suffix tree.

The suffixes of all pieces, cut after ``DEPTH`` words, are the leaves of one suffix
tree per language, which is never built whole. A first pass counts pairs of words by
a hash; below a pair that is certainly rarer than any candidate nothing grows, so
leaves end there. Equal leaves are counted where the texts are read. Word prefixes are then measured: one whose leaves pass ``BUDGET`` is
extended by the next word, again and again, until every prefix fits; prefixes are
dealt into groups of about that budget. Each group builds its depth-truncated
subtrees on its own: its leaves in order are the tree, a node is a run of leaves
with equal first words, and its count the sum of its leaf totals. The few nodes above
extended prefixes have their counts from the measuring.

Phrases of at least ``min_count`` occurrences are all that scores need (parts of a
candidate are at least as frequent), so counts of the two sides of each cut, and the
longer candidates around a phrase, are found by joins of that much smaller table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import written

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
ABSORB = 80            # percent of a phrase's count that a longer candidate around it needs to absorb it
SCALE = 2_000_000
BUDGET = 250_000       # leaves of a group, each counting one and another for every LEAF_BYTES bytes
LEAF_BYTES = 64
MAX_BITS = 1 << 31     # bits of the filter of frequent pairs (256 MB); beyond, it lets more through
CHUNK = 2_000_000      # bytes of text counted at once
EMIT = 100_000         # rows of an Arrow batch
NO_LANG = "und"

# Kinds of bytes (fixed by the contract): 0 part of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


class Words:
    """The words of a run of bytes: their distinct texts, and number, piece and start of each."""

    def __init__(self, data: np.ndarray, breaks: np.ndarray | None = None):
        """``breaks``: further places (ascending, within the bytes) at which a piece and a word end."""
        kind = KIND[data]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        if breaks is not None and len(breaks):
            begins[breaks] |= inside[breaks]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        self.start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        offsets = np.zeros(len(self.start) + 1, dtype=np.int32)
        np.cumsum(end - self.start, out=offsets[1:])
        texts = pa.StringArray.from_buffers(len(self.start), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]]))
        coded = texts.dictionary_encode()
        self.texts, self.number = coded.dictionary, coded.indices.to_numpy()
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.start)
        if breaks is not None:
            self.piece += np.searchsorted(breaks, self.start, side="right")

    def windows(self) -> np.ndarray:
        """The numbers (from 1) of each word and of those after it in its piece, 0 where there is none."""
        n = len(self.number)
        out = np.zeros((n, DEPTH), dtype=np.int32)
        for d in range(min(DEPTH, n)):
            same = self.piece[d:] == self.piece[:n - d]
            out[:n - d, d] = np.where(same, self.number[d:] + 1, 0)
        return out


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, starts of the runs of equal ones in it); the first key counts most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _packed(windows: np.ndarray, words: int) -> list[np.ndarray]:
    """The columns of ``windows`` in as few integers as hold them."""
    keys, width, held = [], words + 1, 0
    for d in range(DEPTH):
        held += 1
        if keys and width ** held < 2 ** 62:
            keys[-1] = keys[-1] * width + windows[:, d]
        else:
            keys.append(windows[:, d].astype(np.int64))
            held = 1
    return keys


def _phrases(windows: np.ndarray, texts: pa.Array, depth: int = DEPTH) -> pa.Array:
    """The words of each row, joined by spaces."""
    out = texts.take(pa.array(windows[:, 0] - 1))
    for d in range(1, depth):
        number = windows[:, d]
        if (number == 0).all():
            break
        more = texts.take(pa.array(number - 1, mask=number == 0))
        out = pc.coalesce(pc.binary_join_element_wise(out, more, " "), out)
    return out


def _by_chunk(docs: DataFrame, emit: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """``emit(lang, words, windows)``, Arrow batches of ``schema``, of the words of each chunk of a
    language's texts; ``windows`` are those of all words that begin in the chunk."""
    def counted(lang: str, data: np.ndarray, breaks: np.ndarray, skip_last: bool):
        w = Words(data, breaks)
        windows = w.windows()
        if skip_last:
            windows = windows[:len(windows) - (DEPTH - 1)]
        if len(windows):
            yield from emit(lang, w, windows)

    def long_text(lang: str, data: np.ndarray):
        """A text beyond CHUNK, slice by slice: a slice ends at a break between pieces, or
        within a piece at a space; the next one then takes up DEPTH - 1 words earlier."""
        at, size, none = 0, CHUNK, np.zeros(0, dtype=np.int64)
        while at < len(data):
            end = at + size
            if end >= len(data):
                yield from counted(lang, data[at:], none, False)
                return
            kind = KIND[data[at:end]]
            cut = np.flatnonzero(kind == 2)
            if len(cut):
                yield from counted(lang, data[at:at + cut[-1]], none, False)
                at, size = at + int(cut[-1]) + 1, CHUNK
                continue
            space = np.flatnonzero(kind == 1)
            w = Words(data[at:at + space[-1]]) if len(space) else None
            if w is None or len(w.number) < 2 * DEPTH:
                size *= 2        # words as long as a slice
                continue
            yield from counted(lang, data[at:at + space[-1]], none, True)
            at, size = at + int(w.start[-(DEPTH - 1)]), CHUNK

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str):
            texts = held.pop(lang)
            sizes.pop(lang)
            # texts stand end to end; each begins a piece of its own
            yield from counted(lang, np.concatenate(texts), np.cumsum([len(t) for t in texts])[:-1], False)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                data = np.frombuffer(batch.column("text")[i].as_buffer(), dtype=np.uint8)
                if len(data) > CHUNK:
                    yield from long_text(lang, data)
                elif len(data):
                    held.setdefault(lang, []).append(data.copy())
                    sizes[lang] = sizes.get(lang, 0) + len(data)
                    if sizes[lang] > CHUNK:
                        yield from flush(lang)
                    elif sum(sizes.values()) > 2 * CHUNK:     # many languages
                        yield from flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flush(lang)

    return docs.select("lang", "text").mapInArrow(run, ddl)


def _pair_codes(lang: str, w: Words, windows: np.ndarray) -> np.ndarray:
    """A 48-bit hash of the first two words of each window and the language; meaningless where there is no second."""
    if not len(w.texts):
        return np.zeros(len(windows), dtype=np.int64)
    one = pd.util.hash_array(np.append(w.texts.to_numpy(zero_copy_only=False), lang).astype(object), categorize=False)
    one, salt = one[:-1], one[-1]
    code = (one[windows[:, 0] - 1] ^ salt) * np.uint64(0x9E3779B97F4A7C15) + one[windows[:, 1] - 1]
    return ((code * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(16)).astype(np.int64)


def _pair_filter(docs: DataFrame, min_count: int) -> np.ndarray:
    """A bitmap with the codes of all word pairs that occur ``min_count`` times or more: 8 bits and more
    for each, up to MAX_BITS. A pair that is not in it is rarer; one that is may be."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def pairs(lang, w, windows):
        codes, n = np.unique(_pair_codes(lang, w, windows)[windows[:, 1] > 0], return_counts=True)
        for s in range(0, len(codes), EMIT):
            yield pa.RecordBatch.from_arrays([pa.array(codes[s:s + EMIT]), pa.array(n[s:s + EMIT])], schema=schema)

    counts = _by_chunk(docs, pairs, schema, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    frequent = written(counts.where(F.col("n") >= min_count).select("code"), "frequent-pairs")
    bits = 1 << 16
    while bits < min(MAX_BITS, 8 * frequent.count()):
        bits *= 2
    piece = min(bits, 1 << 19)

    def paint(table: pa.Table) -> pa.Table:
        at = table.column("code").to_numpy() % bits
        field = np.zeros(piece, dtype=bool)
        field[at % piece] = True
        return pa.table({"piece": [int(at[0]) // piece], "bits": [np.packbits(field).tobytes()]})

    pieces = (frequent.groupBy(F.floor(F.pmod("code", F.lit(bits)) / piece).alias("piece"))
              .applyInArrow(paint, "piece long, bits binary"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in pieces.collect():       # the bitmap, at most MAX_BITS
        out[r["piece"] * piece // 8:(r["piece"] + 1) * piece // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _leaves(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(lang, word, leaf, n, cost): the suffixes of each task's pieces, cut after DEPTH words and before
    the second word of a pair that is too rare for any candidate, counted by chunks of text; their first
    word, and what they count against the budget."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("leaf", pa.string()), ("n", pa.int64()), ("cost", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def leaves(lang, w, windows):
        bits = 8 * len(shared.value)
        for d in range(1, DEPTH):
            at = _pair_codes(lang, w, windows[:, d - 1:d + 1]) % bits
            known = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            windows[(windows[:, d] == 0) | (known == 0), d:] = 0
        order, first = _runs(_packed(windows, len(w.texts)))
        n = np.diff(np.append(first, len(order)))
        rows = windows[order[first]]
        for s in range(0, len(rows), EMIT):
            some = rows[s:s + EMIT]
            leaf = _phrases(some, w.texts)
            cost = 1 + pc.binary_length(leaf).to_numpy() // LEAF_BYTES
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(leaf), pa.string()), w.texts.take(pa.array(some[:, 0] - 1)), leaf,
                                              pa.array(n[s:s + EMIT]), pa.array(cost.astype(np.int32))], schema=schema)

    return _by_chunk(docs, leaves, schema, "lang string, word string, leaf string, n long, cost int")


def _first_words(d: int):
    return F.substring_index("leaf", " ", d)


def _broadcast(df: DataFrame, limit: int = 500_000) -> DataFrame:
    """Broadcast up to ``limit`` rows (counted), a shuffle join beyond."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def partition(leaves: DataFrame, budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves with the length ``plen`` of their prefix, the nodes of the prefixes that were too large: lang,
    phrase, words, n; sizes of all prefixes of one word). At most cost / budget prefixes of a length are too large."""
    spark = leaves.sparkSession
    leaves = leaves.withColumn("plen", F.lit(1))
    nodes = spark.createDataFrame([], "lang string, phrase string, words int, n long")
    measure = lambda df: df.groupBy("lang", "phrase").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"))
    first = sizes = written(measure(leaves.withColumn("phrase", F.col("word"))), "prefixes-1")
    for d in range(1, DEPTH):
        # leaves under another prefix, or that end before, are one group without a phrase
        leaves = leaves.withColumn("phrase", F.col("word") if d == 1 else F.when(
            (F.col("plen") == d) & (F.size(F.split("leaf", " ")) >= d), _first_words(d)))
        if d > 1:
            sizes = written(measure(leaves).where(F.col("cost") > budget), f"prefixes-{d}")
        large = sizes.where((F.col("cost") > budget) & F.col("phrase").isNotNull())
        if large.isEmpty():
            break
        nodes = nodes.unionByName(large.select("lang", "phrase", F.lit(d).alias("words"), "n"))
        flag = _broadcast(large.select("lang", "phrase", F.lit(1).alias("extended")))
        leaves = leaves.join(flag, ["lang", "phrase"], "left").withColumn("plen", F.col("plen") + F.coalesce("extended", F.lit(0))).drop("extended")
    else:
        # a prefix of all DEPTH words is a leaf: its total needs no subtree
        whole = leaves.where(F.col("plen") == DEPTH).where(F.size(F.split("leaf", " ")) == DEPTH)
        nodes = nodes.unionByName(whole.groupBy("lang", F.col("leaf").alias("phrase")).agg(F.sum("n").alias("n"))
                                  .withColumn("words", F.lit(DEPTH)))
        leaves = leaves.where(F.col("plen") < DEPTH)
    # a leaf shorter than its prefix adds to nodes above it alone, which are measured
    leaves = leaves.where((F.col("plen") == 1) | (F.size(F.split("leaf", " ")) >= F.col("plen")))
    return leaves, nodes, first


def _subtrees(min_count: int):
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def build(table: pa.Table) -> pa.Table:
        """The nodes of one group's subtrees with ``min_count`` occurrences or more."""
        leaf = table.column("leaf").combine_chunks()
        text = leaf if isinstance(leaf, pa.Array) else leaf.chunk(0)
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        w = Words(data, (offsets - offsets[0])[1:-1].astype(np.int64))
        # the rows of ``windows`` that begin a leaf: the first word of each
        begins = np.flatnonzero(np.append([True], w.piece[1:] != w.piece[:-1]))
        windows = w.windows()[begins]
        lang = table.column("lang").combine_chunks().dictionary_encode()
        lang = lang.chunk(0) if isinstance(lang, pa.ChunkedArray) else lang
        which = lang.indices.to_numpy()
        n, plen = table.column("n").to_numpy(), table.column("plen").to_numpy()
        order, _ = _runs([which, *_packed(windows, len(w.texts))])
        windows, which, n, plen = windows[order], which[order], n[order], plen[order]
        new = np.append([True], which[1:] != which[:-1])
        out = []
        for d in range(1, DEPTH + 1):
            new[1:] |= windows[1:, d - 1] != windows[:-1, d - 1]
            first = np.flatnonzero(new)
            totals = np.add.reduceat(n, first)
            keep = (totals >= min_count) & (windows[first, d - 1] > 0) & (plen[first] <= d)
            at = first[keep]
            if len(at):
                out.append(pa.table([lang.dictionary.take(pa.array(which[at])), _phrases(windows[at], w.texts, d),
                                     pa.array(np.full(len(at), d, dtype=np.int32)), pa.array(totals[keep])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return build


def phrase_counts(leaves: DataFrame, min_count: int = MIN_COUNT, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases of up to DEPTH words with ``min_count``
    occurrences or more, (lang, n) with the words of each language)."""
    leaves, nodes, sizes = partition(leaves, budget)
    total, words = sizes.agg(F.sum("cost")).first()[0] or 0, sizes.groupBy("lang").agg(F.sum("n").alias("n"))
    groups = max(1, -(-total // budget))
    prefix = F.when(F.col("plen") == 1, F.col("word"))
    for d in range(2, DEPTH + 1):
        prefix = prefix.when(F.col("plen") == d, _first_words(d))
    group = F.pmod(F.xxhash64("lang", prefix), F.lit(groups))
    built = (leaves.select(group.alias("group"), "lang", "leaf", "n", "plen").groupBy("group")
             .applyInArrow(_subtrees(min_count), "lang string, phrase string, words int, n long"))
    return built.unionByName(nodes.where(F.col("n") >= min_count)), words


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to 4 words.

    a, l and r count the phrase and the two sides of its lowest-scoring cut, n all
    words of the language; a null language is ``und``, a null text has no words.
    Candidates occur ``min_count`` times or more; those inside a longer one that has
    80 % of their occurrences are dropped, whatever becomes of that. Equal scores
    go by a, then by phrase. Repeated rows count each. An empty table, or one
    without frequent phrases, gives no rows."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    leaves = written(_leaves(texts, _pair_filter(texts, min_count)), "leaves")
    counts, words = phrase_counts(leaves, min_count, budget)
    counts = written(counts.withColumnRenamed("n", "f"), "phrases")
    found = counts.where("words > 1")

    # the words of a phrase; it has none but single spaces
    at = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    sides = found.select("lang", "phrase", "words", F.col("f").alias("a"), at.alias("at"), cut)
    part = lambda begin, size: F.array_join(F.slice("at", begin, size), " ")
    sides = sides.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("is_left"), part(F.lit(1), F.col("k")).alias("side")),
        F.struct(F.lit(False).alias("is_left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("side")))).alias("s"))
    known = counts.select("lang", F.col("phrase").alias("side"), "f")
    scored = (sides.select("lang", "phrase", "a", "k", "s.*").join(known, ["lang", "side"])
              .groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_left"), F.col("f"))).alias("l"),
                                                       F.max(F.when(~F.col("is_left"), F.col("f"))).alias("r"))
              .withColumn("score", F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) "
                                          "div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")))

    # the parts of each longer candidate that are candidates themselves, with its count
    begin, size = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("begin"), F.sequence(F.lit(2), F.col("words") - 1)
    inner = (found.where("words > 2").select("phrase", "lang", "f", "words", at.alias("at"), begin)
             .select("lang", "f", "at", "begin", "words", F.explode(size).alias("size"))
             .where("begin + size - 1 <= words")
             .groupBy("lang", part(F.col("begin"), F.col("size")).alias("phrase")).agg(F.max("f").alias("around")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * ABSORB)))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .join(words, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score"))
