"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item of n words is compared with every window of n words of a
document (a shorter document as a whole) that can resemble it: similarity is taken over five-word shingles, so
a window that shares none with any item of its size scores 0 and needs no
fingerprint. The remaining windows and the items get 128-bit SimHashes of their
words. Fingerprints are cut into 32 blocks of four bits: two that differ in at
most 31 bits are equal in one block at least, so looking up all blocks finds
every item within the radius. Those are verified by the exact weighted Jaccard
similarity of the shingle multisets, a shingle weighing its characters.

The benchmark is measured and taken in parts of at most ``PART_CHARS``
characters; a part's index is broadcast and every document is read against it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import id_and_text

K = 5
SIMILARITY = 0.8
RADIUS = 31                 # of 128 bits; one less than the number of blocks
PART_CHARS = 4_000_000
SLICE_WORDS = 1024          # of a text, whose windows are fingerprinted at once
_WORD = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                     0x85EBCA77C2B2AE63], dtype=np.uint64)


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of the K-word shingles, in order; none of fewer words."""
    if len(words) < K:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(words) - K + 1, dtype=np.uint64)
    for i in range(K):
        out += h[i:len(h) - K + 1 + i] * _FACTORS[i]
    return out ^ (out >> np.uint64(29))


def shingle_weights(words: list[str]) -> np.ndarray:
    size = np.cumsum([0, *map(len, words)])
    return size[K:] - size[:-K] if len(words) >= K else np.zeros(0, dtype=np.int64)


def word_digests(words: list[str]) -> np.ndarray:
    """128 bits of each word, as 16 bytes."""
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), dtype=np.uint8).reshape(-1, 16)[at]


def fingerprints(digests: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` words from each of the (ascending) starts. A word's signs are summed up
    for starts within ``SLICE_WORDS`` at a time, so that memory does not grow with the text."""
    out = np.zeros((len(starts), 16), dtype=np.uint8)
    p = 0
    while p < len(starts):
        first = int(starts[p])
        q = int(np.searchsorted(starts, first + SLICE_WORDS))
        sums = np.zeros((int(starts[q - 1]) + size - first + 1, 128), dtype=np.int32)
        np.cumsum(np.unpackbits(digests[first:first + len(sums) - 1], axis=1), axis=0, dtype=np.int32, out=sums[1:])
        at = starts[p:q] - first
        # more ones than zeros
        out[p:q] = np.packbits(2 * (sums[at + size] - sums[at]) > size, axis=1)
        p = q
    return out


def nibbles(prints: np.ndarray) -> np.ndarray:
    return np.stack([prints >> 4, prints & 15], axis=2).reshape(len(prints), 32)


def build_index(items: list[tuple[int, str]]) -> dict:
    """Plain arrays of the items of K words or more (others match nothing)."""
    ids, sizes, prints, bags, names, owner = [], [], [], [], [], []
    for item_id, text in items:
        words = split_words(text)
        if item_id is None or len(words) < K:
            continue
        shingles = shingle_hashes(words)
        names.append(np.unique(shingles))
        owner.append(np.full(len(names[-1]), len(words)))
        bags.append((Counter(shingles.tolist()), dict(zip(shingles.tolist(), shingle_weights(words).tolist(), strict=True))))
        prints.append(fingerprints(word_digests(words), np.array([0]), len(words))[0])
        ids.append(item_id)
        sizes.append(len(words))
    if not ids:
        return {"ids": []}
    # a shingle and each size of item that holds it
    pairs = np.unique(np.stack([np.concatenate(names), np.concatenate(owner).astype(np.uint64)], axis=1), axis=0)
    sizes, prints = np.array(sizes), np.array(prints)
    blocks = {}
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        values = nibbles(prints[of])
        # for each block and value of it, which items have it
        blocks[size] = (of, np.stack([values.T == v for v in range(16)], axis=1))
    return {"ids": ids, "prints": prints, "bags": bags, "blocks": blocks, "shingle": pairs[:, 0], "size": pairs[:, 1].astype(np.int64)}


def similarity(a: tuple[Counter, dict], shingles: list[int], weights: list[int]) -> float:
    """Weighted Jaccard of an item's shingle multiset and a window's."""
    counts, weigh = a
    other = Counter(shingles)
    w = dict(zip(shingles, weights, strict=True)) | weigh
    both = sum(w[s] * min(n, other[s]) for s, n in counts.items() if s in other)
    return both / (sum(w[s] * n for s, n in counts.items()) + sum(w[s] * n for s, n in other.items()) - both)


def matches(index: dict, text: str, threshold: float) -> list[tuple[int, int, int, float, int]]:
    """(item_id, first word, end word, similarity, bits that differ): the best
    window of each item that reaches the threshold, the first of equal ones.
    The only window of an item longer than the text is the whole text."""
    if not index["ids"]:
        return []
    words = split_words(text)
    shingles = shingle_hashes(words)
    at = np.searchsorted(index["shingle"], shingles)
    at[at == len(index["shingle"])] = 0
    hit = np.flatnonzero(index["shingle"][at] == shingles)
    if not len(hit):
        return []
    last = np.searchsorted(index["shingle"], shingles[hit], side="right")
    n = last - at[hit]
    where = np.repeat(hit, n)
    size = index["size"][np.repeat(at[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    digests, weights, best = word_digests(words), shingle_weights(words), {}
    for m in np.unique(size).tolist():
        # windows of m words that hold one of the shared shingles
        long = min(m, len(words))
        edge = np.zeros(len(words) + 2, dtype=np.int64)
        own = where[size == m]
        np.add.at(edge, np.maximum(own - (long - K), 0), 1)
        np.add.at(edge, own + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge)[:len(words) - long + 1] > 0)
        if not len(starts):
            continue
        items, table = index["blocks"][m]
        for p in range(0, len(starts), SLICE_WORDS):    # bounds the table of windows and items
            own = starts[p:p + SLICE_WORDS]
            prints = fingerprints(digests, own, long)
            values = nibbles(prints)
            near = np.zeros((len(own), len(items)), dtype=bool)
            for b in range(32):
                near |= table[b, values[:, b]]
            x, y = np.nonzero(near)
            bits = np.bitwise_count(prints[x] ^ index["prints"][items[y]]).sum(axis=1)
            for s, i, d in zip(own[x[bits <= RADIUS]].tolist(), items[y[bits <= RADIUS]].tolist(),
                               bits[bits <= RADIUS].tolist(), strict=True):
                score = similarity(index["bags"][i], shingles[s:s + long - K + 1].tolist(), weights[s:s + long - K + 1].tolist())
                if score >= threshold and score > best.get(i, (0, 0, -1.0, 0))[2]:
                    best[i] = (s, s + long, score, int(d))
    return [(index["ids"][i], *best[i]) for i in sorted(best)]


def index_parts(benchmark: DataFrame, id_col: str, text_col: str):
    """Broadcast indexes of the benchmark, each of about PART_CHARS characters at most."""
    b = id_and_text(benchmark, id_col, text_col)
    parts = max(1, math.ceil((b.agg(F.sum(F.length("text"))).first()[0] or 0) / PART_CHARS))
    for p in range(parts):
        rows = b.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == p).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(build_index(sorted({(r.doc_id, r.text) for r in rows
                                                                                if r.doc_id is not None})))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_word, end_word, similarity, differing_bits: a row
    per document row and item it holds. Clean documents have no row, nor have
    null and empty texts and those of fewer than five words; a text shorter than
    an item is compared with it as a whole. Items of fewer than five words, or without an
    id, match nothing; an id of several texts is several items; repeated
    rows of documents give a row each, of items one."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()),
                        ("end_word", pa.int32()), ("similarity", pa.float64()), ("differing_bits", pa.int32())])
    d = id_and_text(docs, id_col, text_col)

    def run_with(held):
        def run(batches):
            for batch in batches:
                found = [(i, *m) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                         for m in matches(held.value, t, threshold)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)],
                                                     schema=schema)
        return run

    out = None
    for held in index_parts(benchmark, item_col, item_text_col):
        part = d.mapInArrow(run_with(held), "doc_id long, item_id long, first_word int, end_word int, "
                                            "similarity double, differing_bits int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    def clean_of(held):
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not matches(held.value, t, threshold) for t in texts.fillna("")], dtype=bool)
        return clean

    for held in index_parts(benchmark, item_col, item_text_col):
        docs = docs.where(clean_of(held)(F.col(text_col).cast("string")))
    return docs
