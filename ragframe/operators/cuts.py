"""Where the runs of a document's pieces begin: prefix sums and binary search.

A document's pieces (leaves of a chunker, paragraphs) stay in the JVM as one array;
only their sizes, one number each, go to Python in Arrow batches, and the places of
the cuts come back. Each cut is one binary search, each text is joined once: the
work grows with the length of the document."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_cuts(sizes: np.ndarray, forced: np.ndarray, limit: int) -> list[int]:
    """Starts of the greedy runs, and the end: a run goes on while its sizes add up to
    at most ``limit`` and no start is ``forced``; one piece is a run whatever its size."""
    n = len(sizes)
    before = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(sizes, out=before[1:])
    walls = np.append(np.flatnonzero(forced), n)
    cuts, at = [], 0
    while at < n:
        cuts.append(at)
        full = int(np.searchsorted(before, before[at] + limit, side="right")) - 1
        wall = int(walls[np.searchsorted(walls, at + 1)]) if at + 1 <= n else n
        at = min(max(full, at + 1), wall)
    return [*cuts, n]


def section_cuts(lengths: np.ndarray, starts: np.ndarray, min_chars: int) -> list[int]:
    """The starts (ascending) at which more than ``min_chars`` characters lie since the cut before."""
    before = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=before[1:])
    cuts, at = [], 0
    while True:
        # the first place with enough behind it, then the first start from there
        enough = max(int(np.searchsorted(before, before[at] + min_chars, side="right")), at + 1)
        i = int(np.searchsorted(starts, enough))
        if i == len(starts):
            return cuts
        at = int(starts[i])
        cuts.append(at)


def _per_row(fn: Callable[[np.ndarray], list[int]]):
    @F.pandas_udf("array<int>")
    def cuts(codes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else fn(np.asarray(c, dtype=np.int64)) for c in codes], dtype=object)
    return cuts


def pack_codes(leaves: Column) -> Column:
    """What ``pack_at`` needs of each leaf (see ``folds.LEAF_FIELDS``), as one number."""
    bit = lambda c, value: F.when(c, F.lit(value)).otherwise(F.lit(0))
    return F.transform(leaves, lambda x: x["n"] * 4 + bit(x["b"], 2) + bit(x["a"], 1))


def pack_at(codes: Column, limit: int) -> Column:
    """Greedy runs of leaves: their starts and the end (``greedy_pack`` by positions)."""
    def run(c: np.ndarray) -> list[int]:
        after = np.zeros(len(c), dtype=bool)
        after[1:] = (c[:-1] & 1) > 0
        return pack_cuts(c >> 2, ((c & 2) > 0) | after, limit)
    return _per_row(run)(codes)


def sections_at(codes: Column, min_chars: int, merge_tail: bool) -> Column:
    """Sections of paragraphs given as length * 2 + (1 if it may start one): their starts
    and the end. With ``merge_tail`` the last section joins the one before it."""
    def run(c: np.ndarray) -> list[int]:
        if not len(c):
            return [0]
        cuts = [0, *section_cuts(c >> 1, np.flatnonzero(c & 1), min_chars)]
        if merge_tail and len(cuts) > 1:
            cuts.pop()
        return [*cuts, len(c)]
    return _per_row(run)(codes)


def runs(items: str, cuts: str, make: Callable[[Column], Column]) -> Column:
    """``make`` of each run of the array column ``items`` between neighbouring ``cuts`` (both plain columns)."""
    spans = F.arrays_zip(F.slice(cuts, 1, F.size(cuts) - 1).alias("a"), F.slice(cuts, 2, F.size(cuts) - 1).alias("b"))
    return F.transform(spans, lambda s: make(F.slice(items, s["a"] + 1, s["b"] - s["a"])))


def _word_pieces(text: str, n: int) -> list[str]:
    """Pieces that begin at every ``n``-th space."""
    words = text.split(" ")
    return [(" " if i else "") + " ".join(words[i:i + n]) for i in range(0, len(words), n)]


def _char_pieces(text: str, n: int) -> list[str]:
    return [text[i:i + n] for i in range(0, len(text), n)]


PySplitter = Callable[[str], list[str]]


def py_chain(word_limit: int, char_limit: int) -> list[PySplitter]:
    """The fallback chain for tokenizers in Python: words, then characters."""
    return [lambda t: _word_pieces(t, word_limit), lambda t: _char_pieces(t, char_limit)]


def sized_leaves(documents: list[list[str]], limit: int, sizes_of, chain: list[PySplitter]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """(pieces, sizes, forced starts) of each document's units. One call sizes the units of all
    documents; the pieces of those over ``limit`` are sized together, level by level of ``chain``.
    A break is forced before and after the pieces of a unit that was taken apart, and around a
    piece that no splitter is left for."""
    # (document, place in it as a tuple of numbers, text, forced before, forced after)
    open_ = [(d, (i,), u, False, False) for d, units in enumerate(documents) for i, u in enumerate(units)]
    done: list[list[tuple]] = [[] for _ in documents]
    for level in range(len(chain) + 1):
        sizes = sizes_of([t for _, _, t, _, _ in open_]) if open_ else []
        finer = []
        for (d, place, text, before, after), n in zip(open_, sizes, strict=True):
            if n > limit and level < len(chain):
                pieces = chain[level](text)
                finer += [(d, (*place, i), p, i == 0, i == len(pieces) - 1) for i, p in enumerate(pieces)]
            else:
                over = n > limit
                done[d].append((place, text, n, before or over, after or over))
        open_ = finer
    out = []
    for leaves in done:
        leaves.sort(key=lambda x: x[0])
        after = [False, *(x[4] for x in leaves)][:len(leaves)]
        out.append(([x[1] for x in leaves], np.array([x[2] for x in leaves], dtype=np.int64),
                    np.array([x[3] for x in leaves], dtype=bool) | np.array(after, dtype=bool)))
    return out


def packed_by(units: Column, limit: int, counter, chain: list[PySplitter]) -> Column:
    """Chunk texts of each array of units, sized by a Python tokenizer (``PythonCounter``)."""
    @F.pandas_udf("array<string>")
    def pack(docs: pd.Series) -> pd.Series:
        sizes_of, known = counter.bound(), [d for d in docs if d is not None]
        made = iter(sized_leaves([list(d) for d in known], limit, sizes_of, chain))
        out = []
        for d in docs:
            if d is None:
                out.append(None)
                continue
            texts, sizes, forced = next(made)
            cuts = pack_cuts(sizes, forced, limit)
            out.append(["".join(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pd.Series(out, dtype=object)
    return pack(units)


def heads_by(chunk_units: Column, limit: int, counter, chain: list[PySplitter]) -> Column:
    """The first run of each chunk, given as the array of its units, under ``limit``."""
    @F.pandas_udf("array<string>")
    def heads(docs: pd.Series) -> pd.Series:
        sizes_of, known = counter.bound(), [d for d in docs if d is not None]
        made = iter(sized_leaves([list(u) for d in known for u in d], limit, sizes_of, chain))
        out = []
        for d in docs:
            rows = [] if d is not None else None
            for _ in range(0 if d is None else len(d)):
                texts, sizes, forced = next(made)
                cuts = pack_cuts(sizes, forced, limit)
                rows.append("".join(texts[:cuts[1]]) if len(cuts) > 1 else "")
            out.append(rows)
        return pd.Series(out, dtype=object)
    return heads(chunk_units)
