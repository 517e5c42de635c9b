"""Brute-force chunking: lossless sentence split, greedy token packing with a
word -> character fallback for oversize units, and forward overlap.

Everything is row-local (a document is a row): the plan is a scan followed
by projections and one ``explode``; no shuffle. Per-document arrays must fit
in one task, which bounds the size of a single document, not of the table.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import SENTENCE_PATTERN, split_keep
from ragframe.functions.tokens import PythonCounter, TokenCounter, chars4, get_counter
from ragframe.operators.cuts import heads_by, pack_at, pack_codes, packed_by, py_chain, runs
from ragframe.operators.folds import greedy_head, greedy_pack
from ragframe.operators.partitioning import spread

# Fixed values of the reference: token limit 1000, word limit = token limit,
# char limit = 4 x word limit, overlap 34 % (int(1000 * 0.34) = 340 tokens).
TOKEN_LIMIT = 1000
OVERLAP_PERCENTAGE = 0.34


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda variable is bound to it."""
    return F.get(F.transform(F.array(value), body), 0)


def word_pieces(u: Column, word_limit: int) -> Column:
    """Groups of ``word_limit`` words split on single spaces, re-joined with a
    space; pieces after the first carry the ' ' separator in front."""
    return _let(F.split(u, " ", -1), lambda words: F.transform(
        F.sequence(F.lit(0), F.size(words) - 1, F.lit(word_limit)),
        lambda s: F.concat(F.when(s > 0, F.lit(" ")).otherwise(F.lit("")),
                           F.array_join(F.slice(words, s + 1, F.lit(word_limit)), " "))))


def char_pieces(w: Column, char_limit: int) -> Column:
    """Every ``char_limit`` characters (code points), in one pass; empty text -> []."""
    return F.regexp_extract_all(w, F.lit(f"(?s).{{1,{char_limit}}}"), 0)


Splitter = Callable[[Column], Column]


def words_splitter(word_limit: int) -> Splitter:
    return lambda t: word_pieces(t, word_limit)


def chars_splitter(char_limit: int) -> Splitter:
    return lambda t: char_pieces(t, char_limit)


def default_chain(word_limit: int, char_limit: int) -> list[Splitter]:
    """The reference's fallback chain: words, then characters."""
    return [words_splitter(word_limit), chars_splitter(char_limit)]


def leaves(units: Column, limit: int, counter: TokenCounter, chain: list[Splitter]) -> Column:
    """Expand units into the leaves that get packed. A piece within the
    limit is one leaf; an oversize piece is split by the next splitter of
    ``chain`` (an ordered list of ``Column -> array<string>`` functions whose
    pieces after the first carry their separator); after the last splitter a
    piece stays whole.

    Each leaf carries ``b`` / ``a``: a chunk must start before / after it.
    That is the case for the first / last piece of a split (oversize)
    element, and around an oversize piece the chain cannot split further:
    every ancestor of a split piece is itself oversize, so these two local
    flags reproduce the recursive flush-before / flush-after rule."""
    depth = len(chain)

    def leaf(t, n, b, a):
        return F.array(F.struct(t.alias("t"), n.alias("n"), b.alias("b"), a.alias("a")))

    def expand(t, level, first, last):
        n = counter(t)
        if level == depth:
            over = n > limit
            return leaf(t, n, first | over, last | over)
        pieces = chain[level](t)
        size = F.size(pieces)
        # index from the front and from the back, so lambdas stay local
        zipped = F.arrays_zip(pieces.alias("x"), F.sequence(F.lit(1), size).alias("i"),
                              F.sequence(size, F.lit(1), F.lit(-1)).alias("r"))
        split = F.flatten(F.transform(zipped, lambda z: expand(z["x"], level + 1, z["i"] == 1, z["r"] == 1)))
        return F.when(n > limit, split).otherwise(leaf(t, n, first, last))

    return F.flatten(F.transform(units, lambda u: expand(u, 0, F.lit(False), F.lit(False))))


def pack_units(units: Column, limit: int = TOKEN_LIMIT, *, word_limit: int | None = None,
               char_limit: int | None = None, counter: TokenCounter | str = chars4,
               chain: list[Splitter] | None = None) -> Column:
    """units -> array of chunk texts (C4 + C5, splitter chain M2)."""
    counter = get_counter(counter)
    word_limit = limit if word_limit is None else word_limit
    char_limit = 4 * word_limit if char_limit is None else char_limit
    chain = default_chain(word_limit, char_limit) if chain is None else chain
    return greedy_pack(leaves(units, limit, counter, chain), limit)


def chunk_text(text: Column, limit: int = TOKEN_LIMIT, *, pattern: str = SENTENCE_PATTERN,
               word_limit: int | None = None, char_limit: int | None = None,
               counter: TokenCounter | str = chars4, chain: list[Splitter] | None = None) -> Column:
    """Document text -> array of chunk texts. Concatenating the chunks gives
    the text back."""
    return pack_units(split_keep(text, pattern), limit, word_limit=word_limit,
                      char_limit=char_limit, counter=counter, chain=chain)


def overlap_heads(chunks: Column, limit: int = TOKEN_LIMIT, *, pattern: str = SENTENCE_PATTERN,
                  overlap: float = OVERLAP_PERCENTAGE, word_limit: int | None = None,
                  char_limit: int | None = None, counter: TokenCounter | str = chars4,
                  chain: list[Splitter] | None = None) -> Column:
    """For each chunk, the first piece of re-splitting and re-packing it with
    limit ``int(limit * overlap)``. The word/char limits of the splitters stay
    those of the main pass (the reference binds them at definition time)."""
    ov = int(limit * overlap)
    word_limit = limit if word_limit is None else word_limit
    char_limit = 4 * word_limit if char_limit is None else char_limit
    counter = get_counter(counter)
    chain = default_chain(word_limit, char_limit) if chain is None else chain
    return F.transform(chunks, lambda c: greedy_head(
        leaves(split_keep(c, pattern), ov, counter, chain), ov))


def with_overlap(chunks: Column, heads: Column) -> Column:
    """chunk i += head of original chunk i+1; the last chunk is unchanged."""
    nxt = F.array_append(F.slice(heads, 2, F.greatest(F.size(heads) - 1, F.lit(0))),
                         F.lit(None).cast("string"))
    return F.transform(F.arrays_zip(chunks.alias("c"), nxt.alias("h")),
                       lambda z: F.concat(z["c"], F.coalesce(z["h"], F.lit(""))))


def chunk_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    limit: int = TOKEN_LIMIT, pattern: str = SENTENCE_PATTERN,
                    overlap: float | None = None, counter: TokenCounter | str = chars4,
                    word_limit: int | None = None, char_limit: int | None = None,
                    chain: list[Splitter] | None = None) -> DataFrame:
    """documents -> rows ``(id, chunk_no, chunk, n_tokens)``.

    With ``overlap`` set, chunk i is extended by the head of chunk i+1.
    ``counter`` is a name, a ``Column -> Column`` function or a ``PythonCounter``
    (``chain`` then lists Python splitters, text -> pieces). A null text has one
    null chunk. Plan: scan -> project (split, sizes) -> cuts by Arrow -> project
    (join) -> generate; no exchange."""
    counter_fn = get_counter(counter)
    words = limit if word_limit is None else word_limit
    chars = 4 * words if char_limit is None else char_limit
    units = split_keep(F.col(text_col), pattern)
    in_python = isinstance(counter_fn, PythonCounter)
    if in_python:
        splitters = py_chain(words, chars) if chain is None else chain
        base = spread(df).select(id_col, packed_by(units, limit, counter_fn, splitters).alias("_chunks"))
    else:
        splitters = default_chain(words, chars) if chain is None else chain
        base = spread(df).select(F.col(id_col), leaves(units, limit, counter_fn, splitters).alias("_leaves"))
        base = base.select(id_col, F.transform("_leaves", lambda x: x["t"]).alias("_texts"),
                           pack_at(pack_codes(F.col("_leaves")), limit).alias("_cuts"))
        base = base.select(id_col, runs("_texts", "_cuts", lambda ts: F.array_join(ts, "")).alias("_chunks"))
    if overlap:
        if in_python:
            heads = heads_by(F.transform("_chunks", lambda c: split_keep(c, pattern)), int(limit * overlap), counter_fn, splitters)
        else:
            heads = overlap_heads(F.col("_chunks"), limit, pattern=pattern, overlap=overlap, word_limit=words,
                                  char_limit=chars, counter=counter_fn, chain=splitters)
        base = base.select(id_col, "_chunks", heads.alias("_heads")) \
                   .select(id_col, with_overlap(F.col("_chunks"), F.col("_heads")).alias("_chunks"))
    out = base.select(id_col, F.posexplode_outer("_chunks").alias("chunk_no", "chunk"))
    return out.select(id_col, F.col("chunk_no").cast("long").alias("chunk_no"), "chunk",
                      counter_fn(F.col("chunk")).alias("n_tokens"))


def chunk_counts(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of chunks per document."""
    return chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks"))
