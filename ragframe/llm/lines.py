"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, components.

Lines are normalised (lower case, white space collapsed); equal ones are a class
(one aggregate). Each class has a 64-bit SimHash of its words, in which longer
words weigh more, or lines would be alike by their small words. The fingerprint
is cut into five blocks: of two fingerprints that differ in at most three bits,
two blocks at least are equal, so lines are bucketed by all ten pairs of blocks
and none within the radius is missed (beyond ``FEW_LINES`` lines by three of six
blocks, so that buckets of unrelated lines stay rare). A bucket of two is settled where it is
counted (its fingerprints' exclusive or says how far they are apart). Of one of
up to ``IN_TASK`` lines those without another line within the radius are left out
by comparing all of them in the task that counted it, so that what goes on grows
with the similar lines and not with the unrelated ones that share a bucket. The
lines that remain are dealt once more on each fourth of the fingerprint, of which at
least one is equal within the radius, so that unrelated lines part. There a
bucket's members are paired with its smallest one; pairs within the radius are
verified by edit similarity and links closed into components. Buckets that then
hold several components are compared in blocks, which test pairs across
components until they are connected and give back those links alone. The first
occurrence of each connected group stays.

A line of fewer than ``MIN_WORDS`` words says too little to be called a fuzzy
copy; with ``short_copies`` its exact copies (normalised) go like any others,
without it they stay.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.buckets import open_members, pairs_across, star_pairs
from ragframe.llm.common import id_and_text, written
from ragframe.llm.components import connected_components

MIN_WORDS = 5
SIMILARITY = 0.9             # 1 - edit distance / longer length, of normalised lines
RADIUS = 3
SHORT_WORD, LONG_WEIGHT = 4, 3   # words of so many letters or more weigh 3, shorter ones 1
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))   # first bit and width
FEW_LINES = 1 << 24          # beyond, keys of two of five blocks (26 bits) would be shared by unrelated lines
MORE_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))   # three of six: 20 keys of 31 bits or more
IN_TASK = 4096               # lines of a bucket that are compared with each other where they are counted
PIECE = 5                    # characters of a piece of a line that is looked for in another
SLICE_CHARS = 100_000        # of text, whose lines are fingerprinted at once
FOURTH = 0x1111_1111_1111_1111   # every fourth bit of a fingerprint
BROADCAST_LINES = 2_000_000  # line numbers of the largest removal list that is broadcast

_WORD = re.compile(r"\w+")


_WORD_CHARS = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))   # of Latin-1, which begins with ASCII


def words_of(line: str) -> list:
    """Its words; those of an ASCII line as bytes."""
    if line.isascii():
        return line.encode().translate(_WORD_CHARS).split()
    try:
        return line.encode("latin-1").translate(_WORD_CHARS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(line)


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


# of each byte its bits as counters of 8 bits in one integer, so that a sum adds eight at once
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
_PART = 255 // LONG_WEIGHT     # words whose weights fit 8 bits


def simhashes(lines: list[list]) -> np.ndarray:
    """64-bit SimHash of each (not empty) list of words, by weight; ASCII words may be bytes."""
    if not lines:
        return np.zeros(0, dtype=np.int64)
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    n = int(size.sum())
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lines)), dtype="<u8", count=n)
    letters = np.fromiter(map(len, chain.from_iterable(lines)), dtype=np.int64, count=n)
    weights = np.where(letters < SHORT_WORD, 1, LONG_WEIGHT)
    # parts of a line small enough for 8 bits
    parts = -(-size // _PART)
    first = np.cumsum(parts) - parts
    part_of = np.repeat(np.arange(len(lines)), parts)
    cuts = np.append((np.cumsum(size) - size)[part_of] + (np.arange(len(part_of)) - first[part_of]) * _PART, n)
    ones = np.zeros((len(part_of), 64), dtype=np.uint8)
    for p in range(0, len(part_of), 2000):  # bounds the table of counters
        c = cuts[p:p + 2001]
        own = slice(c[0], c[-1])
        counters = _BYTE_BITS[hashes[own].view(np.uint8)].reshape(-1, 8) * weights[own, None].astype("<u8")
        ones[p:p + 2000] = np.add.reduceat(counters, c[:-1] - c[0], axis=0).view(np.uint8)
    total = np.add.reduceat(weights, cuts[first])
    if len(part_of) > len(lines):
        ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones.astype(np.int64) > total[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _pieces_stay(a: str, b: str, most: int) -> bool:
    """False only if the edit distance is more than ``most``: an edit breaks one of
    a's pieces at most, and a whole one is in b at most ``most`` places further."""
    left = most
    for i in range(0, len(a) - PIECE + 1, PIECE):
        if b.find(a[i:i + PIECE], max(i - most, 0), i + PIECE + most) < 0:
            left -= 1
            if left < 0:
                return False
    return True


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` or less: the bit-parallel dynamic
    programme, a column of the table in two integers. A common beginning and end
    cost nothing and are left out; words replaced one by one, pieces that are not in
    the other and letters that only one has settle many pairs."""
    if abs(len(a) - len(b)) > most:
        return False
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    a, b = a[:len(a) - n], b[:len(b) - n]
    if max(len(a), len(b)) <= most:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) <= most:
        return True
    if not _pieces_stay(a, b, most):
        return False
    x, y = Counter(a), Counter(b)
    if max((x - y).total(), (y - x).total()) > most:
        return False
    if not a or not b:
        return True
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for n, c in enumerate(b, 1):
        same = where.get(c, 0)
        flat = same | down
        zero = (((same & up) + up) ^ up) | same
        right_up, right_down = down | ~(zero | up) & full, up & zero
        distance += bool(right_up & top) - bool(right_down & top)
        if distance - (len(b) - n) > most:
            return False
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = right_down | ~(flat | right_up) & full, right_up & flat
    return distance <= most


def _fingerprints(docs: DataFrame, short_copies: bool) -> DataFrame:
    """(doc_id, line, digest, simhash) of every line of MIN_WORDS words or more;
    with ``short_copies`` also of shorter ones that aren't blank, without a simhash."""
    names = ["doc_id", "line", "digest", "simhash"]

    def prints(where, at, lines):
        words = [words_of(x) for x in lines]
        long = [k for k, ws in enumerate(words) if len(ws) >= MIN_WORDS]
        values: list = [None] * len(lines)
        for k, x in zip(long, simhashes([words[k] for k in long]).tolist(), strict=True):
            values[k] = x
        if not short_copies:
            own = [len(ws) >= MIN_WORDS for ws in words]
            where, at = [x for x, k in zip(where, at, strict=True) if own[k]], [k for k in at if own[k]]
        digests = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in where], pa.int64()), pa.array([n for _, n in where], pa.int32()),
             pa.array([digests[k] for k in at], pa.binary()), pa.array([values[k] for k in at], pa.int64())], names=names)

    def run(batches):
        # equal lines of a slice are fingerprinted once: ``at`` has each line's place among the different ones
        where, at, lines, size = [], [], {}, 0
        for batch in batches:
            texts = batch.column("text")
            for r, i in enumerate(batch.column("doc_id").to_pylist()):
                for n, line in enumerate(texts[r].as_py().split("\n")):
                    line = normalise(line)
                    if line:
                        where.append((i, n))
                        at.append(lines.setdefault(line, len(lines)))
                        size += len(line)
                        if size > SLICE_CHARS:
                            yield prints(where, at, lines)
                            where, at, lines, size = [], [], {}, 0
        if where:
            yield prints(where, at, lines)

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, line int, digest binary, simhash long")


def block_keys(simhash: Column, blocks: tuple = BLOCKS) -> Column:
    """The ways to choose all blocks but ``RADIUS`` (ten pairs of five), each with its number in its top bits."""
    def key(n, chosen):
        out = F.lit(0).cast("long")
        for first, width in chosen:
            bits = F.shiftrightunsigned(simhash, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out = F.shiftleft(out, width).bitwiseOR(bits)
        # above all blocks, whose widths differ: keys of two ways are never equal
        return out.bitwiseOR(F.lit(n << 48).cast("long"))
    return F.array(*(key(n, chosen) for n, chosen in enumerate(combinations(blocks, len(blocks) - RADIUS))))


def _any_near(prints: np.ndarray) -> np.ndarray:
    """Of each row of fingerprints (a bucket), which have another one of the row within the radius."""
    near = np.zeros(prints.shape, dtype=bool)
    for step in range(1, prints.shape[1]):
        close = np.bitwise_count(prints[:, step:] ^ prints[:, :-step]) <= RADIUS
        near[:, step:] |= close
        near[:, :-step] |= close
    return near


def _without_alone(batches):
    """The rows (key, simhash, n among others; a bucket's ``n`` rows follow one another) but for those of buckets
    of 3 to ``IN_TASK`` rows that have no other of their bucket within the radius. At most the rows of one such
    bucket are held over; rows that do not follow one another all stay."""
    def judged(table):
        key, n = (table.column(c).to_numpy() for c in ("key", "n"))
        prints = table.column("simhash").to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(starts, len(key)))
        keep = np.ones(len(key), dtype=bool)
        whole = (size == n[starts]) & (size > 2) & (size <= IN_TASK)
        for m in np.unique(size[whole]).tolist():
            rows = starts[whole & (size == m)][:, None] + np.arange(m)
            keep[rows] = _any_near(prints[rows])
        return table.filter(pa.array(keep))

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        key, n = (table.column(c).to_numpy() for c in ("key", "n"))
        last = len(key) - int(np.argmin(np.append(key[::-1] == key[-1], False)))
        # the last bucket's rows may go on in the next batch
        cut = last if 2 < n[-1] <= IN_TASK and len(key) - last < n[-1] else len(key)
        held = table.slice(cut) if cut < len(key) else None
        if cut:
            yield from judged(table.slice(0, cut)).to_batches()
    if held is not None:
        yield from judged(held).to_batches()


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) within the radius whose bucket holds no third line, and (key,
    node, least) of those parts of larger buckets in which a fourth of the
    fingerprint is equal. Rows are shuffled once for the buckets and once for
    their parts; a bucket's rows come sorted and are held in Spark's buffer that spills."""
    blocks = BLOCKS if classes.count() <= FEW_LINES else MORE_BLOCKS
    keyed = classes.where("simhash is not null").select("node", "simhash", F.explode(block_keys(F.col("simhash"), blocks)).alias("key"))
    bucket = Window.partitionBy("key")
    shared = (keyed.select("key", "node", "simhash", F.count("*").over(bucket).alias("n"), F.min("node").over(bucket).alias("a"),
                           F.max("node").over(bucket).alias("b"), F.bit_xor("simhash").over(bucket).alias("apart"))
              .where((F.col("n") > 2) | ((F.col("n") == 2) & (F.col("node") == F.col("a")) & (F.bit_count("apart") <= RADIUS)))
              .select("key", "node", "simhash", "n", "a", "b"))
    shared = written(shared.mapInArrow(_without_alone, shared.schema), "lines-shared")
    # of at most three different bits, one of the four fourths (every fourth bit) holds none
    fourths = F.array(*(F.xxhash64("key", F.lit(q), F.col("simhash").bitwiseAND(F.lit(FOURTH << q if q < 3 else (FOURTH << 3) - (1 << 64))))
                        for q in range(4)))
    larger = shared.where("n > 2").select("node", F.explode(fourths).alias("key"))
    members = written(larger.select("key", "node", F.min("node").over(bucket).alias("least"), F.count("*").over(bucket).alias("n"))
                      .where("n > 1").drop("n"), "lines-members")
    return shared.where("n = 2").select("a", "b").distinct(), members


def _within_radius(left: list, right: list) -> np.ndarray:
    x, y = (np.array([p["simhash"] for p in side], dtype=np.int64).view(np.uint64) for side in (left, right))
    return np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS


def _similar(x: str, y: str, similarity: float) -> bool:
    return within_edits(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9))


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(node, text): the normalised first line of each class in ``nodes``."""
    wanted = written(classes.join(nodes.distinct(), "node").groupBy(F.col("first.doc_id").alias("doc_id"))
                     .agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "node")).alias("lines")), f"{name}-wanted")
    n = wanted.agg(F.sum(F.size("lines"))).first()[0] or 0
    if n <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)

    def pick(batches):
        for batch in batches:
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                own = text.split("\n")
                # of repeated rows of an id with different texts, those that have the line
                good = [x for x in lines if x["line"] < len(own)]
                yield pa.RecordBatch.from_arrays([pa.array([x["node"] for x in good], pa.int64()),
                                                  pa.array([normalise(own[x["line"]]) for x in good], pa.string())],
                                                 names=["node", "text"])

    found = docs.join(wanted, "doc_id").select("text", "lines").mapInArrow(pick, "node long, text string")
    return written(found.groupBy("node").agg(F.min("text").alias("text")), f"{name}-texts")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float, name: str) -> DataFrame:
    """The pairs whose lines have the edit similarity."""
    pairs = written(pairs, f"{name}-pairs")
    t = _texts(docs, classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), name)
    both = (pairs.join(t.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
            .join(t.select(F.col("node").alias("b"), F.col("text").alias("y")), "b"))


    @F.pandas_udf("boolean")
    def alike(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_similar(x, y, similarity) for x, y in zip(xs, ys, strict=True)], dtype=bool)

    return written(both.where(alike("x", "y")).select("a", "b"), f"{name}-links")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   similarity: float = SIMILARITY, short_copies: bool = False) -> DataFrame:
    """(doc_id, lines): numbers of each document's lines, from 0, of which
    another occurrence stays. Documents that keep every line have no row.
    The occurrence that stays is the one of the smallest id, then line."""
    d = id_and_text(docs, id_col, text_col)
    lines = written(_fingerprints(d, short_copies), "lines")
    classes = written(lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line")).alias("first"),
                                                  F.count("*").alias("n"), F.first("simhash").alias("simhash"))
                      .withColumn("node", F.monotonically_increasing_id()), "line-classes")
    pairs, members = _candidates(classes)
    prints = classes.select("node", "simhash")
    near = (star_pairs(members).join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b")
            .where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS).select("a", "b"))
    near = near.unionByName(pairs).distinct()
    links = _verified(near, d, classes, similarity, "star")
    open_ = open_members(members, connected_components(links), "lines")
    payload = _texts(d, classes, open_.select("node"), "open").join(prints, "node").select(
        "node", F.struct("simhash", "text").alias("payload"))
    more = written(pairs_across(open_, payload, _within_radius, spanning=True,
                                confirm=lambda x, y: _similar(x["text"], y["text"], similarity)), "more-links")
    components = connected_components(links.unionByName(more))
    linked = classes.join(components, "node")
    first = linked.groupBy("component").agg(F.min("first").alias("stays"))
    stays = (linked.join(first, "component").select("digest", "stays")
             .unionByName(classes.join(components, "node", "left_anti").where("n > 1")
                          .select("digest", F.col("first").alias("stays"))))
    return (lines.join(stays, "digest").where(F.struct("doc_id", "line") != F.col("stays"))
            .groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similarity: float = SIMILARITY, short_copies: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` as the struct ``row``, with n_lines,
    removed (line numbers) and text (what stays, null as it was).

    A null or empty text has one empty line, which stays. Rows of one id
    lose the same lines, so repeated rows stay alike; a row without an id loses
    none and takes none from others. An empty table gives an empty one."""
    gone = written(repeated_lines(docs, id_col, text_col, similarity, short_copies), "removed")
    n = gone.agg(F.sum(F.size("lines"))).first()[0] or 0
    if n <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("_text"))
    own = (own.join(gone, "doc_id", "left").withColumn("removed", F.coalesce("lines", F.array().cast("array<int>")))
           .withColumn("own", F.split("_text", "\n")))
    stays = F.array_except(F.sequence(F.lit(0), F.size("own") - 1), F.col("removed"))
    text = F.when(F.size("removed") == 0, F.col("_text")).otherwise(
        F.array_join(F.transform(stays, lambda i: F.col("own")[i]), "\n"))
    n_lines = F.when(F.col("own").isNull(), 1).otherwise(F.size("own"))
    return own.select("row", "doc_id", n_lines.alias("n_lines"), "removed", text.alias("text"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                    similarity: float = SIMILARITY, short_copies: bool = False) -> DataFrame:
    """``docs`` with its columns, texts without the removed lines and lengths to
    match. A document of which no line stays is a copy throughout and goes; one
    that was null, empty or blank before stays as it was."""
    done = dedup_lines(docs, id_col, text_col, similarity, short_copies).where(F.size("removed") < F.col("n_lines"))
    out = []
    for c in docs.columns:
        old = F.col("row")[c]
        if c == text_col:
            old = F.when(F.size("removed") == 0, old).otherwise(F.col("text"))
        elif c == length_col:
            old = F.when(F.size("removed") == 0, old).otherwise(F.length("text").cast(docs.schema[c].dataType))
        out.append(old.alias(c))
    return done.select(*out)
