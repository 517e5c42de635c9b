"""Sharding by minimax contiguous partition of atomic groups.

Equal texts are a group and stay together. Groups stand in one order, and the
shards are runs of it. The capacity is the smallest one for which a greedy walk
(fill a shard until the next group does not fit) needs no more shards than there
are; a binary search finds it. The cuts then follow the even targets as closely as
that capacity allows: no shard passes it, and none that the greedy walk would leave
empty stays empty for want of rows. A group larger than an even share of what is
left gets a shard of its own first, so that one huge group does not set the
capacity of all the others.

Everything about rows is DataFrame work. Prefix sums of the group sizes come from a
range partitioning. The walk only asks where the last boundary at or before some
byte is; the driver answers from a summary of at most ``PIECES`` boundaries, in
which the byte ranges that matter (a few around each cut) are split further by
another aggregate until the answers are exact. Slots are ranks in one more range
partitioning, by group, id and row, so that neither a shard nor a huge group is
ever sorted in one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import written
from ragframe.operators.numbering import global_offsets

SHARDS = 24
ROW_BYTES = 8          # what a row counts beside its text
PIECES = 1 << 15       # boundaries the driver takes up at once
AROUND = 8             # known boundaries to each side of a gap that are split with it
LAW = "bytes"


class Boundaries:
    """The ends of the groups' byte ranges: some known, the rest looked up when needed."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.known, self.whole = [0, total], {total: False}   # whole: no boundary between this one and the known one before
        self._split([(0, total)], PIECES)

    def _split(self, gaps: list[tuple[int, int]], pieces: int) -> None:
        """Adds the last boundary of each of ``pieces`` equal ranges of the gaps."""
        inside, first, piece = F.lit(False), F.lit(None).cast("long"), F.lit(None).cast("long")
        for a, b in gaps:
            here = (F.col("end") > a) & (F.col("end") <= b)
            inside = inside | here
            first = F.when(here, F.lit(a)).otherwise(first)
            piece = F.when(here, F.expr(f"(end - {a}L - 1) div {max(1, -(-(b - a) // pieces))}L")).otherwise(piece)
        found = (self.ends.where(inside).groupBy(first.alias("gap"), piece.alias("piece"))
                 .agg(F.max("end").alias("end"), F.count("*").alias("n")).collect())
        for r in found:
            self.whole[r["end"]] = r["n"] == 1
        self.known = sorted({0, *self.whole})

    def last(self, byte: int, gaps: set, low: bool = True) -> int:
        """The last boundary at or before ``byte``. Where it is not known, a bound
        from below (or above) of it, and the gap is noted."""
        byte = min(byte, self.total)
        i = bisect_right(self.known, byte) - 1
        a = self.known[i]
        if a == byte or i + 1 == len(self.known) or self.whole[self.known[i + 1]]:
            return a
        gaps.add((a, self.known[i + 1]))
        return a if low else byte

    def next(self, byte: int, gaps: set) -> int:
        """The first boundary at or after ``byte``; a bound from above where it is not known."""
        i = bisect_left(self.known, max(0, byte))
        b = self.known[i]
        if b != byte and i and not self.whole[b]:
            gaps.add((self.known[i - 1], b))
        return b

    def exactly(self, fn):
        """``fn(gaps)`` with all its look-ups exact: the gaps it met are split until there are none."""
        while True:
            gaps: set = set()
            answer = fn(gaps)
            if not gaps:
                return answer
            ranges: list[list[int]] = []
            for a, b in sorted(gaps):
                i, j = bisect_left(self.known, a), bisect_left(self.known, b)
                a, b = self.known[max(0, i - AROUND)], self.known[min(len(self.known) - 1, j + AROUND)]
                if ranges and a <= ranges[-1][1]:
                    ranges[-1][1] = max(b, ranges[-1][1])
                else:
                    ranges.append([a, b])
            self._split([(a, b) for a, b in ranges], max(2, PIECES // len(ranges)))


def _fits(b: Boundaries, capacity: int, shards: int, gaps: set, low: bool = True) -> bool:
    """Whether the greedy walk reaches the end within ``shards`` shards."""
    at = 0
    for _ in range(shards):
        at = b.last(at + capacity, gaps, low)
        if at >= b.total:
            return True
    return False


def smallest_capacity(b: Boundaries, largest: int, shards: int) -> int:
    """Binary search of the smallest capacity that fits."""
    low, high = max(largest, -(-b.total // shards)), -(-b.total // shards) + largest
    while low < high:
        c = (low + high) // 2
        if _fits(b, c, shards, set()):              # even with boundaries taken too early
            ok = True
        elif not _fits(b, c, shards, set(), False):  # not even with a boundary at every byte
            ok = False
        else:
            ok = b.exactly(lambda gaps, c=c: _fits(b, c, shards, gaps))
        low, high = (low, c) if ok else (c + 1, high)
    return low


def cut_points(b: Boundaries, capacity: int, shards: int) -> list[int]:
    """The first bytes of shards 1, 2, ...: near even targets, within the capacity."""
    def walk(gaps):
        # the earliest end of each shard from which the rest still fits
        least = [b.total]
        for _ in range(shards - 1):
            least.append(b.next(least[-1] - capacity, gaps))
        least.reverse()
        at, out = 0, []
        for j in range(shards - 1):
            aim = at + -(-(b.total - at) // (shards - j))
            before, after = b.last(aim, gaps), b.next(aim, gaps)
            at = min(max(before if aim - before <= after - aim else after, least[j]), b.last(at + capacity, gaps))
            out.append(at)
        return out
    return b.exactly(walk)


def facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, size, text_crc32, digest) of every row; ``row`` only tells equal rows apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"),
                       F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("digest"))


def shards_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's bytes plus 8 (a null text has none and a null checksum;
    null texts are a group of their own). Groups are ordered by their smallest
    doc_id (nulls first), then by SHA-256. A group larger than an even share of the rest takes
    one of the first shards alone (larger ones first), the other shards follow
    the order. Slots run from 0 in order of group, doc_id (nulls first) and row;
    repeated rows have a slot each. ``grown_shard`` is null under this law. With
    fewer groups than shards some shards are empty; an empty table gives no rows."""
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = written(facts(docs, id_col, text_col), "shard-facts")
    groups = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"),
                                                F.count("*").alias("n"), F.count("doc_id").alias("known")), "shard-groups")
    # a group that holds a null id starts before all others
    groups = groups.withColumn("first", F.when(F.col("known") == F.col("n"), F.col("first")))
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    alone, rest = [], total or 0
    for r in groups.orderBy(F.desc("bytes"), "digest").select("bytes", "digest").limit(shards - 1).collect():
        if r["bytes"] * (shards - len(alone)) <= rest:
            break
        alone.append(r["digest"])
        rest -= r["bytes"]
    own = F.lit(None).cast("int")
    for shard, digest in enumerate(alone):
        own = F.when(F.col("digest") == F.lit(bytes(digest)), F.lit(shard)).otherwise(own)
    groups = groups.withColumn("own", own)
    order = ["own", "first", "digest"]          # ranks groups alone last: nulls are first in Spark
    ranged = global_offsets(groups.select(*order, "bytes", "n")
                            .withColumn("bytes_in", F.when(F.col("own").isNull(), F.col("bytes")).otherwise(0)),
                            order, "bytes_in", "start", partitions)
    ranged = written(ranged.withColumn("end", F.col("start") + F.col("bytes_in")), "shard-ranges")
    cuts: list[int] = []
    if rest:
        open_ = ranged.where("own is null")
        largest = open_.agg(F.max("bytes")).first()[0]
        b = Boundaries(open_.select("end"), rest)
        cuts = cut_points(b, smallest_capacity(b, largest, shards - len(alone)), shards - len(alone))
    shard = F.lit(len(alone))
    for c in cuts:
        shard = shard + (F.col("start") >= F.lit(c)).cast("int")
    placed = written(ranged.select("digest", "start", "n", F.coalesce("own", shard).cast("int").alias("shard")), "shard-groups")
    # rows before each shard; a table of at most ``shards`` rows
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    base, before = F.lit(0).cast("long"), 0
    for s in range(shards):
        base = F.when(F.col("shard") == s, F.lit(before).cast("long")).otherwise(base)
        before += counts.get(s, 0)
    numbered = global_offsets(rows.join(placed.drop("n"), "digest").withColumn("one", F.lit(1)),
                              ["shard", "start", "doc_id", "row"], "one", "at", partitions)
    return numbered.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("at") - base).alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
