"""Candidate pairs from buckets, without listing all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import written

BLOCK = 256   # rows of a bucket compared with as many others in one task


def bucket_members(keyed: DataFrame, name: str) -> DataFrame:
    """(key, node, least) of the rows (key, node) whose bucket holds another
    node; ``least`` is its smallest. The count is a partial aggregate, and the
    join of a hot key can be split."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    return written(keyed.join(shared, "key").select("key", "node", "least"), f"{name}-members")


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member with its bucket's smallest."""
    return members.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()


def open_members(members: DataFrame, components: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """(key, node, component, blocks) of the buckets that hold several
    components; those of two are left out (their pair is in the star). A bucket
    of n rows is to be dealt into ``blocks`` = n / block blocks."""
    m = (members.select("key", "node").join(components, "node", "left")
         .withColumn("component", F.coalesce("component", "node")))
    still_open = (m.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
                  .where((F.col("n") > 2) & (F.col("x") != F.col("y")))
                  .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    return written(m.join(still_open, "key"), f"{name}-open")


def pairs_across(open_: DataFrame, payload: DataFrame, agree: Callable[[list, list], np.ndarray],
                 spanning: bool = False, confirm: Callable[[object, object], bool] | None = None) -> DataFrame:
    """Pairs (a, b) of members of one bucket that are in different components
    and of which ``agree`` (a matrix, from the ``payload`` column of the rows
    and of the columns) is true. ``payload`` has node and payload.

    Each pair of a bucket's blocks is one group, bounded whatever the bucket. If
    ``agree`` is final, ``spanning`` gives of a group's pairs only those that
    connect components not yet connected by an earlier one of the group; with
    ``confirm``, a last test of two payloads, it is asked of such pairs only."""
    m = (open_.join(payload, "node").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    groups = (m.groupBy("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
              .agg(F.collect_list(F.struct("side", "node", "component", "payload")).alias("rows")))

    def compare(batches):
        for batch in batches:
            for g in range(batch.num_rows):  # one group's rows as Python objects at a time
                i, j, rows = (batch.column(c)[g].as_py() for c in ("i", "j", "rows"))
                left = [r for r in rows if r["side"] == i]
                right = left if i == j else [r for r in rows if r["side"] == j]
                if not left or not right:
                    continue
                a, b = (np.array([r["node"] for r in side]) for side in (left, right))
                ca, cb = (np.array([r["component"] for r in side]) for side in (left, right))
                across = ca[:, None] != cb[None, :]
                if not across.any():
                    continue
                pl, pr = [r["payload"] for r in left], [r["payload"] for r in right]
                x, y = np.nonzero(across & agree(pl, pr))
                if spanning:
                    x, y = _spanning(ca, cb, x, y, (lambda p, q: confirm(pl[p], pr[q])) if confirm else None)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[x], b[y]), pa.int64()), pa.array(np.maximum(a[x], b[y]), pa.int64())],
                                                 names=["a", "b"])

    return groups.select("i", "j", "rows").mapInArrow(compare, "a long, b long").distinct()


def _spanning(ca: np.ndarray, cb: np.ndarray, x: np.ndarray, y: np.ndarray, confirm) -> tuple[list[int], list[int]]:
    """Of the pairs (x, y), those that connect two components first (and are confirmed)."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        u, v = root(int(ca[p])), root(int(cb[q]))
        if u != v and (confirm is None or confirm(p, q)):
            parent[max(u, v)] = min(u, v)
            out.append((p, q))
    return [p for p, _ in out], [q for _, q in out]
