"""Sharding: SQL on edge rows, the smallest capacity by trying all, and the laws."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ragframe.llm import sharding, sql

SCHEMA = "doc_id long, text string, size int, shard string, digest int"


def tables():
    rng = np.random.default_rng(6)
    long_tail = [(i, "x" * int(s) + str(i), 1) for i, s in enumerate(rng.pareto(1.2, 400) * 40)]
    odd = [(500, None, 1), (501, None, 1), (502, "", 1), (503, "", 1), (None, "é😀", 1), (None, None, 1), (7, "again", 1), (7, "again", 1), (9, "x" * 40, 1)]
    hot = [(1000 + i, "boilerplate " * 4, 1) for i in range(250)]
    return {"tail": long_tail + odd, "hot": long_tail[:200] + hot + odd, "few": [(i, f"text {i}", 1) for i in range(30)],
            "one": [(1, "a", 1)], "same": [(i, "same", 1) for i in range(100)], "two large": [(1, "a" * 900, 1), (2, "b" * 800, 1)] + [(i, str(i), 1) for i in range(3, 90)]}


def shards(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 3, "s", 4) for i, t, _ in rows], SCHEMA).repartition(5)
    return sharding.shards_by_bytes(df, **kw).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()


def least_capacity(sizes, parts):
    """The smallest capacity, by trying from below."""
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= parts
    c = max(max(sizes), -(-sum(sizes) // parts))
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("name", sorted(tables()))
def test_edge_tables_equal_sql_and_keep_the_law(spark, name):
    rows = tables()[name]
    got = shards(spark, rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, _ in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(sql.shards()).fetchall()))
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(
        str((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode()))) for i, t, _ in rows)
    for s in {r.shard for r in got}:
        assert 0 <= s < 24 and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # equal texts are together, and the largest shard is as small as the order allows
    where, first, size = defaultdict(set), {}, Counter()
    by_key = defaultdict(set)
    for r in got:
        by_key[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(v) == 1 for v in by_key.values())
    import hashlib
    for i, t, _ in rows:
        size[t] += len((t or "").encode()) + 8
        key = (i is not None, i or 0)
        first[t] = min(first.get(t, key), key)
    order = sorted(size, key=lambda t: (first[t], "" if t is None else hashlib.sha256(t.encode()).hexdigest()))
    alone, rest = [], sum(size.values())
    for t in sorted(size, key=lambda t: (-size[t], "" if t is None else hashlib.sha256(t.encode()).hexdigest()))[:23]:
        if size[t] * (24 - len(alone)) <= rest:
            break
        alone.append(t)
        rest -= size[t]
    others = [size[t] for t in order if t not in alone]
    bytes_of = Counter()
    for r in got:
        bytes_of[r.shard] += r.size
    best = max([size[t] for t in alone] + ([least_capacity(others, 24 - len(alone))] if others else []))
    assert max(bytes_of.values()) == best


def test_few_equal_groups_are_spread_evenly(spark):
    held = Counter(r.shard for r in shards(spark, [(i, f"{i:04d}", 1) for i in range(50)]))
    assert sorted(held.values()) == [2] * 22 + [3] * 2


def test_summary_is_refined_until_exact(spark, monkeypatch):
    """With few known boundaries at a time the answers stay the same."""
    rows = tables()["tail"][:120]
    want = sorted(map(str, map(tuple, shards(spark, rows))))
    monkeypatch.setattr(sharding, "PIECES", 100)
    monkeypatch.setattr(sharding, "AROUND", 1)
    assert sorted(map(str, map(tuple, shards(spark, rows)))) == want


def test_empty_table_and_plan(spark):
    assert shards(spark, []) == []
    df = spark.createDataFrame([(1, "a", 3, "s", 4)], SCHEMA)
    assert not re.search("Python|Arrow|Pandas", sharding.shards_by_bytes(df)._jdf.queryExecution().toString())
