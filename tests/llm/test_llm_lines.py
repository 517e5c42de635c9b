import random
from collections import defaultdict
from itertools import combinations

import pytest

from ragframe.llm import buckets, lines
from ragframe.llm.queries import QUERIES
from conftest import SF01
from test_llm_near import components_of


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, fuzzy=True):
    """doc_id -> (line numbers removed, text left), from all pairs of lines."""
    places = defaultdict(list)
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            line = lines.normalise(line)
            if i is not None and len(lines._WORD.findall(line)) >= lines.MIN_WORDS:
                places[line].append((i, n))
    names = list(places)
    prints = [int(x) & (2 ** 64 - 1) for x in lines.simhashes([lines._WORD.findall(x) for x in names])] if names else []
    links = [(a, b) for a, b in combinations(range(len(names)), 2) if fuzzy and (prints[a] ^ prints[b]).bit_count() <= 3
             and edits(names[a], names[b]) <= int(0.1 * max(len(names[a]), len(names[b])) + 1e-9)]
    groups = defaultdict(list)
    for n, root in components_of(range(len(names)), links).items():
        groups[root] += places[names[n]]
    gone = {p for ps in groups.values() for p in ps if p != min(ps)}
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        removed = [n for n in range(len(own)) if (i, n) in gone]
        out[i] = (len(own), removed, t if not removed else "\n".join(x for n, x in enumerate(own) if n not in removed))
    return out, links


def near_lines(rng, n):
    base = [" ".join(f"word{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))) for _ in range(n)]
    for line in base:
        for _ in range(rng.randrange(4)):
            w = line.split()
            w[rng.randrange(len(w))] = f"word{rng.randrange(400)}"
            base.append(" ".join(w) if rng.random() < 0.8 else line.upper().replace(" ", "\t "))
            if len(base) > 3 * n:
                return base
    return base


@pytest.mark.parametrize("block", [512, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(buckets.open_members, "__defaults__", (block,))
    rng = random.Random(block)
    pool = near_lines(rng, 60) + ["the same line in very many documents here"] * 30 + ["", "too short to judge", "!!!"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(1, 140)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "a b c d e f g " * 60), (204, "A b c d e f g " * 60 + "h")]
    df = spark.createDataFrame([(i, t, "x", len(t or ""), 0) for i, t in rows],
                               "doc_id long, text string, lines string, n_chars int, removed int")
    want, links = brute(rows)
    assert links
    got = {r.doc_id: (r.n_lines, r.removed, r.text) for r in lines.dedup_lines(df).collect()}
    assert got == want
    more = df.unionByName(df.where("doc_id = 3")).unionByName(
        spark.createDataFrame([(None, "the same line in very many documents here", "x", 1, 0)], df.schema))
    clean = lines.clean_documents(more)
    assert clean.columns == df.columns
    kept = {i: x for i, x in want.items() if len(x[1]) < x[0]}
    rows = clean.collect()
    assert {r.doc_id: r.text for r in rows if r.doc_id} == {i: x[2] for i, x in kept.items()}
    assert all(r.n_chars == len(r.text or "") for r in rows if r.doc_id)
    assert sum(r.doc_id == 3 for r in rows) == 2 * (3 in kept) and sum(r.doc_id is None for r in rows) == 1
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_bounded_edits_and_fingerprints():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randrange(14))) for _ in range(2))
        d = edits(a, b)
        assert [lines.within_edits(a, b, m) for m in range(16)] == [d <= m for m in range(16)]
    import xxhash
    for ws in [["a"], ["longer", "an", "longer"], [f"w{i}" for i in range(50_000)]]:
        sums = [0] * 64
        for w in ws:
            h = xxhash.xxh3_64_intdigest(w)
            for i in range(64):
                sums[i] += (1 if len(w) < 4 else 3) * (1 if h >> i & 1 else -1)
        want = sum(1 << i for i in range(64) if sums[i] > 0)
        assert int(lines.simhashes([["x"], ws, ["y", "zzzz"]])[1]) & (2 ** 64 - 1) == want


def test_all_pairs_of_blocks_cover_the_radius(spark):
    """Fingerprints within three bits share a key, whichever bits differ."""
    from pyspark.sql import functions as F
    rng = random.Random(1)
    values = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        values.append((x - (1 << 63), y - (1 << 63)))
    df = spark.createDataFrame(values, "x long, y long")
    flipped = F.lit(-(1 << 63))
    keys = [lines.block_keys(F.col(c).bitwiseXOR(flipped)) for c in ("x", "y")]
    assert df.where(~F.arrays_overlap(*keys)).count() == 0


def test_query_equals_brute_force_on_equal_lines(spark):
    """On sf0.01: every exact repetition is found, and no line goes that no earlier one resembles."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    want, _ = brute(rows, fuzzy=False)
    got = {r.doc_id: (r.n_lines, r.removed, r.text) for r in QUERIES["op9_line_dedup"](spark, SF01).collect()}
    assert got.keys() == want.keys()
    more = sum(len(set(got[i][1]) - set(want[i][1])) for i in got)
    assert all(set(want[i][1]) <= set(got[i][1]) for i in got) and more <= 0.1 * sum(x[0] for x in want.values())


def test_query_removes_exact_copies_of_short_lines(spark):
    """On sf0.01: of equal lines that aren't blank, however short, one stays."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_line_dedup"](spark, SF01).collect()}
    seen, left = defaultdict(int), defaultdict(int)
    for i, text in rows.items():
        for n, line in enumerate((text or "").split("\n")):
            line = lines.normalise(line)
            if 0 < len(lines._WORD.findall(line)) < lines.MIN_WORDS:
                seen[line] += 1
                left[line] += n not in got[i].removed
    assert max(seen.values()) > 1 and set(left.values()) == {1}


def test_short_copies_rows(spark):
    long_line = "这是一行没有空格的很长的文字" * 5
    rows = [(1, f"yes\n\n!!!\n{long_line}"), (2, f"Yes \nno\n\n!!!\n{long_line}"), (None, "yes"), (3, None), (4, "yes")]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.removed, r.text) for r in lines.dedup_lines(df, short_copies=True).collect()}
    assert got == {1: ([], rows[0][1]), 2: ([0, 3, 4], "no\n"), None: ([], "yes"), 3: ([], None), 4: ([0], "")}
    assert {r.doc_id for r in lines.clean_documents(df, short_copies=True).collect()} == {1, 2, None, 3}


def _apart(n):
    """Three fingerprints that share two blocks and a fourth, each pair more than the radius apart, and ``n`` copies of one more."""
    prints = [0, sum(1 << b for b in (27, 29, 30, 31)), sum(1 << b for b in (33, 34, 35, 37))]
    return prints + [(1 << 20) + (1 << 40) + (1 << 50) + x for x in (1, 3, 7)[:n]]


@pytest.mark.parametrize("similar", [0, 3])
def test_unrelated_lines_of_a_bucket_go_no_further(spark, similar):
    classes = spark.createDataFrame(list(enumerate(_apart(similar))), "node long, simhash long")
    pairs, members = lines._candidates(classes)
    assert not {x for r in pairs.collect() for x in (r.a, r.b)} & {0, 1, 2}
    assert {r.node for r in members.collect()} == set(range(3, 3 + similar))


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
@pytest.mark.parametrize("in_task", [4096, 4])
def test_lines_with_another_of_their_bucket_stay(monkeypatch, size, in_task):
    import pyarrow as pa
    monkeypatch.setattr(lines, "IN_TASK", in_task)
    rng, rows = random.Random(3), []
    for key in range(200):
        own = [rng.getrandbits(63) for _ in range(rng.choice([2, 3, 3, 4, 4, 7, 40]))]
        own = [own[0] ^ (1 << rng.randrange(60)) if rng.random() < 0.2 else x for x in own]
        rows += [(key, 1000 * key + i, x, len(own), own) for i, x in enumerate(own)]
    rows.append((999, 999_000, 5, 3, [5]))       # a bucket that is not whole stays
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[p:p + size]], pa.int64()) for c in range(4)],
                                          names=["key", "node", "simhash", "n"]) for p in range(0, len(rows), size)]
    got = [x for b in lines._without_alone(iter(batches)) for x in b.column("node").to_pylist()]
    assert got == [node for _, node, x, n, own in rows if not 2 < n <= in_task or len(own) != n
                   or sum((x ^ y).bit_count() <= 3 for y in own) > 1]
