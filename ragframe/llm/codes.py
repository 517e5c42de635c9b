"""Vector code compression: exact integer product codes over anchors-hierarchy ball trees.

Every kept vector becomes integers, floor(4096 x), cut into ``PARTS`` consecutive
parts; each part position has a codebook that a fixed number of rounds refines
(assign every part to its nearest entry, replace each entry by the floored mean of
its parts). All arithmetic that decides anything is exact.

The vectors are dealt, where they are, into blocks of bounded size. For each block
and part position a metric tree is built once, middle-out: about sqrt(n) anchors,
each new one the farthest point of the widest anchor, take over the points nearer
to them (the triangle inequality says which need a look); anchors are merged
pairwise into larger balls up to the root and split further below. A ball caches
centre, radius, sum and count. A round walks down from the roots with a list of
entries that may own points of the ball; a child inherits its parent's list, an
entry that is strictly farther than another one for every point of the ball leaves
it, and a ball with one entry left is wholly owned: its cached sum and count are
credited, no point is looked at. Only points of undecided leaves are compared.

The trees are a written table, so every round is one pass over it without a shuffle
of vectors: a task gives back one row per codebook component. The driver holds the
codebooks alone (16 x dimension integers).
"""

from __future__ import annotations

import hashlib
import pickle
from decimal import Decimal
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import written
from ragframe.operators.partitioning import spread
from ragframe.session import scratch_path

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK = 2048        # vectors of one block of trees
LEAF = 48           # points of a ball that is not split further
LIMB = 10 ** 18     # sums travel as two decimals, high and low
LONG_MAX = 2 ** 63 - 1
FLOAT_MAX = float(np.finfo(np.float32).max)
LABELS = 200_000    # label sums up to which they are broadcast (32 bytes each)


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]


def to_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 x) of each component; Python integers where 64-bit ones could not hold the products."""
    scaled = np.floor(vectors * float(SCALE))
    if not scaled.size or np.abs(scaled).max() < 2 ** 20:
        return scaled.astype(np.int64)
    whole = lambda x: int(x) * SCALE if abs(x) >= 2.0 ** 52 else floor(x * SCALE)
    return np.array([[whole(float(x)) for x in v] for v in vectors], dtype=object).reshape(vectors.shape)


class Tree:
    """The balls over the rows of ``points`` (integers), root first; ``order``
    lists the rows so that those of ball i are ``order[start[i]:end[i]]``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self._x = points.astype(float)
        self._slack = 1e-9 * (1.0 + (np.abs(self._x).max() if points.size else 0.0))
        root = self._grow(np.arange(len(points)))
        rows, self.start, self.end, self.child = [], [], [], []
        # laid out in depth-first order, so that a ball's points are neighbours
        stack, at = [(root, -1)], 0
        balls = []
        while stack:
            ball, parent = stack.pop()
            i = len(balls)
            balls.append(ball)
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(i)
            self.start.append(at)
            if ball[2] is None:
                rows.append(ball[3])
                at += len(ball[3])
            else:
                stack += [(ball[2][1], i), (ball[2][0], i)]
            self.end.append(self.start[-1] + ball[4])
        self.order = np.concatenate(rows)
        self.start, self.end = np.array(self.start), np.array(self.end)
        self.child = np.array([c or [-1, -1] for c in self.child])
        self.center = np.array([b[0] for b in balls])
        self.radius = np.array([b[1] for b in balls])
        sums = np.concatenate([np.zeros((1, points.shape[1]), dtype=points.dtype), np.cumsum(points[self.order], axis=0)])
        self.sums = sums[self.end] - sums[self.start]
        self.points = points[self.order]
        del self._x

    def _leaf(self, rows: np.ndarray) -> tuple:
        x = self._x[rows]
        center = x.mean(axis=0)
        radius = float(np.sqrt(((x - center) ** 2).sum(axis=1)).max()) if len(rows) else 0.0
        return center, radius * (1 + 1e-9) + self._slack, None, rows, len(rows)

    def _grow(self, rows: np.ndarray) -> tuple:
        """The ball of ``rows``: (centre, radius, two children or None, its rows if a leaf, count)."""
        if len(rows) <= LEAF:
            return self._leaf(rows)
        owner, pivots = self._anchors(self._x[rows])
        if pivots < 2:       # equal points
            return self._leaf(rows)
        by = np.argsort(owner, kind="stable")
        bounds = np.cumsum(np.bincount(owner, minlength=pivots))[:-1]
        return self._merged([self._grow(r) for r in np.split(rows[by], bounds) if len(r)])

    @staticmethod
    def _anchors(x: np.ndarray) -> tuple[np.ndarray, int]:
        """Anchor of each point, and how many anchors there are."""
        far = lambda a: np.sqrt(((a) ** 2).sum(axis=1))
        pivots = [0]
        owner, dist = np.zeros(len(x), dtype=np.int64), far(x - x[0])
        for k in range(1, isqrt(len(x)) + 1):
            new = int(dist.argmax())      # the farthest point of the widest anchor
            if dist[new] == 0:
                break
            between = far(x[pivots] - x[new])
            # a point nearer to its anchor than half way to the new one stays
            look = np.flatnonzero(dist > 0.5 * between[owner])
            d = far(x[look] - x[new])
            won = d < dist[look]
            owner[look[won]], dist[look[won]] = k, d[won]
            owner[new], dist[new] = k, 0.0
            pivots.append(new)
        return owner, len(pivots)

    def _merged(self, balls: list[tuple]) -> tuple:
        """One ball over all: the two whose common ball is smallest are merged, again and again."""
        center = np.array([b[0] for b in balls])
        radius = np.array([b[1] for b in balls])
        apart = np.sqrt(((center[:, None] - center[None, :]) ** 2).sum(axis=2))
        common = np.maximum(apart + radius[:, None] + radius[None, :], 2 * np.maximum(radius[:, None], radius[None, :]))
        np.fill_diagonal(common, np.inf)
        for _ in range(len(balls) - 1):
            i, j = divmod(int(common.argmin()), len(balls))
            a, b = balls[i], balls[j]
            n = a[4] + b[4]
            c = (a[0] * a[4] + b[0] * b[4]) / n
            r = max(float(np.sqrt(((c - s[0]) ** 2).sum())) + s[1] for s in (a, b)) * (1 + 1e-9) + self._slack
            balls[i] = (c, r, (a, b), None, n)
            center[i], radius[i] = c, r
            d = np.sqrt(((center - c) ** 2).sum(axis=1))
            row = np.maximum(d + radius + r, 2 * np.maximum(radius, r))
            gone = np.isinf(common[j])
            gone[j] = True
            row[gone | np.isinf(common[i]) & (np.arange(len(balls)) != i)] = np.inf
            row[i] = np.inf
            common[i], common[:, i] = row, row
            common[j], common[:, j] = np.inf, np.inf
            last = i
        return balls[last]

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry of each point in tree order, sums per entry, counts per entry, points compared)."""
        n, k = len(self.points), len(entries)
        codes = np.zeros(n, dtype=np.int64)
        sums = np.zeros((k, self.points.shape[1]), dtype=self.points.dtype if entries.dtype != object else object)
        counts = np.zeros(k, dtype=np.int64)
        e = entries.astype(float)
        gaps = np.sqrt(((e[:, None] - e[None, :]) ** 2).sum(axis=2))
        margin = 1e-9 * (1.0 + max(np.abs(e).max(initial=0.0), np.abs(self.center).max(initial=0.0),
                                   self.radius.max(initial=0.0)) ** 2 * max(1, e.shape[1]))
        balls, listed = np.array([0]), np.ones((1, k), dtype=bool)
        open_rows, open_listed = [], []
        while len(balls):
            d = np.where(listed, ((self.center[balls][:, None] - e[None, :]) ** 2).sum(axis=2), np.inf)
            best = d.argmin(axis=1)
            least = d[np.arange(len(balls)), best]
            # for all points of the ball the entry is strictly farther than the best one
            farther = least[:, None] - d + 2 * self.radius[balls][:, None] * gaps[best] < -margin
            listed = listed & ~farther
            owned = listed.sum(axis=1) == 1
            for b, entry in zip(balls[owned], best[owned], strict=True):
                codes[self.start[b]:self.end[b]] = entry
                sums[entry] += self.sums[b]
                counts[entry] += self.end[b] - self.start[b]
            leaf = self.child[balls, 0] < 0
            undecided = ~owned & leaf
            for b, may in zip(balls[undecided], listed[undecided], strict=True):
                open_rows.append(np.arange(self.start[b], self.end[b]))
                open_listed.append(np.broadcast_to(may, (self.end[b] - self.start[b], k)))
            down = ~owned & ~leaf
            balls, listed = self.child[balls[down]].ravel(), np.repeat(listed[down], 2, axis=0)
        compared = 0
        if open_rows:
            rows, may = np.concatenate(open_rows), np.concatenate(open_listed)
            compared = len(rows)
            x = self.points[rows]
            codes[rows] = near = nearest(x, entries, may)
            order = np.argsort(near, kind="stable")
            hit, first = np.unique(near[order], return_index=True)
            sums[hit] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(near, minlength=k)
        return codes, sums, counts, compared


def nearest(x: np.ndarray, entries: np.ndarray, may: np.ndarray | None = None) -> np.ndarray:
    """Exactly nearest entry of each row, ties to the lower index."""
    top = max((int(np.abs(a).max()) for a in (x, entries) if a.size), default=0)
    if 4 * top * top * max(1, x.shape[1]) < 2 ** 52:    # floats hold all of it exactly
        a, b = x.astype(float), entries.astype(float)
        far = (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        return (far if may is None else np.where(may, far, np.inf)).argmin(axis=1)
    a, b = x.astype(object), entries.astype(object)
    return np.array([min(range(len(b)), key=lambda i: (sum((v - b[i]) ** 2), i)) for v in a], dtype=np.int64)


def distances(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its entry, as Python integers if need be."""
    top = max((int(np.abs(a).max()) for a in (x, chosen) if a.size), default=0)
    if 4 * top * top * max(1, x.shape[1]) >= 2 ** 62:
        x, chosen = x.astype(object), chosen.astype(object)
    return ((x - chosen) ** 2).sum(axis=1)


def _blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id and label of each vector, the pickled trees of all parts) of every block."""
    schema = pa.schema([("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.string())), ("trees", pa.binary())])

    def run(batches):
        ids, labels, rows = [], [], []

        def block():
            whole = to_integers(np.array(rows, dtype=float).reshape(len(rows), dim))
            small = whole if whole.dtype == object else whole.astype(np.int32)
            trees = []
            for a, b in cuts(dim):
                tree = Tree(whole[:, a:b])
                tree.points = tree.points.astype(small.dtype)
                trees.append(vars(tree))
            return pa.RecordBatch.from_arrays([pa.array([ids], schema.field(0).type), pa.array([labels], schema.field(1).type),
                                               pa.array([pickle.dumps(trees, protocol=5)], pa.binary())], schema=schema)

        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                ids += part.column("vec_id").to_pylist()
                labels += part.column("label").to_pylist()
                rows += part.column("vector").to_pylist()
                while len(rows) >= BLOCK:
                    rest = ids[BLOCK:], labels[BLOCK:], rows[BLOCK:]
                    ids, labels, rows = ids[:BLOCK], labels[:BLOCK], rows[:BLOCK]
                    yield block()
                    ids, labels, rows = rest
        if rows:
            yield block()

    made = spread(vectors).mapInArrow(run, "vec_id array<long>, label array<string>, trees binary")
    path = scratch_path(vectors.sparkSession, "trees")
    # a row is about a megabyte: small row groups keep the reader's batches small
    made.write.option("parquet.block.size", 8 << 20).option("parquet.block.size.row.check.min", 4).parquet(path)
    return vectors.sparkSession.read.schema(made.schema).parquet(path)


def _trees(blob: bytes) -> list[Tree]:
    trees = []
    for fields in pickle.loads(blob):
        tree = Tree.__new__(Tree)
        vars(tree).update(fields)
        if tree.points.dtype != object:
            tree.points = tree.points.astype(np.int64)
        trees.append(tree)
    return trees


def _as_books(books: list[list[list[int]]]) -> list[np.ndarray]:
    """Entries as arrays; Python integers where products could pass 64 bits."""
    big = any(abs(x) >= 2 ** 20 for book in books for entry in book for x in entry)
    return [np.array(book, dtype=object if big else np.int64).reshape(len(book), -1) for book in books]


def refine(blocks: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round over all blocks."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("n", pa.int64()),
                        ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])
    shared = blocks.sparkSession.sparkContext.broadcast(books)      # ENTRIES x dimension integers

    def run(batches):
        entries = _as_books(shared.value)
        sums = [np.zeros(e.shape, dtype=object) for e in entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in entries]
        for batch in batches:
            for blob in batch.column("trees"):
                for p, tree in enumerate(_trees(blob.as_py())):
                    _, s, c, _ = tree.assign(entries[p])
                    sums[p] += s.astype(object)
                    counts[p] += c
        rows = [(p, i, at, int(counts[p][i]), Decimal(int(x) // LIMB), Decimal(int(x) % LIMB))
                for p in range(len(entries)) for i in np.flatnonzero(counts[p]) for at, x in enumerate(sums[p][i])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    found = (blocks.select("trees").mapInArrow(run, "part int, entry int, at int, n long, high decimal(38,0), low decimal(38,0)")
             .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")))
    new = [[list(entry) for entry in book] for book in books]
    for r in found.collect():        # one row per codebook component
        new[r["part"]][r["entry"]][r["at"]] = (int(r["high"]) * LIMB + int(r["low"])) // r["n"]
    shared.unpersist()
    return new


def _coded(blocks: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        entries = _as_books(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("vec_id")[i].as_py(), batch.column("label")[i].as_py()
                codes, error = np.zeros((len(ids), len(entries)), dtype=np.uint8), np.zeros(len(ids), dtype=object)
                for p, tree in enumerate(_trees(batch.column("trees")[i].as_py())):
                    own = tree.assign(entries[p])[0]
                    codes[tree.order, p] = own
                    error[tree.order] += distances(tree.points, entries[p][own]).astype(object)
                texts = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(texts),
                                                  pa.array([int(e) if e <= LONG_MAX else None for e in error], pa.int64())], schema=schema)

    return blocks.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """((vec_id, label as text, code, error), codebooks by part, entry and position).

    Vectors that are null, empty or hold a null or a non-finite component (or one
    beyond the range of a 32-bit float) are dropped, as are those whose length is not the most frequent one (of equally
    frequent ones, the longest). The codebooks start from the smallest ids; of
    an id's several vectors the least is taken, and a null id starts none. With
    fewer than 16 ids there are as many entries. Repeated rows are coded each.
    Part p of d components is d p / 8 to d (p + 1) / 8, rounded down. An error
    beyond 64 bits is null. An empty table gives no rows and no codebooks."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("vector"))
    good = v.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= FLOAT_MAX)))
    length = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), []
    dim = length["d"]
    good = good.where(F.size("vector") == dim)
    first = good.where("vec_id is not null").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(ENTRIES)
    seeds = to_integers(np.array([r["vector"] for r in first.collect()], dtype=float).reshape(-1, dim))
    if not len(seeds):      # ids all null: the least vectors start the codebooks
        seeds = to_integers(np.array([r[0] for r in good.select("vector").distinct().orderBy("vector").limit(ENTRIES).collect()],
                                     dtype=float).reshape(-1, dim))
    books = [[[int(x) for x in s[a:b]] for s in seeds] for a, b in cuts(dim)]
    blocks = _blocks(good, dim)
    for _ in range(rounds):
        books = refine(blocks, books)
    return _coded(blocks, books), books


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal text joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256
    (``compress`` says what is kept). Equal labels share their sum of errors, null
    labels too; a sum beyond 64 bits, or of an error beyond, is null."""
    coded, books = compress(vectors, id_col, vector_col, label_col)
    coded = written(coded, "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(
        F.when((F.count("error") == F.count("*")) & (total <= LONG_MAX), total).cast("long").alias("label_error"))
    sums = written(sums, "label-errors")
    if sums.limit(LABELS + 1).count() <= LABELS:
        sums = F.broadcast(sums)
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
