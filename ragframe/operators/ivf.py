"""A stored inverted-file index of vectors: built once, searched many times.

    path/centroids   cell, center                 (cells x dim numbers, a parameter)
    path/rows        id, key, vec, fields / cell=c (one folder per cell, sorted by key)
    path/rejected    rows without key or with a bad vector, and why
    path/about       dim, key column, calibrated number of probes, its recall

A search finds the cells nearest to each question, reads only the folders of cells
that some question probes (a partition filter) and ranks exactly inside them. The
centroids are fitted by k-means on a bounded sample of the rows or given by the
caller. Calibration asks a bounded sample of the indexed rows: the exact nearest
``k`` of each lie in some cells, and the least number of probes that reaches the
wanted share of them is stored with the index."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.functions.vectors import is_vector
from ragframe.operators.search import _candidates, _fetch, _rank, rejected_vectors, topk
from ragframe.operators.sizing import DEFAULT_BROADCAST_MAX_BYTES
from ragframe.session import scratch_path

TRAIN_ROWS = 100_000     # rows the centroids are fitted on at most
ASK_ROWS = 200           # rows asked for the calibration at most
TARGET_RECALL = 0.95     # share of the sample's exact neighbours the probes have to reach


@dataclass
class IvfIndex:
    """An opened index: its centroids and what was stored about it."""
    path: str
    centers: np.ndarray
    key: str
    dim: int
    nprobe: int
    recall: float | None
    schema: T.StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        # given, not inferred: a table without rows has no file to infer it from
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def rejected(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rejected")


def nearest_centers(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centres of each row, nearest first, ties to the
    smaller number. Rows whose order the dot-product form cannot tell are ordered
    by the exact left-to-right sum, as ``l2_squared`` gives it."""
    approx = (x * x).sum(1)[:, None] - 2.0 * x @ centers.T + (centers * centers).sum(1)[None, :]
    order = np.argsort(approx, axis=1, kind="stable")
    ranked = np.take_along_axis(approx, order, axis=1)
    far = np.abs(approx).max(axis=1, initial=0.0) + (x * x).sum(1)
    close = np.flatnonzero((np.diff(ranked, axis=1)[:, :n] <= 1e-9 * (1.0 + far)[:, None]).any(axis=1))
    for i in close:
        diff = centers - x[i]
        order[i] = np.lexsort((np.arange(len(centers)), np.add.accumulate(diff * diff, axis=1)[:, -1]))
    return order[:, :n]


def _probe(spark: SparkSession, centers: np.ndarray, n: int):
    """Arrow-batched: vector -> its ``n`` nearest cells."""
    shared = spark.sparkContext.broadcast(centers)      # cells x dim, a parameter

    @F.pandas_udf("array<int>")
    def probe(vs: pd.Series) -> pd.Series:
        if not len(vs):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in vs])
        return pd.Series(list(nearest_centers(x, shared.value, n).astype(np.int32)))

    return probe


def fit_centers(rows: DataFrame, n_cells: int, *, seed: int = 7, max_iter: int = 10, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """k-means centres of at most about ``train_rows`` of the rows (id, vec), chosen by a hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n) + 1)
    train = rows.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(train).clusterCenters(), dtype=np.float64)


def build_index(corpus: DataFrame, path: str, n_cells: int | None = None, *, centers: list[list[float]] | None = None,
                key: str = "file_id", id_col: str = "id", vec_col: str = "embedding", fields: list[str] | None = None,
                dim: int | None = None, k: int = 10, target_recall: float = TARGET_RECALL, train_rows: int = TRAIN_ROWS,
                ask_rows: int = ASK_ROWS, seed: int = 7) -> IvfIndex:
    """Writes the index of ``corpus`` to a new folder ``path`` and opens it.

    Vectors of another length than ``dim`` (by default the most frequent one), with
    null or NaN components, and rows without key go to ``rejected`` with a reason.
    Give ``n_cells`` for fitted or ``centers`` for given centroids. A corpus without
    good rows gives an index without cells, which finds nothing."""
    spark = corpus.sparkSession
    if dim is None:
        common = corpus.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = common["d"] if common else 0
    rejected_vectors(corpus, dim, vec_col=vec_col, key=key).write.parquet(f"{path}/rejected")
    good = (corpus.where(F.col(key).isNotNull() & F.col(id_col).isNotNull() & is_vector(F.col(vec_col), dim))
            .select(F.col(id_col).alias("id"), key, F.col(vec_col).alias("vec"), *[c for c in fields or [] if c not in ("id", key)]))
    if centers is not None:
        cm = np.array(centers, dtype=np.float64)
    elif good.isEmpty():
        cm = np.zeros((0, dim))
    else:
        cm = fit_centers(good.select("id", "vec"), n_cells, seed=seed, train_rows=train_rows)
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(cm)], "cell int, center array<double>") \
        .coalesce(1).write.parquet(f"{path}/centroids")
    if len(cm):
        good = good.withColumn("cell", F.get(_probe(spark, cm, 1)(F.col("vec")), 0))
    else:
        good = good.withColumn("cell", F.lit(0))
    # large cells are split over tasks, small ones share one
    good.hint("rebalance", "cell").sortWithinPartitions("cell", key).write.partitionBy("cell").parquet(f"{path}/rows")
    written = spark.read.schema(good.schema).parquet(f"{path}/rows")
    nprobe, recall = calibrate(written, cm, key, k, target_recall, ask_rows) if len(cm) else (1, None)
    spark.createDataFrame([(dim, key, nprobe, recall, good.schema.json())],
                          "dim int, key string, nprobe int, recall double, row_schema string") \
        .coalesce(1).write.parquet(f"{path}/about")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> IvfIndex:
    about = spark.read.parquet(f"{path}/about").first()
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()      # n_cells of them
    return IvfIndex(path, np.array([r["center"] for r in rows], dtype=np.float64).reshape(len(rows), about["dim"]),
                    about["key"], about["dim"], about["nprobe"], about["recall"], T.StructType.fromJson(json.loads(about["row_schema"])))


def calibrate(rows: DataFrame, centers: np.ndarray, key: str, k: int, target: float, ask_rows: int) -> tuple[int, float | None]:
    """(probes, recall): the least number of probes whose cells hold ``target`` of the exact nearest
    ``k`` of about ``ask_rows`` rows, chosen by a hash of the id. One exact search of the sample."""
    spark = rows.sparkSession
    n = rows.count()
    share = int(1_000_000 * ask_rows / max(n, 1)) + 1
    asked = rows.where(F.pmod(F.xxhash64("id", F.lit("ask")), F.lit(1_000_000)) < share).select(
        F.col("id").alias("qid"), key, F.col("vec").alias("embedding"))
    exact = topk(rows, asked, k, key=key, vec_col="vec", output_fields=["cell"])
    cells = asked.select("qid", _probe(spark, centers, len(centers))(F.col("embedding")).alias("cells"))
    ranks = (exact.join(cells, "qid").groupBy(F.array_position("cells", F.col("cell")).alias("probes")).count()
             .orderBy("probes").collect())                                       # at most one row per cell
    total, found = sum(r["count"] for r in ranks), 0
    for r in ranks:
        found += r["count"]
        if found >= target * total:
            return int(r["probes"]), found / total
    return len(centers), None


def search_index(spark: SparkSession, index: IvfIndex, questions: DataFrame, k: int = 10, *, nprobe: int | None = None,
                 qid_col: str = "qid", qvec_col: str = "embedding", output_fields: list[str] | None = None,
                 broadcast_max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES, **sizes) -> DataFrame:
    """``qid, rank, id, distance`` (and ``output_fields``): the nearest ``k`` rows of each
    question's key among its ``nprobe`` nearest cells (by default the calibrated number).
    Questions without key, or whose vector is not of the index's length, find nothing."""
    key = index.key
    q = questions.select(F.col(qid_col).alias("qid"), key, F.col(qvec_col).alias("qvec"))
    q = q.where(F.col("qid").isNotNull() & F.col(key).isNotNull() & is_vector(F.col("qvec"), index.dim))
    rows = index.rows(spark)
    if len(index.centers):
        probe = _probe(spark, index.centers, max(1, min(nprobe or index.nprobe, len(index.centers))))
        q = q.withColumn("cell", F.explode(probe(F.col("qvec"))))
    else:
        q = q.withColumn("cell", F.lit(0)).limit(0)
    path = scratch_path(spark, "probes")
    q.write.parquet(path)
    q = spark.read.schema(q.schema).parquet(path)
    cells = sorted(r[0] for r in q.select("cell").distinct().collect())          # at most the number of cells
    inside = F.concat_ws("|", F.col("cell").cast("string"), F.col(key).cast("string")).alias("_ck")
    c = rows.where(F.col("cell").isin(cells)).select("id", inside, "vec")
    scored, n_q = _candidates(c, q.select("qid", inside, "qvec"), "_ck", k, "auto", sizes.pop("salt", 1), broadcast_max_bytes, **sizes)
    ranked = _rank(scored, k, 0)
    if not output_fields:
        return ranked.drop("_ck")
    wide = rows.where(F.col("cell").isin(cells)).select("id", inside, *[f for f in output_fields if f != "id"])
    return _fetch(ranked, wide, ["id", "_ck"], n_q * k, broadcast_max_bytes).select(
        "qid", "rank", "id", "distance", *[f for f in output_fields if f != "id"])
