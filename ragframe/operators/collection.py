"""Typed collections on Parquet: create-if-missing, append, stable ids,
replace-by-file, column lists <-> rows, dynamic extra fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.operators.sizing import fits_broadcast

COLLECTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("file_id", T.StringType(), False),
    T.StructField("chunk_no", T.LongType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType(), True), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("num_tokens", T.LongType(), True),
    T.StructField("page_number", T.LongType(), True),
    T.StructField("extras", T.MapType(T.StringType(), T.StringType()), True),
])


def stable_id(file_id, chunk_no):
    """K3: deterministic 64-bit id (same on retry and replay)."""
    return F.xxhash64(file_id, chunk_no)


def to_collection_rows(df: DataFrame) -> DataFrame:
    """Fill the canonical schema from whatever subset of it ``df`` has."""
    cols = []
    for f in COLLECTION_SCHEMA.fields:
        if f.name == "id" and "id" not in df.columns:
            cols.append(stable_id(F.col("file_id"), F.col("chunk_no")).alias("id"))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


REJECTED_COLS = ["file_id", "chunk_no", "description", "embedding", "content", "num_tokens", "page_number"]
PARTITION_COLS = ["ingest_batch", "file_bucket"]
STORED_SCHEMA = T.StructType(COLLECTION_SCHEMA.fields + [
    T.StructField("ingest_batch", T.LongType()), T.StructField("file_bucket", T.IntegerType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


DEFAULT_BUCKETS = 64


def create_if_missing(spark: SparkSession, path: str, n_buckets: int = DEFAULT_BUCKETS) -> None:
    """K1: an empty collection with the declared schema (idempotent). Its
    number of buckets is stored beside the data, in a folder readers skip."""
    if not path_exists(spark, path):
        spark.createDataFrame([], STORED_SCHEMA).write.mode("ignore") \
            .partitionBy(*PARTITION_COLS).parquet(path)
    if not path_exists(spark, f"{path}/_layout"):
        spark.createDataFrame([(n_buckets,)], "n_buckets int").coalesce(1).write.mode("ignore").parquet(f"{path}/_layout")


def stored_buckets(spark: SparkSession, path: str, n_buckets: int | None = None) -> int:
    """The collection's number of buckets; one that is given has to agree."""
    if not path_exists(spark, f"{path}/_layout"):
        if path_exists(spark, path):
            raise ValueError(f"{path} has no stored layout: it was not made by create_if_missing or append")
        return n_buckets or DEFAULT_BUCKETS
    stored = spark.read.parquet(f"{path}/_layout").first()["n_buckets"]
    if n_buckets not in (None, stored):
        raise ValueError(f"{path} has {stored} buckets, not {n_buckets}")
    return stored


def file_bucket(file_id, n_buckets: int):
    return F.pmod(F.xxhash64(file_id), F.lit(n_buckets)).cast("int")


def new_batch_id() -> int:
    import uuid
    return uuid.uuid4().int >> 65          # positive 63-bit


def _write_partitions(rows: DataFrame, path: str, replace: bool = True) -> None:
    """Dynamic partition overwrite: only the (ingest_batch, file_bucket)
    partitions present in ``rows`` are replaced (``replace=False``: plain
    append, for a batch id that cannot exist yet). REBALANCE lets AQE
    coalesce small and split skewed write partitions (few right-sized files)."""
    w = rows.hint("rebalance", *PARTITION_COLS).write
    if replace:
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode("append")
    w.partitionBy(*PARTITION_COLS).parquet(path)


def append(df: DataFrame, path: str, *, batch_id: int | None = None, replace_files: bool = False,
           n_buckets: int | None = None) -> int:
    """K2: append a batch; returns its ``ingest_batch`` id. ``n_buckets`` is
    that of the collection; it is only a choice where there is none yet.

    Storage is partitioned by (ingest_batch, file_bucket = xxhash64(file_id) %
    n_buckets): bounded folders per batch, never one per file. Writing a batch
    replaces all of that batch, also buckets the new rows no longer reach, so
    replaying a ``batch_id`` (e.g. a stream epoch) never duplicates rows; a new id is an
    append. A batch that ``compact`` has closed is stored for good: writing it again
    changes nothing. ``replace_files=True`` also removes earlier rows of the incoming
    files (re-ingest replaces): no row is rewritten, (file, batch) tombstones are
    written that reads leave out and ``compact`` applies."""
    spark = df.sparkSession
    n_buckets = stored_buckets(spark, path, n_buckets)
    create_if_missing(spark, path, n_buckets)
    bid = new_batch_id() if batch_id is None else int(batch_id)
    if batch_id is not None and bid in _closed_batches(spark, path):
        return bid
    rows = (to_collection_rows(df).withColumn("ingest_batch", F.lit(bid).cast("long"))
            .withColumn("file_bucket", file_bucket(F.col("file_id"), n_buckets)))
    if batch_id is None:
        # a generated id is new: nothing to replace; a given id may be a replay
        _write_partitions(rows, path, replace=False)
    else:
        # the buckets written are observed while writing (at most n_buckets values)
        seen = Observation("written")
        _write_partitions(rows.observe(seen, F.collect_set("file_bucket").alias("buckets")), path)
        # a plan without rows is optimised away with its metrics
        written = set() if rows.isEmpty() else set(seen.get["buckets"])
        _drop_other_buckets(spark, path, bid, written)
    if replace_files:
        _bury_earlier(spark, path, bid)
    return bid


TOMBSTONES = "file_id string, dead_batch long, file_bucket int"


def _bury_earlier(spark: SparkSession, path: str, bid: int) -> None:
    """Tombstones for the rows that other batches hold of the files of batch ``bid``. They are written once:
    a replay of the batch must not bury what came after it. Reads file ids of the batch's buckets only."""
    folder = f"{path}/_tombstones/by_batch={bid}"
    if path_exists(spark, f"{folder}/_SUCCESS"):
        return
    alive = load_collection(spark, path)
    files = alive.where(F.col("ingest_batch") == bid).select("file_bucket", "file_id").distinct()
    buckets = [r[0] for r in files.select("file_bucket").distinct().collect()]       # at most n_buckets
    dead = (alive.where((F.col("ingest_batch") != bid) & F.col("file_bucket").isin(buckets))
            .select("file_id", F.col("ingest_batch").alias("dead_batch"), "file_bucket").distinct()
            .join(files, ["file_bucket", "file_id"], "left_semi"))
    dead.select("file_id", "dead_batch", "file_bucket").write.mode("overwrite").parquet(folder)


def append_conformed(df: DataFrame, path: str, dim: int, *, batch_id: int | None = None, rejected: DataFrame | None = None,
                     **kw) -> int:
    """F8 then K2: conforming rows are appended, the others go with their
    ``status`` to the collection's quarantine, which a replay of the batch
    replaces like the rows themselves. Nothing is lost. The rows are staged in
    the shared checkpoint folder, so that what they cost (an embedder's calls)
    is paid once and they may come from the collection itself. ``rejected`` has rows
    that failed before, with their ``status``: they join the quarantine."""
    from ragframe.operators.validation import with_collection_status
    from ragframe.session import scratch_path
    staging = scratch_path(df.sparkSession, "conformed")
    judged = with_collection_status(df, dim)
    if rejected is not None:
        judged = judged.unionByName(rejected, allowMissingColumns=True)
    judged.write.parquet(staging)
    staged = df.sparkSession.read.parquet(staging)
    ok, bad = staged.where("status = 'ok'"), staged.where("status <> 'ok'")
    replay = batch_id is not None
    bid = append(ok.drop("status"), path, batch_id=batch_id, **kw)
    rows = bad.select(*[F.col(c).cast(COLLECTION_SCHEMA[c].dataType).alias(c) for c in REJECTED_COLS if c in bad.columns], "status")
    rows = rows.withColumn("ingest_batch", F.lit(bid).cast("long"))
    if replay:
        _drop_folder(df.sparkSession, f"{path}/_rejected/ingest_batch={bid}")
    rows.write.mode("append").partitionBy("ingest_batch").parquet(f"{path}/_rejected")
    return bid


def ingest_embedded_csv(spark: SparkSession, csv_path: str, path: str, dim: int, *, id_col: str = "id", file_col: str = "collection",
                        text_col: str = "chunks", columns: list[str] | None = None, batch_id: int | None = None) -> int:
    """A CSV of embedded chunks (S6) into a collection: file ids sanitised, vectors parsed, rules of F8.
    Records that are malformed go to the quarantine as ``content``, rows whose token count is no number too."""
    from ragframe.functions.text import sanitise_ascii
    from ragframe.functions.vectors import parse_vector
    from ragframe.sources.files import read_embedded_csv_checked
    rows, malformed = read_embedded_csv_checked(spark, csv_path, columns)
    typed = rows.select(sanitise_ascii(F.col(file_col)).alias("file_id"), F.expr(f"try_cast(`{id_col}` AS long)").alias("chunk_no"),
                        F.col(text_col).alias("content"), parse_vector(F.col("embedding")).alias("embedding"),
                        F.expr("try_cast(num_tokens AS long)").alias("num_tokens"),
                        (F.col("num_tokens").isNotNull() & F.expr("try_cast(num_tokens AS long)").isNull()).alias("_bad"))
    bad = (typed.where("_bad").drop("_bad").withColumn("status", F.lit("bad_num_tokens"))
           .unionByName(malformed.select(F.col("record").alias("content"), F.lit("malformed_record").alias("status")), allowMissingColumns=True))
    return append_conformed(typed.where("not _bad").drop("_bad"), path, dim, batch_id=batch_id, rejected=bad)


def load_rejected(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined rows of a collection, with their status."""
    fields = [COLLECTION_SCHEMA[c] for c in REJECTED_COLS]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields]
                          + [T.StructField("status", T.StringType()), T.StructField("ingest_batch", T.LongType())])
    return spark.read.schema(schema).option("basePath", f"{path}/_rejected").parquet(f"{path}/_rejected")


def _drop_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_other_buckets(spark: SparkSession, path: str, batch: int, keep: set[int]) -> None:
    """Removes a batch's bucket folders that are not in ``keep`` (folder names only, no data is read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/ingest_batch={batch}")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(p) if fs.exists(p) else []:
        name = f.getPath().getName()
        if name.startswith("file_bucket=") and int(name.partition("=")[2]) not in keep:
            fs.delete(f.getPath(), True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _batch_folders(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes of each batch's folder (names and sizes only, no data is read)."""
    p, fs = _fs(spark, path)
    out = {}
    for f in fs.listStatus(p) if fs.exists(p) else []:
        name = f.getPath().getName()
        if name.startswith("ingest_batch="):
            out[int(name.partition("=")[2])] = fs.getContentSummary(f.getPath()).getLength()
    return out


def _compactions(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(closed batch, batch it was merged into) of the compactions that took effect."""
    if not path_exists(spark, f"{path}/_compactions"):
        return []
    rows = spark.read.schema("old long, merged long").parquet(f"{path}/_compactions").collect()    # one per closed batch
    there = {m: path_exists(spark, f"{path}/ingest_batch={m}") or any(r["old"] == m for r in rows) for m in {r["merged"] for r in rows}}
    return [(r["old"], r["merged"]) for r in rows if there[r["merged"]]]


def _closed_batches(spark: SparkSession, path: str) -> set[int]:
    return {old for old, _ in _compactions(spark, path)}


def compact(spark: SparkSession, path: str, *, keep: int = 1, small_bytes: int = 1 << 30, newest: int | None = None) -> int | None:
    """Merges the batches below ``small_bytes``, but for the ``keep`` with the greatest ids (a stream's
    newest epochs, which may be replayed; ``newest``: no batch from this id on is touched), into one batch
    of right-sized files per bucket. Tombstones are applied. Returns the merged batch's id, or None if
    fewer than two batches qualify.

    The merged rows are staged, the closed batches are logged, then one rename of a folder makes the merge
    take effect: readers leave logged batches out only when the merged folder is there, so rows are neither
    lost nor doubled whenever a job ends early; what is left over is cleared by the next call. The rename
    has to be atomic, as it is on file systems; object stores need a table format instead."""
    _clear_closed(spark, path)
    folders = _batch_folders(spark, path)
    open_ = sorted(b for b in folders if newest is None or b < newest)
    chosen = [b for b in (open_[:-keep] if keep else open_) if folders[b] < small_bytes]
    if len(chosen) < 2:
        return None
    merged = new_batch_id()
    staging = f"{path}/_staging-{merged}"
    rows = load_collection(spark, path).where(F.col("ingest_batch").isin(chosen)).withColumn("ingest_batch", F.lit(merged).cast("long"))
    rows.hint("rebalance", *PARTITION_COLS).write.partitionBy(*PARTITION_COLS).parquet(staging)
    # also without any row alive there is a folder to rename
    _fs(spark, staging)[1].mkdirs(_fs(spark, f"{staging}/ingest_batch={merged}")[0])
    spark.createDataFrame([(b, merged) for b in chosen], "old long, merged long").coalesce(1) \
        .write.mode("append").parquet(f"{path}/_compactions")
    target, fs = _fs(spark, f"{path}/ingest_batch={merged}")
    if not fs.rename(_fs(spark, f"{staging}/ingest_batch={merged}")[0], target):
        raise OSError(f"cannot rename {staging}")
    _drop_folder(spark, staging)
    _clear_closed(spark, path)
    return merged


def _clear_closed(spark: SparkSession, path: str) -> None:
    """Deletes folders of closed batches, stagings that never took effect, and tombstones of rows that are gone."""
    for old in _closed_batches(spark, path) & set(_batch_folders(spark, path)):
        _drop_folder(spark, f"{path}/ingest_batch={old}")
    p, fs = _fs(spark, path)
    for f in fs.listStatus(p) if fs.exists(p) else []:
        if f.getPath().getName().startswith("_staging-"):
            fs.delete(f.getPath(), True)
    stones, fs = _fs(spark, f"{path}/_tombstones")
    left = set(_batch_folders(spark, path))
    for f in fs.listStatus(stones) if fs.exists(stones) else []:
        folder = f"{path}/_tombstones/{f.getPath().getName()}"
        by = int(f.getPath().getName().partition("=")[2])
        if by in left:
            continue            # an open batch: a replay has to find that it buried already
        dead = spark.read.schema(TOMBSTONES).parquet(folder).select("dead_batch").distinct().collect()
        if not {r[0] for r in dead} & left:
            _drop_folder(spark, folder)


def load_collection(spark: SparkSession, path: str) -> DataFrame:
    """V7: the collection as a DataFrame. A filter on ``file_bucket``
    (``file_bucket(lit(id), n)``) prunes partitions for one file. Rows of replaced
    files and of batches merged into another are left out."""
    rows = spark.read.schema(STORED_SCHEMA).parquet(path)
    closed = _closed_batches(spark, path) & set(_batch_folders(spark, path))
    if closed:
        rows = rows.where(~F.col("ingest_batch").isin(sorted(closed)))
    if not path_exists(spark, f"{path}/_tombstones"):
        return rows
    dead = spark.read.schema(TOMBSTONES).option("recursiveFileLookup", "true").parquet(f"{path}/_tombstones")
    dead = dead.withColumnRenamed("dead_batch", "ingest_batch").distinct()
    if fits_broadcast(dead, 100):
        dead = F.broadcast(dead)
    return rows.join(dead, ["file_id", "ingest_batch", "file_bucket"], "left_anti").select(*[f.name for f in STORED_SCHEMA.fields])


def columns_to_rows(batch: DataFrame, list_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """K4: a columnar batch (parallel arrays) -> one row per element."""
    z = F.explode(F.arrays_zip(*[F.col(c) for c in list_cols])).alias("_z")
    return batch.select(*(keep or []), z).select(*(keep or []), *[F.col(f"_z.{c}").alias(c) for c in list_cols])


def rows_to_columns(df: DataFrame, group_cols: list[str], order_col: str, list_cols: list[str]) -> DataFrame:
    """Inverse of K4 for bounded groups (an insert batch): ordered lists."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in list_cols])))
    out = df.groupBy(*group_cols).agg(s.alias("_s"))
    def field(name):
        return F.transform("_s", lambda x: x[name]).alias(name)

    return out.select(*group_cols, *[field(c) for c in list_cols])


def fold_extras(df: DataFrame, known: list[str], out_col: str = "extras") -> DataFrame:
    """K8: columns outside ``known`` are folded into a string map."""
    extra = [c for c in df.columns if c not in known]
    if not extra:
        return df.withColumn(out_col, F.create_map().cast("map<string,string>"))
    kv = []
    for c in extra:
        kv += [F.lit(c), F.col(c).cast("string")]
    return df.select(*known, F.map_filter(F.create_map(*kv), lambda k, v: v.isNotNull()).alias(out_col))


def search_collection(spark: SparkSession, path: str, questions: DataFrame, k: int = 10, *,
                      n_buckets: int | None = None, output_fields: list[str] | None = None, **topk_kw) -> DataFrame:
    """V3/V5 over a stored collection: questions ``(qid, file_id, embedding)``
    search only their own files. Only the ``file_bucket`` partitions of the
    questions' files are read (partition pruning; the bucket list has at most
    ``n_buckets`` values), then the exact top-k runs per question."""
    from ragframe.operators.search import topk
    n_buckets = stored_buckets(spark, path, n_buckets)
    buckets = sorted(r[0] for r in questions.select(file_bucket(F.col("file_id"), n_buckets))
                     .distinct().collect())
    col = load_collection(spark, path).filter(F.col("file_bucket").isin(buckets))
    return topk(col, questions, k, key="file_id", output_fields=output_fields, **topk_kw)


REGISTRY_SCHEMA = "file_uuid string, filename string, storage_path string"


def append_registry(rows: DataFrame, path: str, n_buckets: int = 16) -> None:
    """K7: append accepted uploads ``(file_uuid, filename, storage_path)``.
    Ids are content hashes, so rows whose ``file_uuid`` is already registered
    are skipped (a re-upload or a replayed batch adds nothing). Partitioned by
    a bounded hash bucket; the anti-join reads only the buckets being written."""
    spark = rows.sparkSession
    new = (rows.select("file_uuid", "filename", "storage_path").dropDuplicates(["file_uuid"])
           .withColumn("uuid_bucket", file_bucket(F.col("file_uuid"), n_buckets)))
    if path_exists(spark, path):
        buckets = sorted(r[0] for r in new.select("uuid_bucket").distinct().collect())  # <= n_buckets
        old = (spark.read.schema(REGISTRY_SCHEMA + ", uuid_bucket int").parquet(path)
               .filter(F.col("uuid_bucket").isin(buckets)).select("file_uuid"))
        new = new.join(old, "file_uuid", "left_anti")
    new.write.mode("append").partitionBy("uuid_bucket").parquet(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA + ", uuid_bucket int").parquet(path).drop("uuid_bucket")
