"""File sources and sinks: CSV (positional and by header), binary file
trees, whole-text files."""

from __future__ import annotations

import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.session import scratch_path

# Outer white space stays; an empty string is a quoted empty field and a null
# this mark, so both come back. A text that is the mark alone would read as null.
NULL_MARK = "\u0001"
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "encoding": "UTF-8", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "nullValue": NULL_MARK}
CSV_WRITE = {**CSV_OPTIONS, "emptyValue": '""'}
CSV_READ = {**CSV_OPTIONS, "emptyValue": ""}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: header + RFC-4180 quoting (quoted newlines, doubled quotes)."""
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


def read_chunk_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header skipped, blank records skipped, all fields as strings;
    callers take fields by position."""
    return spark.read.options(**CSV_READ).csv(path)


def read_embedded_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns by header name; ``embedding`` stays text until parsed."""
    return spark.read.options(**CSV_READ).csv(path)


MALFORMED = "_malformed"


def read_embedded_csv_checked(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S6 with its malformed records: (rows, (record,)). Columns are the given ones, in
    the order of the files, or those of the first file's header; a record with another number of fields, or a quote that does not close, is kept as it
    stands in the second table and has no row in the first."""
    columns = columns or spark.read.options(**CSV_READ).csv(path).columns        # reads a header line alone
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, MALFORMED]])
    rows = spark.read.schema(schema).options(**CSV_READ, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED).csv(path)
    # Spark reads no CSV for its malformed records alone: another column has to be asked for
    record = F.concat(F.col(MALFORMED), F.substring(F.coalesce(F.col(columns[0]), F.lit("")), 1, 0))
    return rows.where(F.col(MALFORMED).isNull()).drop(MALFORMED), rows.where(F.col(MALFORMED).isNotNull()).select(record.alias("record"))


def write_files(df: DataFrame, root: str, name_col: str = "name", content_col: str = "content") -> None:
    """Each row a file ``root/name`` (binary; the name may have folders), written by the tasks through the file system that
    ``root`` names. A file is written under another name first and renamed, so a retry leaves whole files."""
    schema = pa.schema([("n", pa.int64())])

    def run(batches):
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        system.create_dir(base, recursive=True)
        made = set()
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                folder, _, last = name.rpartition("/")
                if folder and folder not in made:
                    system.create_dir(f"{base}/{folder}", recursive=True)
                    made.add(folder)
                part = f"{base}/{folder}/.{last}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], schema=schema)

    df.select(F.col(name_col).alias("name"), F.col(content_col).cast("binary").alias("content")) \
        .where("name is not null and content is not null").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _few_tasks(files: DataFrame) -> DataFrame:
    """A scan of small files has a task for each 32 of them: beyond 32 tasks a core they are joined."""
    most = 32 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(most) if files.rdd.getNumPartitions() > most else files


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file below ``root`` (recursive) with its path relative to
    ``root``; content is read lazily and only when selected."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^(file:)?" + _re_escape(prefix), "")
    return _few_tasks(df.withColumn("relpath", rel))


def read_text_files(spark: SparkSession, root: str) -> DataFrame:
    """One file = one document (an empty one too), universal newlines; the path as it is on the file system.
    Tasks list the files and read them, compressed ones by their name; the driver holds no names. Spark's own reader,
    whose driver holds all of them, is left for what tasks can't read (``task_folder``, names of ``_SPARK_ONLY``)."""
    text = F.regexp_replace(F.col("value"), "\r\n?", "\n").alias("text")
    at = task_folder(spark, root)
    names = None if at is None else list_files(spark, at)
    if names is None or names.agg(F.bool_or(F.col("relpath").rlike(_SPARK_ONLY))).first()[0]:
        df = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
        # Spark gives the path as a URI; a plus sign stands for itself there
        return _few_tasks(df.select(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))).alias("path"), text))
    path = F.concat(F.regexp_replace("root", "^file:", "file://"), F.lit("/"), F.col("relpath")).alias("path")
    return read_contents(names, unpack=True).select(path, F.col("content").cast("string").alias("value")).select("path", text)


# Names of files: where they are listed from, and below it; length in bytes, time of the last change in ms.
NAMES = "root string, relpath string, length long, modified long"
_LISTED = NAMES + ", folder boolean"
_LISTED_AT_ONCE = 10_000
_READ_AT_ONCE = 8 << 20
_CODECS = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}
_SPARK_ONLY = r"(?i)\.(deflate|snappy|lz4)$"       # Hadoop's own formats


def _opened(root: str):
    """The file system of a qualified path (as Hadoop writes it, nothing escaped), and the path there."""
    from urllib.parse import quote
    from pyarrow import fs
    scheme, _, rest = root.partition(":")
    system, base = (fs.LocalFileSystem(), rest) if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
    return system, base.rstrip("/")


def task_folder(spark: SparkSession, root: str) -> str | None:
    """``root``, qualified, if tasks can list and read it: a folder of a file system that pyarrow opens.
    None for one file, a pattern, nothing there, or a file system that only Spark reads."""
    from pyarrow import fs
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    try:
        system, base = _opened(at)
        return at if system.get_file_info(base or "/").type == fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None


def _hidden(name: str) -> bool:
    """Files and folders that Spark's readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listing(root: str, suffix: str, below: bool):
    """Arrow batches of folders -> of what they hold; with ``below`` of the files in all folders below them."""
    schema = pa.schema([("root", pa.string()), ("relpath", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("folder", pa.bool_())])

    def run(batches):
        from pyarrow import fs
        system, base = _opened(root)
        rows = []
        for batch in batches:
            todo = batch.column(0).to_pylist()
            while todo:
                at = todo.pop()
                for f in system.get_file_info(fs.FileSelector(f"{base}/{at}", allow_not_found=True)):
                    name, folder = f.base_name, f.type == fs.FileType.Directory
                    rel = f"{at}/{name}" if at else name
                    if _hidden(name) or not (folder or (f.type == fs.FileType.File and name.endswith(suffix))):
                        continue
                    if folder and below:
                        todo.append(rel)
                        continue
                    rows.append((root, rel, f.size, None if f.mtime_ns is None else f.mtime_ns // 1_000_000, folder))
                    if len(rows) == _LISTED_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def list_files(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """Every file below a ``task_folder`` whose name ends with ``suffix``, as ``NAMES``. Tasks list the folders, level by
    level until there are four for each core, then each with all below it; the names go to the shared checkpoint
    folder. The files of one folder are listed by one task."""
    staging, cores = scratch_path(spark, "file-names"), spark.sparkContext.defaultParallelism
    folders, n, levels = spark.range(1).select(F.lit("").alias("relpath")), 1, []
    while n:
        below = n >= 4 * cores
        levels.append(f"{staging}/{len(levels)}")
        folders.repartition(min(n, 4 * cores)).mapInArrow(_listing(root, suffix, below), _LISTED).write.parquet(levels[-1])
        folders = spark.read.schema(_LISTED).parquet(levels[-1]).where("folder").select("relpath")
        n = 0 if below else folders.count()
    return spark.read.schema(_LISTED).parquet(*levels).where("not folder").drop("folder")


def _conf_bytes(spark: SparkSession, name: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).lower()).groups()
    return int(number) << (10 * " kmgt".index(unit or " "))


def _dealt(names: DataFrame) -> DataFrame:
    """Names dealt to as many tasks as Spark's readers have for such files, but at most 32 a core."""
    spark, cores = names.sparkSession, names.sparkSession.sparkContext.defaultParallelism
    n, size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    opening = _conf_bytes(spark, "spark.sql.files.openCostInBytes")
    size += n * opening
    split = min(_conf_bytes(spark, "spark.sql.files.maxPartitionBytes"), max(opening, size // cores, 1))
    return names.repartition(max(1, min(n, 32 * cores, math.ceil(size / split))))


def read_contents(names: DataFrame, unpack: bool = False) -> DataFrame:
    """The files of ``NAMES`` with their ``content``, read by tasks that hold a few MB or one file at a time."""
    names = _dealt(names.select("root", "relpath", "length", "modified"))
    skip = names.sparkSession.conf.get("spark.sql.files.ignoreMissingFiles") == "true"

    def run(batches):
        systems = {}
        for batch in batches:
            kept, contents, size = [], [], 0
            for i, (root, rel) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                system, base = systems.get(root) or systems.setdefault(root, _opened(root))
                codec = _CODECS.get(rel.rpartition(".")[2].lower()) if unpack else None
                try:
                    with system.open_input_stream(f"{base}/{rel}", compression=codec) as f:
                        contents.append(f.read())
                except FileNotFoundError:
                    if skip:
                        continue
                    raise
                kept.append(i)
                size += len(contents[-1])
                if size >= _READ_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])
                    kept, contents, size = [], [], 0
            if kept:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])

    return names.mapInArrow(run, NAMES + ", content binary")


def _re_escape(s: str) -> str:
    return re.escape(s)
