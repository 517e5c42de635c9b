"""Named-table sources: a table name resolves to a DataFrame through the
catalog, a Parquet folder or JDBC. Identifiers never go into SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


class TableNotFound(Exception):
    pass


def load_table(spark: SparkSession, name: str, sf_dir: str | None = None,
               fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """Resolve ``name``: a Parquet file/folder below ``sf_dir`` when given,
    else a catalog table; ``fmt='jdbc'`` reads ``dbtable=name`` with the given
    connection options (numPartitions bounds concurrent connections)."""
    if fmt == "jdbc":
        opts = {"numPartitions": "10", **(options or {}), "dbtable": name}
        return spark.read.format("jdbc").options(**opts).load()
    if sf_dir is not None:
        return spark.read.options(**(options or {})).format(fmt).load(f"{sf_dir}/{name}.{fmt}")
    if not spark.catalog.tableExists(name):
        raise TableNotFound(f"Table {name} does not exist")
    return spark.table(name)


def column_names(df: DataFrame) -> list[str]:
    """Column listing in table order (schema only, no job)."""
    return list(df.schema.names)


def sample_scan(df: DataFrame, n: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows. The reference's LIMIT has no order; ours is
    deterministic: ordered by ``order_by`` (default: the first column), which
    plans as TakeOrderedAndProject (a per-task top-n, then a merge of n rows
    per task), never a full sort. The top keys are found first, from the key
    columns alone, and bound the scan of the wide ones by a pushed filter."""
    keys = order_by or [df.columns[0]]
    top = df.select(*keys).orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(n)
    bound = top.agg(F.max(keys[0])).first()[0]
    if bound is not None:
        df = df.where((F.col(keys[0]) <= bound) | F.col(keys[0]).isNull())
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(n)
