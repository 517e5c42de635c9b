"""Size checks that gate every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast only sides whose measured size is below this many bytes.
DEFAULT_BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame, per_row_bytes: int, array_col: str | None = None,
                   elem_bytes: int = 4) -> int:
    """Upper estimate of a DataFrame's in-memory size from one cheap
    aggregate (row count and, for a vector column, the largest length)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if array_col is not None:
        aggs.append(F.max(F.size(array_col)).alias("dim"))
    row = df.agg(*aggs).first()
    dim = (row["dim"] or 0) if array_col is not None else 0
    return int(row["n"]) * (per_row_bytes + dim * elem_bytes)


def fits_broadcast(df: DataFrame, per_row_bytes: int, array_col: str | None = None,
                   max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES) -> bool:
    return measured_bytes(df, per_row_bytes, array_col) <= max_bytes


def measured_rows(df: DataFrame, array_col: str | None = None) -> tuple[int, int]:
    """(rows, largest array length) of ``df`` in one small job."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if array_col is not None:
        aggs.append(F.max(F.size(array_col)).alias("dim"))
    row = df.agg(*aggs).first()
    return int(row["n"]), int((row["dim"] or 0) if array_col is not None else 0)
