"""Table profiling: column samples, catalogue descriptions, profiling
prompts and parsed column descriptions, for many tables at once."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragframe.sources.tables import sample_scan

# Fixed values of the reference: 100 sample rows, default description.
SAMPLE_ROWS = 100
NO_DESCRIPTION = "This table has no description."

CATALOG_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "catalog.json")


def read_catalog(spark: SparkSession, path: str = CATALOG_PATH) -> DataFrame:
    """Catalogue JSON ``{table: {description}}`` -> rows ``(table_name, description)``.
    The catalogue that comes with the package lies on the driver's disk alone: it is
    read there (a row per table); any other path is read by Spark."""
    if path == CATALOG_PATH:
        return spark.createDataFrame(catalog_entries(path), "table_name string, description string")
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,struct<description:string>>")
    return (raw.select(F.explode(m).alias("table_name", "entry"))
            .select("table_name", F.col("entry.description").alias("description")))


def catalog_entries(path: str = CATALOG_PATH) -> list[tuple[str, str | None]]:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return [(k, v.get("description")) for k, v in data.items()]


def sample_rows(df: DataFrame, order_by: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """S1 with an explicit row number (bounded: at most ``n`` rows)."""
    s = sample_scan(df, n, order_by)
    w = Window.orderBy(*order_by)   # over <= n rows only
    return s.withColumn("_row", F.row_number().over(w))


def column_samples(df: DataFrame, table_name: str, order_by: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """Per column, its position and the sample values (as text, in
    sample order, '|'-joined)."""
    cols = df.columns
    s = sample_rows(df, order_by, n)
    long = s.select("_row", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("col_pos"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(cols)])).alias("_c")).select("_row", "_c.*")
    agg = long.groupBy("column_name", "col_pos").agg(
        F.count("value").alias("n_values"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "value"))),
                                 lambda x: x["value"]), "|").alias("sample_values"))
    return agg.select(F.lit(table_name).alias("table_name"), "column_name",
                      F.col("col_pos").cast("long").alias("col_pos"), "n_values", "sample_values")


def table_descriptions(spark: SparkSession, tables: dict[str, DataFrame],
                       catalog: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """P2 + F7 + X13 for a batch of table names, with each table's column
    and row count: unknown table first, then missing catalogue entry; a
    catalogue entry without a description gets the default text. Row counts
    are one aggregate per table (partial counts per task)."""
    names = requested or list(tables)
    known = [t for t in names if t in tables]
    counts = union_all([tables[t].agg(F.count(F.lit(1)).alias("n_rows"))
                        .select(F.lit(t).alias("table_name"), F.lit(len(tables[t].columns)).alias("n_columns"),
                                "n_rows") for t in known]) if known else None
    req = spark.createDataFrame([(t,) for t in names], "table_name string")
    if counts is not None:
        req = req.join(counts, "table_name", "left")
    else:
        req = req.withColumn("n_columns", F.lit(None).cast("int")).withColumn("n_rows", F.lit(None).cast("long"))
    j = req.join(catalog.withColumn("_in", F.lit(True)), "table_name", "left")
    status = (F.when(F.col("n_columns").isNull(), F.lit("unknown_table"))
              .when(F.col("_in").isNull(), F.lit("not_in_catalog"))
              .otherwise(F.lit("ok")))
    return j.select("table_name", F.col("n_columns").cast("long").alias("n_columns"),
                    F.col("n_rows").cast("long").alias("n_rows"),
                    F.when(F.col("_in").isNotNull(), F.coalesce("description", F.lit(NO_DESCRIPTION)))
                    .alias("description"), status.alias("status"))


def profile_prompt(df: DataFrame, table_name: str, description: str | None, order_by: list[str],
                   n: int = SAMPLE_ROWS) -> DataFrame:
    """One prompt row per table: name, description, columns and the
    sample rows as JSON (values as text, sample order)."""
    cols = df.columns
    s = sample_rows(df, order_by, n)
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in cols])
    agg = s.agg(F.count(F.lit(1)).alias("n_rows"),
                F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_row").alias("r"), row.alias("v")))),
                                      lambda x: x["v"])).alias("rows_json"))
    prompt = F.concat(F.lit(f"Table: {table_name}\nDescription: {description or NO_DESCRIPTION}\n"
                            f"Columns: {', '.join(cols)}\nRows: "), F.col("rows_json"))
    return agg.select(F.lit(table_name).alias("table_name"), F.col("n_rows").cast("long").alias("n_rows"),
                      prompt.alias("prompt"))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def describe_model(prompts):
    """Stand-in model for P4: one 'name: description' line per column listed in
    the prompt, with the number of its values in the sample rows."""
    import pandas as pd
    out = []
    for p in prompts.iloc[:, 0]:
        *lines, rows = p.split("\n", 3)
        head = dict(line.split(": ", 1) for line in lines if ": " in line)
        sample = json.loads(rows.partition("Rows: ")[2] or "[]")
        columns = [c for c in head.get("Columns", "").split(", ") if c]
        out.append("\n".join(f"{c}: column {i} of {head.get('Table', '')}, {len({r[c] for r in sample if c in r})} values in the sample"
                              for i, c in enumerate(columns, 1)))
    return pd.Series(out)
