"""Registered table-profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators.model import apply_model
from ragframe.operators.profile import (NO_DESCRIPTION, SAMPLE_ROWS, catalog_entries, column_samples,
                                        describe_model, profile_prompt, read_catalog,
                                        table_descriptions, union_all)
from ragframe.plans.registry import register
from ragframe.plans.scalar_queries import parse_description_rows
from ragframe.sources.tables import load_table, sample_scan

# Tables profiled by the queries, their columns (table order) and the key
# that makes the 100-row sample deterministic.
PROFILED = {
    "region": (["r_regionkey", "r_name"], ["r_regionkey"]),
    "nation": (["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"]),
    "supplier": (["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["s_suppkey"]),
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_custkey"]),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ["p_partkey"]),
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority"], ["o_orderkey"]),
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "l_shipdate"], ["l_orderkey", "l_linenumber"]),
    "events": (["event_id", "ts", "user_id", "event_type", "value", "props"], ["event_id"]),
    "labels": (["doc_id", "quality", "toxic"], ["doc_id"]),
    "benchmark": (["item_id", "text"], ["item_id"]),
    "conversations": (["conv_id", "turn", "role", "text"], ["conv_id", "turn"]),
    "documents": (["doc_id", "text", "lang", "source", "n_chars"], ["doc_id"]),
    "pages": (["page_id", "url", "html"], ["page_id"]),
    # the vector itself has no text form that engines agree on
    "embeddings": (["vec_id", "label"], ["vec_id"]),
}
# Line numbers repeat within an order: its sample is ordered by every column.
PROFILED["lineitem"][1].extend(c for c in PROFILED["lineitem"][0] if c not in PROFILED["lineitem"][1])
# Requested names include one that is not a table.
REQUESTED = list(PROFILED) + ["employees"]


def _lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _catalog_values() -> str:
    return ", ".join(f"({_lit(t)}, {_lit(d)})" for t, d in catalog_entries())


def _sample_sql(t: str) -> str:
    cols, key = PROFILED[t]
    order = ", ".join(key)
    return (f"SELECT *, row_number() OVER (ORDER BY {order}) AS _row FROM "
            f"(SELECT * FROM {t} ORDER BY {order} LIMIT {SAMPLE_ROWS})")


def _col_samples_sql(t: str) -> str:
    cols, _ = PROFILED[t]
    parts = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({i} AS BIGINT) AS col_pos, _row, "
             f"CAST({c} AS VARCHAR) AS value FROM s_{t}" for i, c in enumerate(cols)]
    return " UNION ALL ".join(parts)


def _with_samples() -> str:
    return "WITH " + ", ".join(f"s_{t} AS ({_sample_sql(t)})" for t in PROFILED)


@register("scan_sample", f"""
SELECT * FROM orders ORDER BY o_orderkey LIMIT {SAMPLE_ROWS}
""")
def q_scan_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 rows, all columns, deterministic order (TakeOrderedAndProject)."""
    return sample_scan(load_table(spark, "orders", sf_dir), SAMPLE_ROWS, ["o_orderkey"])


@register("column_samples", _with_samples() + ", u AS (" + " UNION ALL ".join(
    _col_samples_sql(t) for t in PROFILED) + """)
SELECT table_name, column_name, col_pos, count(value) AS n_values,
       string_agg(value, '|' ORDER BY _row) AS sample_values
FROM u GROUP BY table_name, column_name, col_pos
""")
def q_column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + P1 for all tables: column names in table order and their
    sample values."""
    return union_all([column_samples(load_table(spark, t, sf_dir).select(*cols), t, key)
                      for t, (cols, key) in PROFILED.items()])


@register("table_descriptions", f"""
WITH req AS (SELECT unnest([{', '.join(_lit(t) for t in REQUESTED)}]) AS table_name),
cat AS (SELECT * FROM (VALUES {_catalog_values()}) v(table_name, description)),
cols AS (SELECT table_name, count(*) AS n FROM duckdb_columns() GROUP BY table_name),
rows AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in PROFILED) + f""")
SELECT r.table_name, CAST(c.n AS BIGINT) AS n_columns, CAST(rw.n_rows AS BIGINT) AS n_rows,
       CASE WHEN k.table_name IS NOT NULL THEN coalesce(k.description, '{NO_DESCRIPTION}') END AS description,
       CASE WHEN c.n IS NULL THEN 'unknown_table' WHEN k.table_name IS NULL THEN 'not_in_catalog'
            ELSE 'ok' END AS status
FROM req r LEFT JOIN cols c ON c.table_name = r.table_name LEFT JOIN cat k ON k.table_name = r.table_name
LEFT JOIN rows rw ON rw.table_name = r.table_name
""")
def q_table_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + P2 + F7 + X13: catalogue lookup with default and status, plus
    each table's column and row count."""
    tables = {t: load_table(spark, t, sf_dir) for t in PROFILED}
    return table_descriptions(spark, tables, read_catalog(spark), REQUESTED)


def _prompt_sql(t: str) -> str:
    cols, key = PROFILED[t]
    desc = dict(catalog_entries()).get(t) if t in dict(catalog_entries()) else None
    head = f"Table: {t}\nDescription: {desc or NO_DESCRIPTION}\nColumns: {', '.join(cols)}\nRows: "
    head_sql = _lit(head).replace("\n", "' || chr(10) || '")
    struct = ", ".join(f'"{c}" := CAST({c} AS VARCHAR)' for c in cols)
    return (f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, "
            f"{head_sql} || to_json(list(struct_pack({struct}) ORDER BY _row)) AS prompt FROM s_{t}")


_PROMPTS_SQL = _with_samples() + ", prompts AS (" + " UNION ALL ".join(_prompt_sql(t) for t in PROFILED) + ")"


def _prompts(spark, sf_dir) -> DataFrame:
    cat = dict(catalog_entries())
    return union_all([profile_prompt(load_table(spark, t, sf_dir).select(*cols), t, cat.get(t), key)
                      for t, (cols, key) in PROFILED.items()])


@register("profile_prompts", _PROMPTS_SQL + """
SELECT table_name, n_rows, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_chars FROM prompts
""")
def q_profile_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per table with the 100-row sample as JSON."""
    p = _prompts(spark, sf_dir)
    return p.select("table_name", "n_rows", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("long").alias("prompt_chars"))


def _described_sql(t: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({i} AS BIGINT) AS line_no, '{c}' AS column_name, "
        f"'column {i + 1} of {t}, ' || count(DISTINCT CAST({c} AS VARCHAR)) || ' values in the sample' AS description, "
        f"'ok' AS status FROM s_{t}" for i, c in enumerate(PROFILED[t][0]))


@register("describe_tables", _with_samples() + " SELECT * FROM (" + " UNION ALL ".join(_described_sql(t) for t in PROFILED) + ")")
def q_describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt -> model -> parsed 'name: description' lines."""
    p = _prompts(spark, sf_dir)
    answered = apply_model(p, describe_model, ["prompt"], "answer")
    return parse_description_rows(answered.select("table_name", "answer"), "table_name")
