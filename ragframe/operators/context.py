"""Context assembly: token-budget packing of ranked chunks, prompt building,
ordered string concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.session import scratch_path

# Fixed value of the reference: the running token total must stay below this.
DEFAULT_BUDGET = 10000

# Contents that a task packs, by an estimate of bytes a token.
PART_BYTES = 32 * 1024 * 1024
TOKEN_BYTES = 5

# Our own prompt wording (the reference's exact text is not needed for results).
SYSTEM_PREFIX = ("Answer only from the reference passages below. If the answer is not "
                 "in them, say that you cannot answer.\n\nPassages:\n")
SYSTEM_SUFFIX = "\nEnd of passages."
USER_PREFIX = "Question: "


def ordered_concat(order: Column | str, text: Column | str, sep: str = "") -> Column:
    """Aggregate: texts joined by ``sep`` in ``order``. Use on bounded groups."""
    order = F.col(order) if isinstance(order, str) else order
    text = F.col(text) if isinstance(text, str) else text
    s = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(s, lambda x: x["t"]), sep)


def quarantine_tokens(ranked: DataFrame, tokens_col: str = "num_tokens"):
    """Split ranked rows into (valid, rejected): a null or negative token
    count cannot be budgeted."""
    bad = F.col(tokens_col).isNull() | (F.col(tokens_col) < 0)
    return ranked.filter(~bad), ranked.filter(bad).withColumn("reject_reason", F.lit("bad_num_tokens"))


def _with_contents(kept: DataFrame, contents: DataFrame, qid_col: str, rank_col: str, tokens_col: str, id_cols: list[str]) -> DataFrame:
    """``kept`` with the contents of its ids, dealt by question into parts of about ``PART_BYTES``,
    as many as the kept tokens call for: what a task sorts does not grow with the input."""
    spark = kept.sparkSession
    path = scratch_path(spark, "kept")
    kept.write.parquet(path)
    kept = spark.read.schema(kept.schema).parquet(path)
    tokens = kept.agg(F.sum(tokens_col)).first()[0] or 0
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = max(least, -(-int(tokens) * TOKEN_BYTES // PART_BYTES))
    if n > least:       # a join by shuffle then has parts as small
        kept, contents = kept.repartition(n, *id_cols), contents.repartition(n, *id_cols)
    return contents.join(kept, id_cols).repartition(n, qid_col).dropDuplicates([qid_col, rank_col])


def context_pack(ranked: DataFrame, questions: DataFrame | None = None, *,
                 budget: int = DEFAULT_BUDGET, qid_col: str = "qid", rank_col: str = "rank",
                 content_col: str = "content", tokens_col: str = "num_tokens",
                 with_rejected: bool = False, contents: DataFrame | None = None,
                 id_cols: tuple[str, ...] = ("id",)) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Keep ranked chunks while the running token total (this chunk
    included) stays below ``budget``; the first chunk that reaches it and
    every later one are dropped. Each kept content is followed by a newline.

    Returns ``qid, n_chunks, ctx_tokens, context``; questions without any
    kept chunk (given in ``questions``) get an empty context.
    Groups are bounded by k (the search limit). Rows whose token count cannot be
    budgeted take no part; with ``with_rejected`` they come as a second table, with
    ``reject_reason``. With ``contents`` (``id_cols``, ``content_col``) ranked rows need
    no content: that of the kept ones alone is fetched, by parts of bounded size; of a
    row stored several times it is taken once."""
    valid, rejected = quarantine_tokens(ranked, tokens_col)
    w = (Window.partitionBy(qid_col).orderBy(rank_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = (valid.withColumn("_run", F.sum(tokens_col).over(w))
            .filter(F.col("_run") < budget))
    if contents is not None:
        kept = _with_contents(kept.select(qid_col, rank_col, tokens_col, *id_cols), contents.select(*id_cols, content_col),
                              qid_col, rank_col, tokens_col, list(id_cols))
    packed = kept.groupBy(qid_col).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(tokens_col).cast("long").alias("ctx_tokens"),
        ordered_concat(rank_col, F.concat(F.col(content_col), F.lit("\n"))).alias("context"))
    if questions is not None:
        packed = (questions.select(qid_col).join(packed, qid_col, "left")
                  .select(qid_col,
                          F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
                          F.coalesce("ctx_tokens", F.lit(0)).cast("long").alias("ctx_tokens"),
                          F.coalesce("context", F.lit("")).alias("context")))
    return (packed, rejected) if with_rejected else packed


def build_prompts(df: DataFrame, context_col: str = "context", question_col: str = "question",
                  system_prefix: str = SYSTEM_PREFIX, system_suffix: str = SYSTEM_SUFFIX,
                  user_prefix: str = USER_PREFIX) -> DataFrame:
    """Grounded prompt per question (context may be empty)."""
    return df.withColumn("system", F.concat(F.lit(system_prefix), F.col(context_col),
                                            F.lit(system_suffix))) \
             .withColumn("user", F.concat(F.lit(user_prefix), F.col(question_col)))
