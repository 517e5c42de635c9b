"""Applying an external model (chat completion, embedder) to a column of
prompts: Arrow batches per partition, one client per partition, a time limit
and bounded retries. A batch that fails is asked again prompt by prompt, so one
bad prompt costs no other its answer; failures are kept in an ``error`` column
instead of failing the job."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ModelFn = Callable[[pd.DataFrame], pd.Series]


def apply_model(df: DataFrame, fn: ModelFn | Callable[[], ModelFn], prompt_cols: list[str],
                out_col: str = "answer", *, max_retries: int = 3, backoff_s: float = 0.5,
                factory: bool = False, timeout_s: float | None = 10.0) -> DataFrame:
    """Add ``out_col`` (string) and ``error`` (string) computed by ``fn`` on
    each Arrow batch of ``prompt_cols``. With ``factory=True`` ``fn`` is called
    once per partition to build the client-bound function. A call that takes
    longer than ``timeout_s`` counts as failed. The whole batch is tried once,
    each prompt of a failed one up to ``max_retries`` times more."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType()),
                                              T.StructField("error", T.StringType())])

    def run(batches):
        f = fn() if factory else fn
        for pdf in batches:
            answers = _answers(f, pdf[prompt_cols], max_retries, backoff_s, timeout_s)
            pdf = pdf.copy()
            for c, i in ((out_col, 0), ("error", 1)):
                pdf[c] = pd.Series([a[i] for a in answers], index=pdf.index, dtype=object)
            yield pdf

    return df.mapInPandas(run, schema)


def model_answers(fn: ModelFn, prompt: Column, *, max_retries: int = 3, backoff_s: float = 0.5,
                  timeout_s: float | None = 10.0) -> Column:
    """``apply_model`` as a column, struct<answer, error>: only the prompts (a frame with
    the column ``prompt``) go to Python, whatever else the rows hold. Write the result
    before using it twice, or the model is asked twice."""
    @F.pandas_udf("struct<answer:string,error:string>")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        answers = _answers(fn, prompts.rename("prompt").to_frame(), max_retries, backoff_s, timeout_s)
        return pd.DataFrame({"answer": pd.Series([a for a, _ in answers], dtype=object),
                             "error": pd.Series([e for _, e in answers], dtype=object)})
    return ask.asNondeterministic()(prompt)


def _answers(f: ModelFn, prompts: pd.DataFrame, max_retries: int, backoff_s: float,
             timeout_s: float | None) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt of a batch."""
    def call(some: pd.DataFrame) -> list:
        if timeout_s is None:
            return list(f(some))
        pool = ThreadPoolExecutor(1)      # one that hangs is left behind
        try:
            return list(pool.submit(f, some).result(timeout_s))
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def one(prompt: pd.DataFrame) -> tuple[str | None, str | None]:
        err = None
        for attempt in range(max_retries):
            try:
                return call(prompt)[0], None
            except Exception as e:  # noqa: BLE001 - model errors are data
                err = f"{type(e).__name__}: {e}"
                if attempt + 1 < max_retries:
                    time.sleep(backoff_s * (2 ** attempt))
        return None, err

    if not len(prompts):
        return []
    try:
        return [(a, None) for a in call(prompts)]
    except Exception as e:  # noqa: BLE001
        failed = f"{type(e).__name__}: {e}"
        return [one(prompts.iloc[i:i + 1]) if max_retries else (None, failed) for i in range(len(prompts))]


def echo_user(prompts: pd.DataFrame) -> pd.Series:
    """Deterministic stand-in model: answers with the user message."""
    return prompts.iloc[:, -1]
