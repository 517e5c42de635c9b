"""Reassembling streamed model answers from ordered partial strings.

Batch: one ordered concatenation per message. Stream: a custom stateful
operator (``applyInPandasWithState``) keeps the parts of each open message,
emits the message once its closing part and every earlier part have arrived,
and removes its state; optionally, messages that stay incomplete past a
timeout are written out as such. State therefore holds only open messages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ragframe.functions.text import split_keep


def to_deltas(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Split answers into word deltas (each carrying its leading space), then
    a closing null delta, as a streamed completion delivers them; ``last``
    marks the closing part."""
    parts = F.array_append(split_keep(F.col(text_col), " "), F.lit(None).cast("string"))
    out = df.select(*keys, F.posexplode_outer(parts).alias("seq", "delta"))
    # only the closing part is null; counting the parts here would split the text again for each of them
    return out.select(*keys, F.col("seq").cast("long").alias("seq"), "delta",
                      F.when(F.col("seq").isNotNull(), F.col("delta").isNull()).alias("last"))


def reassemble(deltas: DataFrame, keys: list[str], seq_col: str = "seq",
               delta_col: str = "delta") -> DataFrame:
    """Concatenate deltas in ``seq`` order, skipping nulls (batch form). A part
    that was sent several times counts once (of different ones, the largest)."""
    once = deltas.groupBy(*keys, F.col(seq_col).alias("_s")).agg(F.max(delta_col).alias("_d"))
    parts = F.array_sort(F.collect_list(F.struct("_s", "_d")))
    return once.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_deltas"),
        F.array_join(F.transform(parts, lambda x: x["_d"]), "").alias("text"))


def _assembler(keys: list[str], timeout_ms: int | None):
    def message(key, parts, complete):
        text = "".join(parts[s] for s in sorted(parts) if parts[s] is not None)
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "n_deltas": [len(parts)], "text": [text], "complete": [complete]})

    def step(key, batches, state):
        seqs, texts, last = state.get if state.exists else ([], [], -1)
        parts = dict(zip(seqs, texts))          # one part per number
        if state.hasTimedOut:
            state.remove()
            yield message(key, parts, False)    # what has come of an open message
            return
        for pdf in batches:
            # plain lists: a message has few rows, for which each call on a frame costs more than its work
            seq = pdf["seq"].tolist()
            for s, d in zip(seq, pdf["delta"].tolist(), strict=True):
                old = parts.get(s)
                # a null (not a string in a frame) takes the number's place only
                parts[s] = old if not isinstance(d, str) or (old is not None and old >= d) else d
            last = max([int(last), *(s for s, closing in zip(seq, pdf["last"].tolist(), strict=True) if closing)])
        if last >= 0 and len(parts) == last + 1:
            if state.exists:
                state.remove()
            yield message(key, parts, True)
        else:
            state.update((list(parts), list(parts.values()), last))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
    return step


def reassemble_stream(spark, source_path: str, schema: str, keys: list[str], checkpoint: str,
                      output_path: str, key_types: str = "long", timeout_ms: int | None = None,
                      available_now: bool = True):
    """Streaming reassembly over a folder of delta files; finished messages are
    appended to Parquet files below ``output_path`` (exactly once: the file
    sink commits by epoch) with ``complete`` true.

    ``timeout_ms`` evicts messages that stay incomplete that long and writes what
    has come of them, ``complete`` false (for a continuously running stream; it
    makes the engine schedule clean-up batches, so it is off for
    ``available_now`` runs). A part repeated after its message was finished opens
    a message of its own. Returns the StreamingQuery (finished when ``available_now``)."""
    stream = spark.readStream.schema(schema).parquet(source_path)
    out_schema = ", ".join(f"{k} {key_types}" for k in keys) + ", n_deltas long, text string, complete boolean"
    state_schema = "seqs array<long>, parts array<string>, last long"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    assembled = stream.groupBy(*keys).applyInPandasWithState(
        _assembler(keys, timeout_ms), out_schema, state_schema, "append", timeout)
    w = (assembled.writeStream.outputMode("append").format("parquet").option("path", output_path)
         .option("checkpointLocation", checkpoint))
    if available_now:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return w.start()
