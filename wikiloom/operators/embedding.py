"""Embedding of chunks by a pluggable model, in batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.vectors import dummy_embedding

# Fixed value: chunks for each request to a model.
BATCH = 100

#: texts -> one vector for each, in the texts' order; imported or closed over, so that executors can run it.
Embedder = Callable[[list[str]], list[list[float]]]


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, model: str = "dummy", batch: int = BATCH, fall_back: bool = False) -> DataFrame:
    """(chunk_id, embedding, model, status) for (chunk_id, content).

    Without an embedder the deterministic stand-in is computed in the JVM. With one, a batch that fails is marked
    'failed' with null vectors, or gets the stand-in with ``fall_back`` ('dummy'): the run's counters come from status.
    """
    own = chunks.select("chunk_id", F.coalesce("content", F.lit("")).alias("content"))
    if embedder is None:
        return own.select("chunk_id", dummy_embedding(F.col("content")).alias("embedding"), F.lit(model).alias("model"), F.lit("ok").alias("status"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    vectors = embedder(part["content"].tolist())
                    good = len(vectors) == len(part)
                except Exception:
                    good = False
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "content": part["content"], "embedding": list(vectors) if good else [None] * len(part), "status": "ok" if good else "failed"})

    done = own.mapInPandas(run, f"chunk_id {kind}, content string, embedding array<double>, status string")
    if fall_back:
        failed = F.col("status") == "failed"
        done = done.withColumn("embedding", F.when(failed, dummy_embedding(F.col("content"))).otherwise(F.col("embedding"))).withColumn("status", F.when(failed, "dummy").otherwise(F.col("status")))
    return done.select("chunk_id", "embedding", F.lit(model).alias("model"), "status")


def run_counters(embedded: DataFrame) -> DataFrame:
    """How many chunks ended in each status."""
    return embedded.groupBy("status").agg(F.count(F.lit(1)).alias("chunks"))
