"""Vectors in blocks: index rows and query rows are gathered into blocks that meet pair by pair.

An index block is one row (a few thousand vectors in the form an operator needs); a query block is one row of a few
hundred queries. Index blocks are spread over shards, each shard gets all query blocks, and a pair gives the best few
of the block for each of its queries; the best of all blocks follow from these. Nothing goes through the driver but
the two numbers of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.plans.shared import shared_table

#: A block has so many vectors, and their components so many bytes, at most (one vector at least).
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
QUERY_ROWS, QUERY_BYTES = 256, 2 << 20


def rows_of(dims: int, rows: int, limit: int) -> int:
    """How many vectors of a length make a block."""
    return max(1, min(rows, limit // (8 * dims)))


def usable(df: DataFrame, id_col: str, vector_col: str, scale: float = 1.0) -> DataFrame:
    """(vec_id, vector) of rows with an id and a vector without components that are null, NaN or infinite (or become so
    when multiplied by ``scale``); none is empty."""
    vector = F.col(vector_col).cast("array<double>")
    found = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) == float("inf")))
    return found.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def index_blocks(vectors: DataFrame, build: Callable[[np.ndarray, np.ndarray], bytes], name: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (dims, first, body) for each run of vectors of equal length, ``rows`` of them or BLOCK_BYTES at most; body:
    build(ids, matrix)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def close(dims: int) -> pd.DataFrame:
            block = sorted(held.pop(dims), key=lambda x: x[0])
            ids = np.fromiter((i for i, _ in block), np.int64, len(block))
            return pd.DataFrame({"dims": [dims], "first": [ids[0]], "body": [build(ids, np.stack([v for _, v in block]))]})

        for pdf in batches:
            for i, v in zip(pdf["vec_id"], pdf["vector"], strict=True):
                block = held.setdefault(len(v), [])
                block.append((i, np.asarray(v, float)))
                if len(block) >= rows_of(len(v), rows, BLOCK_BYTES):
                    yield close(len(v))
        for dims in list(held):
            yield close(dims)

    return shared_table(vectors.mapInPandas(run, "dims int, first long, body binary"), name)


def query_blocks(queries: DataFrame, name: str, rows: int = QUERY_ROWS) -> DataFrame:
    """One row (dims, ids, flat) for about ``rows`` queries of equal length, fewer of long ones; of repeated ids the least
    vector asks."""
    once = shared_table(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), name)
    count, longest = once.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, math.ceil(count / rows_of(longest or 1, rows, QUERY_BYTES)))
    keyed = once.groupBy(F.size("vector").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    both = keyed.agg(F.collect_list(F.struct("vec_id", "vector")).alias("q"))
    return both.select("dims", F.col("q.vec_id").alias("ids"), F.flatten("q.vector").alias("flat"))


def best_of_pairs(index: DataFrame, queries: DataFrame, best: Callable[[bytes, np.ndarray, np.ndarray], list[tuple[int, int, float]]], score: str, k: int, ascending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best over all blocks; best(body, ids, matrix) gives (query, vector, score)."""
    shards = max(1, min(index.count(), 4 * index.sparkSession.sparkContext.defaultParallelism))
    spread = index.withColumn("shard", F.pmod(F.xxhash64("dims", "first"), F.lit(shards)))
    everywhere = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    pairs = spread.join(everywhere, ["shard", "dims"]).select("body", "ids", "flat")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body, ids, flat in zip(pdf["body"], pdf["ids"], pdf["flat"], strict=True):
                found = best(body, np.asarray(ids, np.int64), np.asarray(flat, float).reshape(len(ids), -1))
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = pairs.mapInPandas(run, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
