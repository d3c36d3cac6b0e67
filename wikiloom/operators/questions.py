"""Many questions at once: tables of questions in one plan, instead of a plan for each.

Vectors and questions meet in blocks: a block of questions and a block of vectors are one matrix product, of which the best
few for each question go on. Words meet in blocks too: a block of texts has its terms in order, in which a prefix is a range,
and a question adds up the counts of its prefixes; no row for each word, or for each text of a question, leaves a task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.lexemes import WEIGHT_D, lexemes, query_prefixes
from wikiloom.operators.clustering import matrix_of, unit_rows
from wikiloom.operators.retrieval import CANDIDATES, FINAL_CHUNKS, LEXICAL_WEIGHT, RRF_K, VECTOR_WEIGHT
from wikiloom.plans.session import bound_arrow_batches

#: Rows of a block of vectors, and of questions; bytes of the components of either.
VECTOR_ROWS, QUESTION_ROWS, BLOCK_BYTES = 4096, 512, 8 << 20
#: Texts of a block, and words, about; counts of prefixes that are kept while a block's questions are answered.
TEXT_ROWS, TEXT_WORDS, KEPT_COUNTS = 4096, 1 << 20, 4 << 20
#: No lexeme holds this sign: what begins with a prefix stands before the prefix and it.
LAST_SIGN = "\U0010ffff"


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    own = df.select(F.col(id_col).alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    return own.where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _blocks(df: DataFrame, rows: int, kind: str) -> DataFrame:
    """(dims, ids, flat): runs of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def close(dims: int) -> pa.RecordBatch:
            parts = held.pop(dims)
            ids, flat = pa.concat_arrays([i for i, _ in parts]), np.concatenate([m.ravel() for _, m in parts])
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([flat], pa.list_(pa.float64()))], names=["dims", "ids", "flat"])

        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for dims in np.unique(sizes).tolist():
                limit = max(1, min(rows, BLOCK_BYTES // (8 * dims)))
                own = batch.filter(pa.array(sizes == dims))
                for start in range(0, own.num_rows, limit):
                    cut = own.slice(start, limit)
                    held.setdefault(dims, []).append((cut.column(0), matrix_of(cut.column(1), dims)))
                    if sum(len(i) for i, _ in held[dims]) >= limit:
                        yield close(dims)
        for dims in list(held):
            yield close(dims)

    return df.select("id", "vector", F.size("vector").alias("dims")).mapInArrow(run, f"dims int, ids array<{kind}>, flat array<double>")


def vectors_top_k(vectors: DataFrame, questions: DataFrame, id_col: str = "chunk_id", question_col: str = "question_id", k: int = CANDIDATES, vector_col: str = "embedding") -> DataFrame:
    """(question, id, score, rank): for each question (its id and vector, ids different) the k rows most like it by cosine,
    ties to smaller ids. Vectors meet questions of their own length; those that are null, empty or hold components that are
    null or not finite take no part. A zero vector has the similarity 0."""
    spark = vectors.sparkSession
    bound_arrow_batches(spark)
    kinds = vectors.schema[id_col].dataType.simpleString(), questions.schema[question_col].dataType.simpleString()
    shards = 4 * spark.sparkContext.defaultParallelism
    held = _blocks(_usable(vectors, id_col, vector_col), VECTOR_ROWS, kinds[0]).withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)))
    asked = _blocks(_usable(questions, question_col, vector_col), QUESTION_ROWS, kinds[1]).select("dims", F.col("ids").alias("asked"), F.col("flat").alias("asking"))
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, flat, own, asking in zip(frame["ids"], frame["flat"], frame["asked"], frame["asking"], strict=True):
                rows, queries = (unit_rows(np.asarray(x, float).reshape(n, -1)) for x, n in ((flat, len(ids)), (asking, len(own))))
                order = np.argsort(np.asarray(ids), kind="stable")
                names, score = np.asarray(ids)[order], queries @ rows[order].T
                keep = min(k, len(ids))
                least = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
                q, r = np.nonzero(score >= least[:, None])  # a question's rows by id, so that of ties the first ones are kept
                best = np.lexsort((r, -score[q, r], q))
                q, r = q[best], r[best]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, r = q[place < keep], r[place < keep]
                yield pd.DataFrame({"question": np.asarray(own)[q], "id": names[r], "score": score[q, r]})

    pairs = held.join(everywhere, ["shard", "dims"]).select("ids", "flat", "asked", "asking")
    found = pairs.mapInPandas(run, f"question {kinds[1]}, id {kinds[0]}, score double")
    return _first(found, k).withColumnsRenamed({"question": question_col, "id": id_col})


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def question_prefixes(questions: DataFrame, question_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(question, prefix): the expanded terms of each question, as query_prefixes has them."""

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(query_prefixes(t or ""))) for t in texts])

    return questions.where(F.col(question_col).isNotNull()).select(F.col(question_col).alias("question"), F.explode(terms(F.col(text_col))).alias("prefix"))


def lexical_top_k(texts: DataFrame, questions: DataFrame, id_col: str = "chunk_id", question_col: str = "question_id", k: int = CANDIDATES, text_col: str = "content") -> DataFrame:
    """(question, id, score, rank): for each question (its id and text) the k texts of the highest cover rank, as
    retrieval.lexical_top_k has them for one. A question without usable terms finds nothing."""
    spark = texts.sparkSession
    bound_arrow_batches(spark)
    kinds = texts.schema[id_col].dataType.simpleString(), questions.schema[question_col].dataType.simpleString()
    shards = 4 * spark.sparkContext.defaultParallelism
    own = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"))
    dealt = own.repartition(shards, "shard").sortWithinPartitions("shard", "id").select("shard", "id", lexemes(F.col("text")).alias("words"))
    held = dealt.mapInArrow(_counted, f"shard long, ids array<{kinds[0]}>, terms array<string>, starts array<int>, texts array<int>, counts array<int>")
    sets = question_prefixes(questions, question_col).groupBy("question").agg(F.sort_array(F.collect_set("prefix")).alias("prefixes"))
    asked = sets.mapInArrow(_asked, f"asked array<{kinds[1]}>, prefixes array<array<string>>")
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, terms, starts, at, counts, own, prefixes = (batch.column(m)[n].values for m in range(7))
                terms, starts, at, counts = terms.to_pylist(), *(x.to_numpy(zero_copy_only=False) for x in (starts, at, counts))
                kept: dict[str, np.ndarray] = {}
                which, found, hits = [], [], []

                def counted(p: str) -> np.ndarray:
                    if p not in kept:
                        if len(kept) * len(ids) > KEPT_COUNTS:
                            kept.clear()
                        range_ = slice(starts[bisect_left(terms, p)], starts[bisect_left(terms, p + LAST_SIGN)])
                        kept[p] = np.bincount(at[range_], counts[range_], len(ids)).astype(np.int64)
                    return kept[p]

                for q, mine in enumerate(prefixes.to_pylist()):
                    total, before = np.zeros(len(ids), np.int64), None
                    for p in mine:  # in order: what begins with another prefix follows it, and its lexemes count once
                        if before is None or not p.startswith(before):
                            total += counted(p)
                            before = p
                    least = max(1, -np.partition(-total, k - 1)[k - 1]) if len(total) > k else 1
                    some = np.flatnonzero(total >= least)
                    best = some[np.argsort(-total[some], kind="stable")][:k]  # of equals the first ids
                    which.append(np.full(len(best), q))
                    found.append(best)
                    hits.append(total[best])
                best = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, found, hits)]
                yield pa.RecordBatch.from_arrays([own.take(pa.array(best[0])), ids.take(pa.array(best[1])), pa.array(best[2])], names=["question", "id", "hits"])

    pairs = held.join(everywhere, "shard").select("ids", "terms", "starts", "texts", "counts", "asked", "prefixes")
    found = pairs.mapInArrow(run, f"question {kinds[1]}, id {kinds[0]}, hits long").select("question", "id", (F.col("hits") * F.lit(WEIGHT_D)).alias("score"))
    return _first(found, k).withColumnsRenamed({"question": question_col, "id": id_col})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts (shard, id, words) in order of shard and id: the ids, and by term, in order, the texts' numbers that hold
    it and how often. Rows of one id are one text and stay in one block."""
    held: list[pa.RecordBatch] = []
    rows = words = 0
    last = None

    def close() -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        named = block.column(1).dictionary_encode()
        own, sizes = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), block.column(2).value_lengths().to_numpy(zero_copy_only=False)
        said = block.column(2).flatten().dictionary_encode()
        order = pc.sort_indices(said.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs, counts = np.unique(place[said.indices.to_numpy(zero_copy_only=False)] * len(named.dictionary) + np.repeat(own, sizes), return_counts=True)
        terms, texts = np.divmod(pairs, max(1, len(named.dictionary)))
        starts = np.searchsorted(terms, np.arange(len(order) + 1))
        ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([block.column(0).slice(0, 1), whole(named.dictionary), whole(said.dictionary.take(pa.array(order)).cast(pa.string())), ints(starts), ints(texts), ints(counts)], names=["shard", "ids", "terms", "starts", "texts", "counts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        shard, ids = batch.column(0).to_numpy(), batch.column(1)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(shard)].tolist(), strict=True):
            own = batch.slice(start, end - start)
            if held and last[0] != shard[start]:
                yield close()
                held, rows, words = [], 0, 0
            elif held and (rows >= TEXT_ROWS or words >= TEXT_WORDS):
                same = pc.equal(own.column(1), last[1]).to_numpy(zero_copy_only=False)
                n = len(same) if same.all() else int(np.argmin(same))
                held += [own.slice(0, n)] if n else []
                own = own.slice(n)
                if own.num_rows:
                    yield close()
                    held, rows, words = [], 0, 0
            if own.num_rows:
                held.append(own)
                rows, words = rows + own.num_rows, words + pc.sum(own.column(2).value_lengths()).as_py()
            last = shard[start], ids[end - 1]
    if held:
        yield close()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of questions (id, prefixes)."""
    for batch in batches:
        for start in range(0, batch.num_rows, QUESTION_ROWS):
            own = batch.slice(start, QUESTION_ROWS)
            whole = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), pa.concat_arrays([c])) for c in own.columns]
            yield pa.RecordBatch.from_arrays(whole, names=["asked", "prefixes"])


def hybrid_chunks(chunks: DataFrame, embeddings: DataFrame, pages: DataFrame, questions: DataFrame, k: int = FINAL_CHUNKS) -> DataFrame:
    """retrieval.hybrid_chunks for a table (question_id, question, embedding): question_id, rank, chunk_id, page_id, title,
    content, rrf, vector_rank, lexical_rank. A null vector leaves the words, a question without terms the vector."""
    placed = chunks.join(pages.select("page_id"), "page_id", "left_semi")
    near = vectors_top_k(embeddings.join(placed.select("chunk_id"), "chunk_id", "left_semi"), questions)
    said = lexical_top_k(placed, questions)
    part = lambda rows, weight, name: rows.select("question_id", "chunk_id", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"), F.col("rank").alias(name))
    both = part(near, VECTOR_WEIGHT, "vector_rank").unionByName(part(said, LEXICAL_WEIGHT, "lexical_rank"), allowMissingColumns=True)
    fused = both.groupBy("question_id", "chunk_id").agg(F.sum("part").alias("rrf"), F.min("vector_rank").alias("vector_rank"), F.min("lexical_rank").alias("lexical_rank"))
    order = Window.partitionBy("question_id").orderBy(F.col("rrf").desc(), F.col("vector_rank").asc_nulls_last(), "lexical_rank", "chunk_id")
    best = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(chunks.select("chunk_id", "page_id", "content"), "chunk_id").join(pages.select("page_id", "title"), "page_id").select("question_id", "rank", "chunk_id", "page_id", "title", "content", "rrf", "vector_rank", "lexical_rank")
