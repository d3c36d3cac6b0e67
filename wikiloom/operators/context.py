"""Context: token windows, neighbours, summaries, statistics, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Results depend on them.
WINDOW_TOKENS, NEIGHBOUR_LENGTH, HISTORY_TURNS = 4000, 100, 6


def context_window(chunks: DataFrame, max_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """The chunks of each page that fit its budget, in order, up to the first that doesn't."""
    upto = F.sum("token_count").over(Window.partitionBy("page_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("tokens_used", upto).where(F.col("tokens_used") <= max_tokens)


def window_totals(chunks: DataFrame, max_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """tokens_used, tokens_available and chunks_included of each page, pages whose first chunk is too long too."""
    fits = F.col("upto") <= max_tokens
    running = chunks.withColumn("upto", F.sum("token_count").over(Window.partitionBy("page_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)))
    used = F.coalesce(F.sum(F.when(fits, F.col("token_count"))), F.lit(0)).cast("long")
    return running.groupBy("page_id").agg(used.alias("tokens_used"), F.count(F.when(fits, True)).alias("chunks_included")).withColumn("tokens_available", F.lit(max_tokens) - F.col("tokens_used"))


def neighbour_context(chunks: DataFrame, title: Column) -> DataFrame:
    """Each chunk with the heads of its neighbours as one line."""
    order = Window.partitionBy("page_id").orderBy("chunk_index")
    head = lambda c, name: F.concat(F.lit(f"{name}: "), F.substring(c, 1, NEIGHBOUR_LENGTH), F.lit("..."))
    line = F.concat_ws(" | ", head(F.lag("content").over(order), "Previous"), F.concat(F.lit("Title: "), title), head(F.lead("content").over(order), "Next"))
    return chunks.withColumn("context", line)


def page_summary(pages: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each page's number of chunks, tokens and characters, its kinds of chunks in order of appearance, its links."""
    kinds = chunks.groupBy("page_id", "chunk_type").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"), F.sum("character_count").alias("c"), F.min("chunk_index").alias("first"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "chunk_type"))), lambda x: x["chunk_type"]), ",")
    summed = kinds.groupBy("page_id").agg(F.sum("n").alias("chunks"), F.sum("t").alias("tokens"), F.sum("c").alias("characters"), listed.alias("kinds"))
    linked = edges.join(pages.select(F.col("page_id").alias("target_page_id")), "target_page_id", "left_semi").groupBy(F.col("source_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("related"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pages.select("page_id", "title").join(summed, "page_id", "left").join(linked, "page_id", "left").select("page_id", "title", *(zero(c) for c in ("chunks", "tokens", "characters", "related")), F.coalesce("kinds", F.lit("")).alias("kinds"))


def related_pages(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets of each page's links that exist, by type of link."""
    return edges.join(pages.select(F.col("page_id").alias("target_page_id"), "title"), "target_page_id").select("source_page_id", "relationship_type", "target_page_id", "title")


def linked_context(edges: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each page's linked pages with what they hold: titles and numbers of chunks and tokens, one hop away."""
    held = chunks.groupBy(F.col("page_id").alias("target_page_id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    return related_pages(edges, pages).join(held, "target_page_id", "left").select("source_page_id", "target_page_id", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def ai_statistics(pages: DataFrame, chunks: DataFrame, embeddings: DataFrame, synced: str = "last_synced") -> DataFrame:
    """One row: pages, chunks, tokens, embeddings and last_sync, the latest of the pages' column ``synced``.

    Each table gives one row, and these are put side by side.
    """
    one = pages.agg(F.count(F.lit(1)).alias("pages"), F.max(synced).alias("last_sync"))
    two = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    three = embeddings.where("embedding IS NOT NULL").agg(F.count(F.lit(1)).alias("embeddings"))
    return one.crossJoin(two).crossJoin(three)


def last_turns(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The last turns of each conversation that a person or the assistant said."""
    said = turns.where(F.col("role").isin("user", "assistant") & (F.col("text") != ""))
    return said.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).where(F.col("back") <= n)
