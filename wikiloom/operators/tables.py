"""Changes of stored tables as set operations. Parquet has no in-place change: each gives the new table to write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wikiloom.functions.vectors import stored_vector


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: Column, kept: tuple[str, ...] = ()) -> DataFrame:
    """old and new rows by key, the one of the highest version wins, at a draw the new one; the columns ``kept`` (id,
    created_at) stay the old row's."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    per_key = Window.partitionBy(*keys)
    last = both.withColumn("__rank", F.row_number().over(per_key.orderBy(version.desc_nulls_last(), F.col("__new").desc())))
    for c in kept:
        first = F.first(F.when(F.col("__new") == 0, F.col(c)), ignorenulls=True).over(per_key.orderBy("__new").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        last = last.withColumn(c, F.coalesce(first, F.col(c)))
    return last.where("__rank = 1").drop("__rank", "__new")


def replace_children(old: DataFrame, new: DataFrame, parent: str, order: str, parents: DataFrame | None = None) -> DataFrame:
    """All children of the parents in ``new`` give way to the new ones, whose ordinals start at 0 again. ``parents``: the
    parents that were written again, those without children among them, whose old ones go."""
    renumbered = new.withColumn(order, F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1)
    written = new.select(parent) if parents is None else new.select(parent).union(parents.select(parent))
    return old.join(written.distinct(), parent, "left_anti").unionByName(renumbered)


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, embedding, model, created_at): the new embedding of a chunk wins, stored in single precision, with the
    time of this run. Of several new ones of a chunk one counts, the greatest."""
    once = new.groupBy("chunk_id").agg(F.max(F.struct("embedding", "model")).alias("e")).select("chunk_id", stored_vector(F.col("e.embedding")).alias("embedding"), "e.model")
    kept = old.join(once.select("chunk_id"), "chunk_id", "left_anti").withColumn("embedding", stored_vector(F.col("embedding")))
    return kept.unionByName(once.withColumn("created_at", F.current_timestamp().cast(old.schema["created_at"].dataType)))


def set_page_embeddings(pages: DataFrame, vectors: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages with new embeddings (key, embedding), one for each key, where there are some; others keep theirs."""
    fresh = vectors.select(key, stored_vector(F.col("embedding")).alias("__new"))
    old = F.col("embedding") if "embedding" in pages.columns else F.lit(None).cast("array<float>")
    return pages.join(fresh, key, "left").withColumn("embedding", F.coalesce("__new", stored_vector(old))).drop("__new")


def upsert_attachments(old: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """Attachments by external_id, the new version wins; their page's id is looked up by its key, null without a page."""
    known = pages.select(F.col("external_id").alias("page_external_id"), "page_id").dropDuplicates(["page_external_id"])
    placed = new.drop("page_id").join(known, "page_external_id", "left")
    return upsert_latest(old, placed, ["external_id"], F.col("version"), ("id",) if "id" in old.columns else ())


def delete_stale(existing: DataFrame, keep: DataFrame, parent: str, key: str) -> DataFrame:
    """What stays of each parent's children: those in the keep list; an empty list keeps none."""
    return existing.join(keep.select(parent, key).distinct(), [parent, key], "left_semi")


def stale(existing: DataFrame, keep: DataFrame, parent: str, key: str) -> DataFrame:
    """What delete_stale removes."""
    return existing.join(keep.select(parent, key).distinct(), [parent, key], "left_anti")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def set_bytes(attachments: DataFrame, contents: DataFrame, key: str, column: str = "file_data") -> DataFrame:
    """New bytes where there are some, else the old ones."""
    fresh = contents.select(key, F.col(column).alias("__new"))
    return attachments.join(fresh, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def add_edges(edges: DataFrame, new: DataFrame, kind: str = "references") -> DataFrame:
    """Links between pages, each once; new ones have the given type unless they bring their own."""
    typed = new if "relationship_type" in new.columns else new.withColumn("relationship_type", F.lit(kind))
    return edges.unionByName(typed).dropDuplicates(["source_page_id", "target_page_id", "relationship_type"])


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks without an embedding."""
    return chunks.join(embeddings.where(F.col("embedding").isNotNull()).select(key), key, "left_anti")


def backfill(chunks: DataFrame, embeddings: DataFrame, embed: Column, model: str) -> DataFrame:
    """The rows to append to ``embeddings``: ``embed`` over the content of each pending chunk."""
    return pending_embeddings(chunks, embeddings).select("chunk_id", embed.alias("embedding"), F.lit(model).alias("model"))


def reprocess(pages: DataFrame, stored: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stored`` chunks (id, chunk_index, ...) with those of ``pages`` (id, title, text) cut anew: ``cut`` is the chunker.
    A page that gives no chunks any more loses its old ones."""
    return stored.join(pages.select("id").distinct(), "id", "left_anti").unionByName(cut(pages), allowMissingColumns=True)


def sync_log(spark: SparkSession, kind: str, status: str, processed: int, failed: int, error: str | None = None) -> DataFrame:
    """One row for the log of runs."""
    row = spark.createDataFrame([(kind, status, processed, failed, error)], "sync_type string, status string, items_processed int, items_failed int, error_message string")
    return row.withColumn("metadata", F.to_json(F.struct(F.current_timestamp().alias("timestamp")))).withColumn("completed_at", F.current_timestamp())
