"""The stored tables as the knowledge base sees them.

pages: page_id, title, host (as the space), url, html, content. chunks: four consecutive documents are the chunks of a
page. embeddings: by chunk. edges: pages of one host refer to the next page of that host. attachments: documents as
files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import host, plain_title, token_estimate
from wikiloom.sources.tables import read_table

CHUNKS_PER_PAGE = 4
#: Page ids of a run of a host's pages.
EDGE_RUN = 4096


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select("page_id", plain_title(F.col("html")).alias("title"), host(F.col("url")).alias("space"), "url", "html")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.floor(F.col("doc_id") / CHUNKS_PER_PAGE).alias("page_id"),
        (F.col("doc_id") % CHUNKS_PER_PAGE).cast("int").alias("chunk_index"),
        F.col("text").alias("content"),
        F.col("lang").alias("chunk_type"),
        F.col("n_chars").alias("character_count"),
        token_estimate(F.col("text")).alias("token_count"),
    )


def text_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Plain-text pages: one for each document, titled by its first six words."""
    docs = read_table(spark, folder, "documents")
    title = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    return docs.select(F.col("doc_id").alias("page_id"), title.alias("title"), F.col("source").alias("space"), F.col("text").alias("content"))


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Each page of a host refers to the host's next page. A host's pages are ordered run by run of EDGE_RUN ids, and only the
    runs' first pages all together, so that a large host isn't sorted in one task."""
    own = read_table(spark, folder, "pages").select("page_id", host(F.col("url")).alias("space")).withColumn("run", F.floor(F.col("page_id") / EDGE_RUN))
    inside = own.withColumn("next", F.lead("page_id").over(Window.partitionBy("space", "run").orderBy("page_id")))
    firsts = own.groupBy("space", "run").agg(F.min("page_id").alias("first"))
    after = firsts.select("space", "run", F.lead("first").over(Window.partitionBy("space").orderBy("run")).alias("after"))
    linked = inside.join(after, ["space", "run"]).withColumn("target_page_id", F.coalesce("next", "after"))
    return linked.select(F.col("page_id").alias("source_page_id"), "target_page_id", F.lit("references").alias("relationship_type")).where("target_page_id IS NOT NULL")


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return docs.select(F.concat(F.lit("att:"), F.col("doc_id")).alias("external_id"), F.floor(F.col("doc_id") / CHUNKS_PER_PAGE).alias("page_id"), F.concat(F.col("lang"), F.lit("-"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".pdf").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".png")).alias("file_name"), F.col("n_chars").alias("file_size"), "text")
