"""Sources of a mirrored wiki: paged listings, files with their bytes, and the text that files hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wikiloom.operators.blocks import page_text
from wikiloom.sources.docx import docx_text

# Fixed values.
PAGE_LIMIT, ATTACHMENT_LIMIT, LARGEST_FILE, LEAST_TEXT = 50, 100, 26_214_400, 20
PDF_TYPES = ("application/pdf",)
WORD_TYPES = ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)
TEXT_TYPES = ("text/plain", "text/markdown", "text/csv", "application/json")
TEXT_ENDINGS = (".txt", ".md", ".csv", ".json")

#: fetch(offset, limit) -> list of (id, title, space, url, html); the network client is the caller's.
Fetch = Callable[[int, int], list[tuple[str, str, str, str, str]]]


class WikiPages(DataSource):
    """``spark.read.format("wiki_pages")``: one task for each listing page of a wiki; options total, limit, fetch.

    fetch: "module:function", imported on the executors. ``total``, the size that the wiki tells, deals the listing over
    tasks; the last one goes on until a listing page isn't full, so pages that were added meanwhile, and wikis that tell
    no size, are read whole. A failed request fails its task, which is tried again: no listing is cut short in silence.
    """

    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        own = "external_id string, title string, space string, url string, html string"
        return f"{own}, modified long" if "changes" in self.options else own

    def reader(self, schema) -> DataSourceReader:
        return WikiReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WikiChanges(self.options)


def follow(fetch: Callable[[int, int], list], offset: int, limit: int) -> Iterator[tuple]:
    """The rows of a listing from ``offset`` on, up to a page of it that isn't full."""
    while True:
        rows = fetch(offset, limit)
        yield from rows
        if len(rows) < limit:
            return
        offset += limit


def imported(name: str) -> Callable:
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class WikiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where, self.total, self.limit = options["fetch"], int(options.get("total", 0)), int(options.get("limit", PAGE_LIMIT))

    def partitions(self) -> list[InputPartition]:
        starts = range(0, max(self.total, 1), self.limit)
        return [InputPartition((offset, offset == starts[-1])) for offset in starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset, last = partition.value
        fetch = imported(self.where)
        yield from follow(fetch, offset, self.limit) if last else fetch(offset, self.limit)


class WikiChanges(DataSourceStreamReader):
    """The pages that a wiki changed: each batch those from the time where the batch before ended up to the newest change.

    Times are whole numbers that never go down (milliseconds, say). newest: "module:function" of (), the time of the newest
    change, None without any; changes: "module:function" of (from, before, offset, limit), the changed pages (with their
    time last) of that span in a fixed order. ``settle``: so much before the newest change a batch ends, where a wiki may
    still add changes of times that have been; ``tasks``: a batch's span is cut into so many. A batch that is tried again
    asks for its span again; Spark's checkpoint holds where it ended.
    """

    def __init__(self, options: dict):
        self.changes, self.newest, self.limit = options["changes"], options["newest"], int(options.get("limit", PAGE_LIMIT))
        self.start, self.settle, self.tasks = int(options.get("from", 0)), int(options.get("settle", 0)), int(options.get("tasks", 4))

    def initialOffset(self) -> dict:
        return {"before": self.start}

    def latestOffset(self) -> dict:
        newest = imported(self.newest)()
        return {"before": self.start if newest is None else max(self.start, newest + 1 - self.settle)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, stop = start["before"], end["before"]
        cuts = sorted({first + (stop - first) * i // self.tasks for i in range(self.tasks + 1)})
        return [InputPartition(span) for span in pairwise(cuts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        changes = imported(self.changes)
        yield from follow(lambda offset, limit: changes(*partition.value, offset, limit), 0, self.limit)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


def follow_wiki(spark: SparkSession, changes: str, newest: str, **options: int) -> DataFrame:
    """A stream of (external_id, title, space, url, html, modified); see WikiChanges for the options."""
    spark.dataSource.register(WikiPages)
    return spark.readStream.format("wiki_pages").options(changes=changes, newest=newest, **{k: str(v) for k, v in options.items()}).load()


def read_wiki(spark: SparkSession, fetch: str, total: int = 0, limit: int = PAGE_LIMIT) -> DataFrame:
    spark.dataSource.register(WikiPages)
    return spark.read.format("wiki_pages").options(fetch=fetch, total=str(total), limit=str(limit)).load()


def list_attachments(pages: DataFrame, fetch: str, limit: int = ATTACHMENT_LIMIT) -> DataFrame:
    """The attachments of each page (external_id): page_external_id, external_id, file_name, media_type, file_size, version,
    download_url.

    fetch: "module:function" of (page's id, offset, limit), the rest of these columns for each; a page's listing is read to
    its end, page by page. A failed request fails its task: a listing cut short would make stale deletion remove the rest.
    """
    names = ["external_id", "file_name", "media_type", "file_size", "version", "download_url"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = imported(fetch)
        for frame in frames:
            for page in frame["external_id"]:
                rows = list(follow(lambda offset, n, page=page: get(page, offset, n), 0, limit))
                if rows:
                    yield pd.DataFrame({"page_external_id": [page] * len(rows)} | {n: [r[i] for r in rows] for i, n in enumerate(names)})

    schema = "page_external_id string, external_id string, file_name string, media_type string, file_size long, version int, download_url string"
    return pages.select(F.col("external_id").cast("string").alias("external_id")).where("external_id IS NOT NULL").mapInPandas(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their bytes, those beyond the largest stored size without."""
    return spark.read.format("binaryFile").load(path).withColumn("content", F.when(F.col("length") <= LARGEST_FILE, F.col("content")))


def media_class(media_type: Column, name: Column) -> Column:
    """pdf, docx, html, text or unsupported: by type, or else by the name's ending (markup by type only)."""
    kind, low = F.lower(F.coalesce(media_type, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    ends = F.lit(False)
    for e in TEXT_ENDINGS:
        ends = ends | low.endswith(e)
    return (
        F.when(kind.isin(*PDF_TYPES) | low.endswith(".pdf"), "pdf")
        .when(kind.isin(*WORD_TYPES) | low.endswith(".docx"), "docx")
        .when(kind.isin("text/html"), "html")
        .when(kind.isin(*TEXT_TYPES) | ends, "text")
        .otherwise("unsupported")
    )


def is_extractable(media_type: Column, name: Column) -> Column:
    return media_class(media_type, name) != "unsupported"


def extract_text(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``files`` (media_type, file_name, content) with text and kind. Text is decoded in the JVM; markup and docx are read in
    batches; readers for pdf, or in place of these, are the caller's; a kind without a reader, or a file that
    its reader can't read, gives ''."""
    kind = media_class(F.col("media_type"), F.col("file_name"))
    known = files.withColumn("kind", kind).withColumn("text", F.when(kind == "text", F.decode("content", "UTF-8")).otherwise(""))
    own = {"html": lambda data: page_text(data.decode("utf-8", "replace")), "docx": docx_text} | (readers or {})

    @F.pandas_udf("string")
    def read(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        def one(k: str, data: bytes | None) -> str:
            try:
                return own[k](bytes(data)) if k in own and data is not None else ""
            except Exception:
                return ""

        return pd.Series([one(k, c) for k, c in zip(kinds, contents, strict=True)])

    wanted = F.col("kind").isin(*own)
    return known.withColumn("text", F.when(wanted, read("kind", F.when(wanted, F.col("content")))).otherwise(F.col("text")))


def attachment_pages(attachments: DataFrame, pages: DataFrame) -> DataFrame:
    """Attachments with enough text as pages of their own, titled after their page and themselves."""
    named = attachments.join(pages.select("page_id", "title", "space"), "page_id").where(F.length("text") >= LEAST_TEXT)
    return named.select(F.concat(F.lit("att:"), "external_id").alias("external_id"), F.concat_ws(" – ", "title", "file_name").alias("title"), "space", F.col("text").alias("content"))


def stored_bytes(attachments: DataFrame, external_id: str) -> DataFrame:
    """(file_data, media_type, redirect) of one attachment; the address to go to if its bytes aren't stored."""
    return attachments.where(F.col("external_id") == external_id).select("file_data", "media_type", F.when(F.col("file_data").isNull(), F.coalesce("download_url", "web_url")).alias("redirect"))
