"""Recurring synchronisation as streams: new files only, each batch replaces its pages' chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wikiloom.operators.chunker import ChunkOptions, chunks
from wikiloom.operators.tables import sync_log

#: Buckets of a sink unless it is given others.
BUCKETS = 64


def hourly(events: DataFrame, late: str = "2 hours", hours: int = 1) -> DataFrame:
    """Events by hour and kind: count, sum and mean of value; late events within the watermark still count."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", f"{hours} hours").alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "events", "total")


def latest_in_stream(changes: DataFrame, key: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One change for each key and time within the watermark, for sources that deliver twice."""
    return changes.withWatermark(time, late).dropDuplicatesWithinWatermark([key, time])


def newer_versions(changes: DataFrame, key: str = "id", version: str = "version", forget_ms: int | None = None) -> DataFrame:
    """Of a stream's rows those whose version is above every version of their key that went before, whatever batch it was
    in; of several in a batch the newest, of equals one.

    The state of a key is its version, a whole number; null is the least. ``forget_ms``: a key without news for so long is
    forgotten, and its next row counts whatever its version. Rows without a key are dropped.
    """
    least = -(1 << 63)
    names = changes.columns

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        best, row = None, None
        for frame in frames:
            own = [least if pd.isna(v) else int(v) for v in frame[version]]
            at = max(range(len(own)), key=own.__getitem__)
            if best is None or own[at] > best:
                best, row = own[at], frame.iloc[[at]]
        if row is not None and (held is None or best > held):
            state.update((best,))
            yield row[names]
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)

    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return changes.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(step, changes.schema, "version long", "append", timeout)


def start_ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, options: ChunkOptions | None = None, after: Callable[[DataFrame, int], None] | None = None, version: str | None = None, buckets: int = BUCKETS, log: str | None = None) -> StreamingQuery:
    """Chunk the pages (id, title, text) of files that weren't seen before and replace these pages' chunks in ``sink``.

    The sink is partitioned by a bucket of page ids; a batch rewrites the buckets it touches, so a page's chunks change
    together. A batch's buckets are written beside the sink first: if replacing them breaks off, the batch that is tried
    again starts from what was written, not from a sink that is half replaced. A bucket whose pages have all become empty
    is removed. ``buckets`` stays the same for a sink: so
    many that one fits a task. ``checkpoint`` makes each file count once; ``after(chunks, batch)`` is a hook for
    embedding. ``log``: a table to which each batch adds its row of the sync log, one that fails too.

    Of several rows of a page in a batch the last written counts: that of the latest file (by modification time, then
    path), and in it the last row. With ``version``, a column of ``schema``, that of the greatest version counts, null
    being the least; the chunks keep that column, and a page older than its chunks in the sink is left out. A page
    whose text gives no chunks leaves no version there.
    """
    written = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("__written")
    stream = spark.readStream.schema(schema).parquet(source).select("*", written)
    return ingest(stream, sink, checkpoint, options, after, version, buckets, log)


def ingest(stream: DataFrame, sink: str, checkpoint: str, options: ChunkOptions | None = None, after: Callable[[DataFrame, int], None] | None = None, version: str | None = None, buckets: int = BUCKETS, log: str | None = None) -> StreamingQuery:
    """start_ingest for any stream of pages (id, title, text). Of several rows of a page in a batch that of the greatest
    version counts, or else of the greatest __written, if the stream has that column. Where ``newer_versions`` has gone
    over the stream, no version is needed here, and the sink isn't read for the versions that it has."""
    spark = stream.sparkSession
    order = [F.col(c).desc_nulls_last() for c in ([version] if version else []) + [c for c in ("__written",) if c in stream.columns]]
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets))

    def prepare(batch: DataFrame, pending: str) -> None:
        pages = batch.where("id IS NOT NULL")
        pages = pages.withColumn("__number", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("__number = 1").drop("__number") if order else pages.dropDuplicates(["id"])
        pages = pages.drop("__written")
        there = _exists(spark, sink)
        if version and there:
            held = spark.read.schema(f"id {pages.schema['id'].dataType.simpleString()}, {version} {pages.schema[version].dataType.simpleString()}").parquet(sink)
            held = held.groupBy("id").agg(F.max(version).alias("__held"))
            pages = pages.join(held, "id", "left").where(F.col("__held").isNull() | (F.col(version) >= F.col("__held"))).drop("__held")
        new = chunks(pages, options)
        if version:
            new = new.join(pages.select("id", version), "id")
        out = new = new.withColumn("bucket", bucket)
        # The buckets that the batch touches, and how many pages it has in each: written once, for the log too.
        touched = pages.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pages"))
        touched.write.mode("overwrite").parquet(f"{pending}-touched")
        if there:
            old = spark.read.schema(new.schema).parquet(sink)
            out = new.unionByName(old.join(touched.select("bucket"), "bucket", "left_semi").join(pages.select("id"), "id", "left_anti"))
        out.write.mode("overwrite").parquet(pending)

    def replace(batch: DataFrame, number: int) -> None:
        pending = f"{sink.rstrip('/')}-pending/{number}"
        try:
            if not _exists(spark, f"{pending}/_SUCCESS"):
                prepare(batch, pending)
            staged = spark.read.parquet(pending)
            staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(sink)
            # An overwrite leaves partitions without new rows as they are.
            emptied = spark.read.parquet(f"{pending}-touched").join(staged.select("bucket").distinct(), "bucket", "left_anti")
            for row in emptied.collect():  # a row a bucket at most
                _delete(spark, f"{sink.rstrip('/')}/bucket={row['bucket']}")
            if after:
                after(staged.drop("bucket"), number)
            _note("completed", _pages(pending), 0)
        except Exception as e:
            _note("failed", 0, _pages(pending), str(e)[:1000])
            raise
        _delete(spark, pending)
        _delete(spark, f"{pending}-touched")

    def _pages(pending: str) -> int:
        """How many pages a batch has, of the table that it wrote first; 0 if it didn't come that far."""
        there = _exists(spark, f"{pending}-touched/_SUCCESS")
        return (spark.read.parquet(f"{pending}-touched").agg(F.sum("pages")).first()[0] or 0) if there else 0

    def _note(status: str, processed: int, failed: int, error: str | None = None) -> None:
        if log:
            sync_log(spark, "incremental", status, processed, failed, error).write.mode("append").parquet(log)

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)
