"""Intermediate tables in the folder that driver and executors share.

A table written here cuts the lineage: a lost executor costs the tasks it ran, not the whole history, and a result
that two later steps need is computed once. The folder is ``spark.checkpoint.dir``; only where a session has none
(tests, a notebook on one machine) a temporary folder is set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A task that writes holds a row group in memory.
ROW_GROUP_BYTES = 32 << 20
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wikiloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for files that no table holds; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/wikiloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return path


def shared_table(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back; removed when the driver's Python ends. ``by``: columns that
    partition the files."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(*(by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Remove the files of a table that no later step reads."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/wikiloom/" in f}:
        for kept in [x for x in _written if file.endswith(x[1].split(":", 1)[-1].lstrip("/"))]:
            _remove(*kept)
            _written.remove(kept)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended
            return
