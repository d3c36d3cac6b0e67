"""Tables laid out for lookups by key, as database indexes serve them: Parquet in order of one key, so that a lookup reads
the row groups whose range holds it, with Bloom filters for others, so that it reads the row groups that may hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 8 << 20


def write_keyed(df: DataFrame, path: str, order: str, hashed: tuple[str, ...] = (), distinct: int = 1_000_000, row_group: int = ROW_GROUP_BYTES) -> DataFrame:
    """Write ``df`` in order of the column ``order``, with Bloom filters for the columns ``hashed``, made for so many
    ``distinct`` values in a row group; the table as it is read back. Nulls are kept, and no lookup finds them."""
    writer = df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("parquet.block.size", row_group)
    for c in hashed:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(table: DataFrame, **equals: object) -> DataFrame:
    """The rows in which these columns have these values: plain conditions, which reach the Parquet reader."""
    found = table
    for name, value in equals.items():
        found = found.where(F.col(name) == F.lit(value))
    return found


def open_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
