"""A session with the settings that the plans of this package expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Arrow batches have about so many bytes at most: each running task holds a few in the JVM and in Python.
ARROW_BATCH_BYTES = 8 << 20


def build_session(master: str = "local[*]", app: str = "wikiloom", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans, skew joins and Arrow; ``conf`` overrides or adds settings."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_arrow_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to ARROW_BATCH_BYTES; a lower one, in bytes, stays.

    The setting stays for the session: plans are run later than they are made. It changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BATCH_BYTES:
        spark.conf.set(name, str(ARROW_BATCH_BYTES))
