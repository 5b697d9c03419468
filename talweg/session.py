"""Session settings the engine is written for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def session(app: str = "talweg", master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution.

    ``partitions`` should be 2-3 times the cores of the cluster; AQE coalesces what is too small.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return b.config(map=settings).getOrCreate()


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """At most so many rows in an Arrow batch for the jobs started inside: for rows that are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(most, before) if before > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))
