"""Rows that one Arrow batch of texts holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING, DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", 1_000


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Spark's own 10,000 rows are tens of MB of text in the JVM and as much again in each Python worker, more
    where texts are long.  Where the session still has that default, batches of texts get
    ``ROWS`` rows; a value that the user has set stays."""
    spark = spark or SparkSession.active()
    if spark.conf.get(SETTING, DEFAULT) == DEFAULT:
        spark.conf.set(SETTING, str(ROWS))
