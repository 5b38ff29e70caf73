"""Arrow batches of whole documents."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: texts and what is made of them are held by the JVM and by Python.
ROWS = 1000


def bounded(spark: SparkSession, rows: int = ROWS) -> None:
    """Bounds the batches of a session. Queries and the pipeline call it for theirs; operators leave a session's settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
