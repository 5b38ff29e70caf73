"""New manifest files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def manifest_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Rows of parquet manifests as they arrive in a folder, with the time they were taken in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("taken", F.current_timestamp())


def first_of_content(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each content once within the delay, after which its state is dropped."""
    return stream.withWatermark("taken", delay).dropDuplicatesWithinWatermark(["sha256"])


def write_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, appended to a parquet table, exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
