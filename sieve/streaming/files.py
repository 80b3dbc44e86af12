"""Files that arrive over time, run through the batch functions: an extension, as the batch jobs need no stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, path: str, schema: str, checkpoint: str, batch: Callable[[DataFrame, int], None], kind: str = "json") -> None:
    """Hands each micro-batch of files not seen yet to ``batch`` and stops when none is left.

    ``checkpoint`` must be in the shared folder.  A batch that failed comes again with the same number, so ``batch``
    should be idempotent, as key-wise upserts are.
    """
    stream = spark.readStream.schema(schema).format(kind).load(path)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
