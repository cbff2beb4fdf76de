"""Resuming a batch as a stream: new input files are answered once, whatever happens in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Answer all Parquet files under source that have not been answered, append the answers to sink, and stop.

    The checkpoint remembers which files are done. A batch that is repeated after a failure overwrites its own folder, so answers come once.
    """

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
