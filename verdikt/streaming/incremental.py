"""Resumable runs: only examples without a finished artifact are scored.

The counterpart of a resumed run and of the append-only verdict cache.  New
records arrive as files; a stream with an available-now trigger folds them into
the store batch by batch, so a restarted job continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(examples: DataFrame, finished: DataFrame, key: str = "example_id") -> DataFrame:
    """Examples that still need work."""
    return examples.join(finished.select(key).distinct(), key, "left_anti")


def fold_new_files(spark: SparkSession, inbox: str, schema: str, store: str, checkpoint: str,
                   score: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process every file that arrived since the last call and append the result.

    Each micro-batch writes to its own folder under ``store`` in overwrite mode,
    so a batch repeated after a failure replaces itself instead of duplicating.
    """
    def write(batch: DataFrame, number: int) -> None:
        out = batch if score is None else score(batch)
        out.write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(schema).json(inbox)
    run = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()


def running_coverage(store: DataFrame) -> DataFrame:
    """Per-rubric totals over everything folded so far."""
    return store.groupBy("rubric_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("satisfied").cast("bigint")).alias("coverage_count")
    )
