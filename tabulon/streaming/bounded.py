"""The dataflow over a folder that still receives files: each run takes what is new, then stops.

Inputs of the engine are bounded, so there are no watermarks or windows here; a run
with the trigger availableNow is the streaming form of a bounded merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_new_files(spark: SparkSession, folder: str, schema, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> int:
    """Apply step to the Parquet files that came since the last run and append the result; returns the rows read."""
    frame = step(spark.readStream.schema(schema).parquet(folder))
    q = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)
