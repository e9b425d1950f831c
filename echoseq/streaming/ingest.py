"""Beyond the reference: arriving path lists are indexed by Structured Streaming, one batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import run_index


def ingest(spark: SparkSession, arriving: str, directory: str, checkpoint: str, decoder: Callable | None = None, fps: float = 1.0) -> StreamingQuery:
    """JSON lines {"path": ...} that arrive in a folder become indexed videos. A batch that is run again
    registers nothing twice, since registration ignores known paths."""
    stream = spark.readStream.schema("path string").json(arriving)

    def batch(paths: DataFrame, _: int) -> None:
        run_index(paths.sparkSession, directory, fps=fps, decoder=decoder, paths=paths)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
