"""Score files as they arrive: the batch scoring call applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.score import score_rows
from ..sources.artifacts import load_artifacts


def score_stream(stream: DataFrame, model_dir: str, output: str, checkpoint: str, clean: bool = False) -> StreamingQuery:
    """Write one parquet folder per micro-batch; a repeated batch replaces its own folder."""
    artifacts = load_artifacts(stream.sparkSession, model_dir)

    def write(batch: DataFrame, number: int) -> None:
        score_rows(batch, artifacts, clean).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
