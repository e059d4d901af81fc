"""Resolution of streams: the batch plan for each micro-batch, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.plans.resolver import EntityResolver


def resolve_stream(
    resolver: EntityResolver, stream: DataFrame, path: str, checkpoint: str, prompt="prompt", locale="locale", available_now: bool = True
) -> StreamingQuery:
    """Resolves each micro-batch with the batch plan and writes its matches under `path`, a folder per batch, so that a
    batch that is run again replaces what it wrote. A report depends on its row alone: no state, no watermark."""

    def write(batch: DataFrame, batch_id: int) -> None:
        resolver.matches(batch, prompt, locale).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def entity_windows(matches: DataFrame, time: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Matches per entity and time window. On a stream, `late` says how long a window waits for rows."""
    df = matches.withWatermark(time, late) if late else matches
    return df.groupBy(F.window(time, width).alias("w"), "canonical_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "canonical_id", "n")
