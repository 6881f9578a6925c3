"""Fragment counts over a stream: each micro-batch is folded into a stored table of sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.fragments import parse_lines, tile_counts


def stream_tile_counts(lines: DataFrame, width: int, out: str, checkpoint: str) -> StreamingQuery:
    """Write the tile counts of every micro-batch under its own id, so a batch that is run again replaces itself; ``total_counts`` adds them up."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        tile_counts(parse_lines(batch), width).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("chrom", "tile", "barcode").agg(F.sum("val").alias("val"))


def windowed_counts(events: DataFrame, ts: str, length: str, late: str) -> DataFrame:
    """``(start, key, n)`` of tumbling windows with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), "key").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")
