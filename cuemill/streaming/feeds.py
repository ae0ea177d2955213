"""Streams: SRT files dropped into a folder, late and repeated records of a ledger, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuemill.sources.srt import parse_tolerant


def dropped_srt(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """Cues of every SRT file that arrives; stateless, so each file is parsed once."""
    files = spark.readStream.option("maxFilesPerTrigger", most_files).option("pathGlobFilter", "*.srt").text(folder, wholetext=True)
    return parse_tolerant(files.select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def ledger_stream(records: DataFrame, at: str = "scored_at", lateness: str = "7 days") -> DataFrame:
    """Each run of the ledger once, however often and late it arrives within the lateness."""
    return records.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["evaluator_run_id", "retry_index"])


def scores_by_time(records: DataFrame, at: str = "scored_at", lateness: str = "7 days", window: str = "1 day") -> DataFrame:
    """Mean score and count of each dimension in windows that close as the watermark passes."""
    slot = F.window(at, window)
    valid = records.where("valid").withWatermark(at, lateness)
    return valid.groupBy(slot, "dimension").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).select(F.col("window.start").alias("slot"), "dimension", "n", "mean")


def write_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands every micro-batch to ``write`` and ends when what is there is done."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
