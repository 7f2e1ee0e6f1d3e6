"""Pages that keep arriving: a file stream, matched against a fixed reference.

A page is one file, and all its lines come together, so grouping within a page needs no state and no watermark. Each micro-batch is
aligned as a table and written under its number; a batch that runs again overwrites its own output, so restarts give no second copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alignment, matching
from ..sources.texts import page_of, verse_lines

FILE = "path string, text string"


def page_stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """path, text of each new text file in the folder, whole."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_batch).load(folder)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def align_pages(pages: DataFrame, index: DataFrame, words: Callable[[Column], Column], cap: int | None = None) -> DataFrame:
    """The records of a table of pages (path, text)."""
    lines = verse_lines(pages.select(page_of().alias("page"), "text"), "page")
    query = matching.with_trigrams(lines.select("page", "line", "text"), words)
    return alignment.align(query, index, cap=cap)


def start(pages: DataFrame, index: DataFrame, words: Callable[[Column], Column], output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Aligns each micro-batch and writes its records below ``output``."""

    def write(batch: DataFrame, number: int) -> None:
        align_pages(batch, index, words).write.mode("overwrite").json(f"{output}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
