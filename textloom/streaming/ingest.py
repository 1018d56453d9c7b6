"""Documents as a stream: files that arrive in a folder are read once each, and their statistics kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import report
from textloom.sources.files import blocks, read_documents

_FILE = "path string, modificationTime timestamp, length long, content binary"


def documents(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of documents from the files of a folder."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return read_documents(files)


def write_stats(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Statistics of every document, in one folder per batch; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        report.stats(blocks(batch), "path").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_counts(stream: DataFrame) -> DataFrame:
    """Running counts of words over all documents of a stream (complete output mode)."""
    words = report.words(blocks(stream), merge_possessive=True)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
