"""Image files as a stream: files are read once, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tectra.sources.rasters import image_pixels

#: The image source's schema.
SCHEMA = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def image_stream(spark: SparkSession, path: str, pattern: str = "*.png", files_per_batch: int = 1000) -> DataFrame:
    """(origin, height, width, channels, data) of new files below path; unreadable ones are skipped."""
    stream = spark.readStream.format("image").schema(SCHEMA).option("dropInvalid", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def statistics(decoded: DataFrame) -> DataFrame:
    """(origin, pixels, lo, hi, mean) of the gray values of decoded files."""
    gray = F.round(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r"))
    return image_pixels(decoded).withColumn("v", gray).groupBy("origin").agg(F.count(F.lit(1)).alias("pixels"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))


def write_statistics(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*.png") -> StreamingQuery:
    """Appends the statistics of what has arrived to the Parquet table out, then ends.  A file's pixels lie
    in one batch, so each batch is aggregated by itself and no state is kept; a batch that is run again
    replaces its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        statistics(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return image_stream(spark, path, pattern).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
