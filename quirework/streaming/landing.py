"""Documents that arrive as files. An extension: documents are independent, so no state is kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def paragraphs_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def run(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch through ``transform`` into Parquet, under the batch's number, so a batch that is run again replaces
    its own rows; ends when nothing is left."""

    def write(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by window and type; rows later than ``late`` behind the newest are left out of a stream's windows."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")
