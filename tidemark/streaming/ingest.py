"""Continuous ingestion: captured records stream in, every batch is merged."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import RECORD
from tidemark.sources.store import Store


def read_sightings(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A folder of JSON records with ``seq`` and ``seen_at``."""
    return spark.readStream.schema(RECORD + ", seq long, seen_at timestamp").option("maxFilesPerTrigger", files).json(path)


def ingest(stream: DataFrame, store: Store, checkpoint: str, today: date, once: bool = True) -> StreamingQuery:
    """Merges every batch into the store's listings.  A batch that is repeated
    after a failure changes nothing but the moments it was seen."""

    def batch(df: DataFrame, number: int) -> None:
        store.ingest(df, today)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def resightings(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each ad once within the watermark."""
    s = stream.withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", delay)
    return s.dropDuplicatesWithinWatermark(["source", "url"])
