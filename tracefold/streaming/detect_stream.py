"""Detection over a stream of documents. Copies that arrive within the watermark are looked at once; people are resolved in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracefold.operators import detect
from tracefold.operators.profile import Profile


def hits(stream: DataFrame, late: str = "1 day", profile: Profile | None = None, as_of: str = "2026-01-01") -> DataFrame:
    """Hits of a stream with doc_id, text and ingested_at. Equal texts within ``late`` count once."""
    once = stream.withColumn("_digest", F.sha2("text", 256)).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["_digest"])
    return detect.detect(once.select("doc_id", "ingested_at", "text"), profile=profile, as_of=as_of)


def counts(found: DataFrame, window: str = "1 day") -> DataFrame:
    """Hits by day of arrival and category; days close when the watermark has passed them."""
    return found.groupBy(F.window("ingested_at", window).alias("w"), "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("since"), "category", "n")


def write(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until all that is there has been read."""
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
