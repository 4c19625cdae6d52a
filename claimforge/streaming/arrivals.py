"""The batch transforms over pages that keep arriving.

The reference has no streaming; this wraps the same functions: every micro-batch is profiled and appended once per page, late and repeated pages included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimforge.functions import text as T


def profile(pages: DataFrame) -> DataFrame:
    url = F.col("final_url")
    return pages.select("page_id", "retrieved_at", T.host(url).alias("host"), T.source_type(url, F.col("title")).alias("source_type"), T.people_page(url).alias("people_page"))


def read_pages(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(folder)


def profile_stream(pages: DataFrame, out: str, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """Appends the profile of every page once, whichever batch repeats it within the delay."""
    once = profile(pages).withWatermark("retrieved_at", delay).dropDuplicatesWithinWatermark(["page_id"])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_by_day(pages: DataFrame, out: str, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """Pages per day of retrieval and source type, emitted once a day is beyond the delay."""
    daily = profile(pages).withWatermark("retrieved_at", delay).groupBy(F.window("retrieved_at", "1 day").alias("day"), "source_type").count()
    shown = daily.select(F.col("day.start").alias("day"), "source_type", "count")
    return shown.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
