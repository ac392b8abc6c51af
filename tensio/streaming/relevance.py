"""The cleaning flow over a stream of post files (Structured Streaming).

Cleaning, matching and scoring are stateless column expressions, so they run unchanged on
a streaming DataFrame.  The "drop repeated texts" step becomes streaming state: with an
event-time column and a watermark, ``dropDuplicatesWithinWatermark`` keeps the first copy
seen and lets Spark evict state older than the watermark; without one, ``dropDuplicates``
keeps every text seen so far in the state store (fine for bounded feeds only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as TY
from pyspark.sql.streaming import StreamingQuery

from tensio.functions.lexicons import PROFILE_V2, ScoreProfile
from tensio.operators.cleaning import relevant_posts


def read_post_stream(spark: SparkSession, path: str, schema: TY.StructType, max_files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files under ``path`` as a stream (schema given, never inferred)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def relevance_stream(
    posts: DataFrame,
    text_col: str,
    profile: ScoreProfile = PROFILE_V2,
    event_time: str | None = None,
    watermark: str = "1 hour",
    dedupe: bool = True,
) -> DataFrame:
    """Streaming: (dedupe) → clean → score → threshold → found terms."""
    if dedupe:
        if event_time:
            posts = posts.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([text_col])
        else:
            posts = posts.dropDuplicates([text_col])
    return relevant_posts(posts, text_col, profile)


def start_parquet_sink(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Append kept posts as Parquet; the checkpoint directory makes restarts exactly-once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
