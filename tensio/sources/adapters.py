"""Adapters for the five source layouts: read, normalise columns, then the cleaning flow.

Each ``load_*`` returns ``(DataFrame, text column)`` with an ``_row`` order column (the
position in the file, used for "first row wins"); ``clean_source`` runs the cleaning flow
on it.  The position comes from the reader: the split a record starts in and its place there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.functions.lexicons import NO_QUERY, PROFILE_V2, SENTIMENT140_MAP, ScoreProfile
from tensio.functions.text import coerce_numeric, parse_post_time, sentinel_replace, value_map
from tensio.operators.cleaning import clean_dataset
from tensio.sources.csv import SourceError, read_csv, read_csv_tolerant, require_columns, resolve_column

ROW = "_row"

SENTIMENT140_SCHEMA = TY.StructType(
    [
        TY.StructField("sentiment", TY.IntegerType()),
        TY.StructField("id", TY.LongType()),
        TY.StructField("timestamp", TY.StringType()),
        TY.StructField("query", TY.StringType()),
        TY.StructField("username", TY.StringType()),
        TY.StructField("text", TY.StringType()),
    ]
)


def load_mental_health_twitter(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    df = resolve_column(read_csv(spark, path, position=ROW), "text", ["text"])
    return df, "text"


def load_twitter_data_2(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    df = require_columns(read_csv(spark, path, sep=";", position=ROW), ["text"])
    return df, "text"


def load_sentiment_140(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1"
) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """Headerless 6-column layout; returns ``(rows, 'text', report, stats)``.

    ``report`` (one row): lines skipped for too many fields.  ``stats`` (one row): rows
    dropped for missing text, positive and negative counts.
    """
    rows, report = read_csv_tolerant(spark, path, SENTIMENT140_SCHEMA, sep=",", encoding=encoding, position=ROW)
    rows = rows.withColumn("sentiment", value_map("sentiment", SENTIMENT140_MAP))
    # the text stays beside the parsed time, so a form that does not parse is not lost
    rows = rows.withColumn("timestamp_text", F.col("timestamp")).withColumn("timestamp", parse_post_time("timestamp"))
    kept = rows.dropna(subset=["text"]).withColumn("query", sentinel_replace("query", NO_QUERY, ""))
    stats = rows.agg(
        F.count_if(F.col("text").isNull()).alias("dropped_missing_text"),
        F.count_if(F.col("text").isNotNull() & (F.col("sentiment") == 1)).alias("positive"),
        F.count_if(F.col("text").isNotNull() & (F.col("sentiment") == 0)).alias("negative"),
    )
    return kept, "text", report, stats


def load_reddit_title(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    df = resolve_column(read_csv(spark, path, sep=";", position=ROW), "title", ["title"])
    df = require_columns(df, ["label"]).withColumn("label", coerce_numeric("label"))
    return df, "title"


def load_reddit_combi(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    df = resolve_column(read_csv(spark, path, sep=";", position=ROW), "Body_Title", ["body_title", "bodytitle", "body"])
    df = resolve_column(df, "label", ["label", "class", "category"])
    df = df.withColumn("label", coerce_numeric("label")).dropna(subset=["label"])
    return df, "Body_Title"


def label_distribution(df: DataFrame, label: str = "label", order: str = "value") -> DataFrame:
    """Counts per label value, NULL left out; sorted by value (``order="value"``) or by
    count, largest first, ties by value (``order="count"``)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if order == "count":
        return counts.orderBy(F.desc("n"), label)
    return counts.orderBy(label)


def clean_source(df: DataFrame, text_col: str, profile: ScoreProfile = PROFILE_V2, keep_row: bool = False) -> DataFrame:
    """The cleaning flow on an adapter's output: in file order, or with the ``_row`` order column."""
    if text_col not in df.columns:
        raise SourceError(f"no text column {text_col!r}")
    cleaned = clean_dataset(df, text_col, [ROW], profile)
    return cleaned if keep_row else cleaned.orderBy(ROW).drop(ROW)
