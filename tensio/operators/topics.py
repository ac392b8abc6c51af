"""Topic share: whole-word keyword hits per topic, their percentage, display labels.

The keyword dictionary is small and fixed by the caller (tens of words), so it is
broadcast; tokens are pre-filtered with an ``IN`` set before the join, and the
``groupBy(topic)`` is combined map-side, so the only shuffle carries one partial count
per topic per task no matter how many texts there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensio.functions import text as T
from tensio.functions.lexicons import TOPIC_KEYWORDS, TOPIC_LABELS
from tensio.operators.partitioning import materialize


def keyword_table(spark: SparkSession, topics: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS) -> DataFrame:
    """``(topic, topic_pos, keyword)``; a keyword listed twice in one topic counts once."""
    rows = []
    for pos, (topic, words) in enumerate(topics.items()):
        for w in dict.fromkeys(words):
            rows.append((topic, pos, w))
    return spark.createDataFrame(rows, "topic string, topic_pos int, keyword string")


def topic_table(spark: SparkSession, topics: Mapping[str, Sequence[str]], labels: Mapping[str, str]) -> DataFrame:
    rows = [(t, pos, labels.get(t)) for pos, t in enumerate(topics)]
    return spark.createDataFrame(rows, "topic string, topic_pos int, display_name string")


def keyword_hits(df: DataFrame, text_col: str, topics: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS) -> DataFrame:
    """One row per (token occurrence, topic) for tokens that are topic keywords.

    NULL texts contribute nothing.
    """
    spark = df.sparkSession
    vocab = sorted({w for words in topics.values() for w in words})
    tokens = df.select(F.explode(T.tokenize_words(text_col)).alias("token")).filter(F.col("token").isin(vocab))
    kw = keyword_table(spark, topics)
    return tokens.join(F.broadcast(kw), tokens["token"] == kw["keyword"]).select("topic", "topic_pos", "keyword")


def topic_keyword_counts(df: DataFrame, text_col: str, topics: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS) -> DataFrame:
    """Hits per (topic, keyword): the keyword bag as counts."""
    return keyword_hits(df, text_col, topics).groupBy("topic", "keyword").agg(F.count(F.lit(1)).alias("hits"))


def keyword_bag(df: DataFrame, text_col: str, order: Sequence[str], topics: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS) -> DataFrame:
    """``topic, ordinal, keyword``: every hit of a topic, repeats included, in the order of the rows
    (``order``, NULL first) and of the words within a row; ``ordinal`` runs from 1 in each topic.

    No list is collected: the hits are dealt to ranges of (topic, order, place), ordered within
    each, and numbered from the hits of the ranges before, so a topic of any size is spread over
    as many tasks as its hits need.  The ordered hits are written once.
    """
    spark = df.sparkSession
    vocab = sorted({w for words in topics.values() for w in words})
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)], F.posexplode(T.tokenize_words(text_col)).alias("_place", "keyword"))
    hits = rows.where(F.col("keyword").isin(vocab)).join(F.broadcast(keyword_table(spark, topics)), "keyword").select("topic", *keys, "_place", "keyword")
    ranged = hits.repartitionByRange("topic", *keys, "_place").sortWithinPartitions("topic", *keys, "_place")
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(ranged.select("topic", "keyword", F.spark_partition_id().alias("_range"), within.alias("_at")))
    # One row for each topic of each range.
    sums = placed.groupBy("_range", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()
    starts, met = [], {}
    for r in sorted(sums, key=lambda r: r["_range"]):
        starts.append((r["_range"], r["topic"], met.get(r["topic"], 0) - r["first"] + 1))
        met[r["topic"]] = met.get(r["topic"], 0) + r["n"]
    offsets = spark.createDataFrame(starts, "_range int, topic string, _offset long")
    return placed.join(F.broadcast(offsets), ["_range", "topic"]).select("topic", (F.col("_at") + F.col("_offset")).alias("ordinal"), "keyword")


def topic_share(
    df: DataFrame,
    text_col: str,
    topics: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS,
    labels: Mapping[str, str] = TOPIC_LABELS,
) -> DataFrame:
    """``topic, label, hits, pct, display`` sorted by share (ties in dictionary order).

    Every topic of the dictionary appears, zero-hit ones with ``hits = 0``.  When there is
    no hit at all ``pct`` is NULL for every topic (instead of a division by zero).
    """
    spark = df.sparkSession
    counts = keyword_hits(df, text_col, topics).groupBy("topic").agg(F.count(F.lit(1)).alias("hits"))
    all_topics = topic_table(spark, topics, labels)
    # both sides hold at most one row per topic
    out = all_topics.join(F.broadcast(counts), "topic", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    total = F.sum("hits").over(Window.partitionBy())
    pct = F.when(total > 0, (F.col("hits") / total) * F.lit(100.0))
    label = F.coalesce(F.col("display_name"), F.col("topic"))
    return (
        out.withColumn("pct", pct)
        .withColumn("label", label)
        .withColumn("display", T.percent_label(label, F.col("pct")))
        .orderBy(F.desc_nulls_last("pct"), "topic_pos")
        .select("topic", "label", F.col("hits").cast("long").alias("hits"), "pct", "display")
    )
