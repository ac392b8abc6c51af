"""The whole study as file-to-file Spark jobs (what the three original scripts did).

1. ``clean_sources``: each raw source file (by layout) → cleaning flow → ``cleaned_<name>``.
2. ``analyze_platform``: a platform's cleaned files → corpus → weak labels → balance/split →
   classifier → ``sentiment_predictions_<platform>`` and one export per listed class, e.g.
   ``negative_sentiment_predictions_<platform>``.
3. ``combine_class_exports``: the per-platform class exports, tagged with ``Platform``,
   unioned → ``combined_<class>_sentiment_predictions``.
4. ``topic_report``: topic share of a predictions export's ``Text``.

Outputs are CSV directories with a header row (Spark writes one part file per task).
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensio.functions.lexicons import PROFILE_V2, TOPIC_KEYWORDS, TOPIC_LABELS, ScoreProfile
from tensio.functions.text import coerce_numeric
from tensio.operators import cleaning, corpus, sentiment, topics
from tensio.operators.cleaning import CLEAN
from tensio.operators.partitioning import materialize
from tensio.plans.sentiment_flow import SentimentRun, run_sentiment
from tensio.sources import adapters, csv, sinks

LOADERS = {
    "mental_health_twitter": adapters.load_mental_health_twitter,
    "twitter_data_2": adapters.load_twitter_data_2,
    "sentiment_140": lambda spark, path: adapters.load_sentiment_140(spark, path)[:2],
    "reddit_title": adapters.load_reddit_title,
    "reddit_combi": adapters.load_reddit_combi,
}


def cleaned_name(layout: str) -> str:
    return f"cleaned_{layout}"


def predictions_name(platform: str, label: str | None = None) -> str:
    base = f"sentiment_predictions_{platform.lower()}"
    return f"{label}_{base}" if label else base


def clean_sources(
    spark: SparkSession, inputs: Mapping[str, str], out_dir: str, profile: ScoreProfile = PROFILE_V2
) -> dict[str, DataFrame | Exception]:
    """Clean every ``layout -> path``; a failing source is reported and the others go on."""
    results: dict[str, DataFrame | Exception] = {}
    for layout, path in inputs.items():
        try:
            df, text_col = LOADERS[layout](spark, path)
            kept = materialize(adapters.clean_source(df, text_col, profile, keep_row=True))  # cleaned once
            sinks.write_csv(kept.orderBy(adapters.ROW).drop(adapters.ROW), os.path.join(out_dir, cleaned_name(layout)))
            results[layout] = kept.drop(adapters.ROW)
        except (csv.SourceError, KeyError) as e:
            results[layout] = e
    return results


def load_cleaned(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Cleaned files of one platform → texts longer than 10 characters, unioned, NULL
    dropped, repeated cleaned texts removed (earlier file, then earlier row, wins)."""

    def load(s: SparkSession, p: str) -> DataFrame:
        return csv.require_columns(csv.read_csv(s, p), [CLEAN])

    frames = []
    for name, df in csv.read_many(spark, paths, load):
        df = df.select(CLEAN).withColumn("_row", F.monotonically_increasing_id())
        frames.append((os.path.basename(name.rstrip("/")), corpus.min_length(df)))
    combined = corpus.union_sources(frames).dropna(subset=[CLEAN])
    out = corpus.dedupe_cross_source(combined, ["_row"])
    # unique after the dedupe, and independent of how files are packed into tasks
    return out.withColumn("post_key", F.sha2(CLEAN, 256))


def analyze_platform(
    spark: SparkSession,
    cleaned_paths: Sequence[str],
    platform: str,
    out_dir: str,
    lexicon: DataFrame,
    export_classes: Sequence[tuple[int, str]] = ((2, "negative"),),
    split_before_balance: bool = True,
) -> SentimentRun:
    """Label, balance, split, train, evaluate and export predictions for one platform."""
    posts = load_cleaned(spark, cleaned_paths)
    labelled = sentiment.label_posts(posts, lexicon, "post_key")
    run = run_sentiment(labelled, "post_key", split_before_balance=split_before_balance)
    records = materialize(run.predictions)  # scored once, exported several times
    sinks.write_csv(records, os.path.join(out_dir, predictions_name(platform)))
    for cls, label in export_classes:
        sinks.write_class(records, os.path.join(out_dir, predictions_name(platform, label)), "Predicted_Sentiment", cls)
    return run


def combine_class_exports(spark: SparkSession, out_dir: str, platforms: Sequence[str], label: str = "negative") -> DataFrame:
    """Read back each platform's class export, tag it with ``Platform`` and union them."""
    frames = []
    for p in platforms:
        df = csv.read_csv(spark, os.path.join(out_dir, predictions_name(p, label)))
        frames.append(df.withColumn("Platform", F.lit(p)))
    combined = frames[0]
    for df in frames[1:]:
        combined = combined.unionByName(df, allowMissingColumns=True)
    combined = materialize(combined)
    sinks.write_csv(combined, os.path.join(out_dir, f"combined_{label}_sentiment_predictions"))
    return combined


def topic_report(
    spark: SparkSession,
    path: str,
    text_col: str = "Text",
    topic_keywords: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS,
    labels: Mapping[str, str] = TOPIC_LABELS,
) -> DataFrame:
    """Topic share (with display labels) of the texts of a predictions export."""
    return topics.topic_share(csv.read_csv(spark, path), text_col, topic_keywords, labels)


@dataclass
class SourceReport:
    """What is reported of one raw source; every part is a small table."""

    counts: DataFrame  # rows read, after the dedupe and at or above the threshold
    scores: DataFrame  # the score of all deduplicated rows, before the threshold
    preview: DataFrame  # the first three kept rows
    means: DataFrame  # mean term counts of the kept rows
    notes: dict[str, DataFrame]  # what the reader left out, label counts


def source_report(spark: SparkSession, layout: str, path: str, profile: ScoreProfile = PROFILE_V2) -> SourceReport:
    """The report on a raw source: stage counts, scores before the threshold, previews, means,
    and the reader's own notes (skipped lines, rows without a label, label distribution)."""
    notes: dict[str, DataFrame] = {}
    if layout == "sentiment_140":
        df, text_col, notes["skipped_lines"], notes["sentiment"] = adapters.load_sentiment_140(spark, path)
    else:
        df, text_col = LOADERS[layout](spark, path)
    if layout == "reddit_combi":
        unread = csv.resolve_column(csv.read_csv(spark, path, sep=";"), "label", ["label", "class", "category"])
        notes["dropped_rows"] = cleaning.drop_stats(unread.withColumn("label", coerce_numeric("label")), "label")
    if layout in ("reddit_title", "reddit_combi"):
        notes["labels"] = adapters.label_distribution(df, "label", order="count")
    df = materialize(df)  # a multi-line file is one task; the parts below read the copy
    scored = cleaning.score_posts(cleaning.dedupe_first(df, [text_col], [adapters.ROW]), text_col, profile)
    kept = materialize(adapters.clean_source(df, text_col, profile, keep_row=True))
    return SourceReport(
        cleaning.stage_counts(df, text_col, profile),
        cleaning.score_describe(scored),
        cleaning.preview(kept, text_col, [adapters.ROW]),
        cleaning.term_count_means(kept, profile),
        notes,
    )


def clean_report(kept: DataFrame, profile: ScoreProfile = PROFILE_V2) -> tuple[DataFrame, DataFrame]:
    """The summaries printed after cleaning: score description and mean term counts."""
    return cleaning.score_describe(kept), cleaning.term_count_means(kept, profile)
