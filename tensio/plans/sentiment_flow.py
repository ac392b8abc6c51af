"""Label → balance → split → train → evaluate → predict, per platform.

``split_before_balance=True`` (default) splits the labelled corpus first and balances only
the training fold, so no copy of a test post is trained on.  ``False`` follows the
original order (balance with copies, then split), which lets copies of one post land in
both folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensio.functions.lexicons import RANDOM_SEED, TEST_FRACTION
from tensio.operators import classify, evaluate, grouped_classifier, sampling, sentiment
from tensio.operators.cleaning import CLEAN
from tensio.operators.partitioning import materialize


@dataclass
class SentimentRun:
    model: PipelineModel
    test: DataFrame  # test fold with p0..p2, predicted, confidence
    predictions: DataFrame  # prediction records for every post of the balanced training data and the test fold
    report: DataFrame  # classification report on the test fold
    accuracy: DataFrame  # share of the test fold that is right, one row
    classes: DataFrame  # rows per class before and after balancing


def _row_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("row_key", F.concat(F.col(key).cast("string"), F.lit(":"), F.col("replica").cast("string")))


def run_sentiment(
    labelled: DataFrame,
    key: str,
    label: str = "sentiment",
    split_before_balance: bool = True,
    test_fraction: float = TEST_FRACTION,
    seed: int = RANDOM_SEED,
) -> SentimentRun:
    """``labelled`` holds ``key``, ``cleaned_text`` and the weak ``label``."""
    base = materialize(labelled.select(key, CLEAN, label))
    if split_before_balance:
        split = materialize(sampling.stratified_split(base.withColumn("_k", F.col(key).cast("string")), label, "_k", test_fraction, seed))
        train = materialize(sampling.balance_classes(split.filter(F.col("fold") == "train"), label, key, seed))
        rows = train.unionByName(split.filter(F.col("fold") == "test").withColumn("replica", F.lit(1)))
    else:
        bal = materialize(_row_key(sampling.balance_classes(base, label, key, seed), key))
        split = materialize(sampling.stratified_split(bal, label, "row_key", test_fraction, seed))
        train = split.filter(F.col("fold") == "train")
        rows = split
    features = classify.fit_features(train, CLEAN)
    coded = classify.with_features(features, rows)  # the training passes and both predictions read it
    model = classify.fit_classifier(features, coded.filter(F.col("fold") == "train"), label)
    test_pred = classify.predict(model, coded.filter(F.col("fold") == "test"))
    all_pred = classify.predict(model, coded.drop("fold"))
    records = evaluate.prediction_record(all_pred, CLEAN, ["p0", "p1", "p2"])
    report = evaluate.classification_report(test_pred, label, "predicted")
    accuracy = evaluate.accuracy(test_pred, label, "predicted")
    before = sentiment.class_histogram(base, label).withColumnRenamed("n", "before")
    after = sentiment.class_histogram(train if split_before_balance else bal, label).withColumnRenamed("n", "after")
    classes = before.join(after.withColumnRenamed(label, "_c"), F.col(label).eqNullSafe(F.col("_c")), "left").drop("_c")
    return SentimentRun(model, test_pred, records, report, accuracy, classes)


@dataclass
class PlatformRun:
    model: grouped_classifier.GroupedModel
    test: DataFrame  # test folds with platform, p0..p2, predicted, confidence
    predictions: DataFrame  # prediction records with Platform: balanced training rows and test folds
    accuracy: DataFrame  # platform, test_rows, accuracy
    train: DataFrame  # the balanced training rows


def run_platforms(labelled: DataFrame, key: str, platform: str = "platform", label: str = "sentiment", test_fraction: float = TEST_FRACTION, seed: int = RANDOM_SEED) -> PlatformRun:
    """Split, balance, train, predict and evaluate every platform, all of them by the same jobs.

    As in the original, the test fold also decides when training stops and which weights stay.
    ``labelled`` holds ``platform``, ``key`` (unique within it), ``cleaned_text`` and the weak ``label``.
    """
    base = materialize(labelled.select(platform, key, CLEAN, label))
    split = materialize(sampling.split_groups(base, platform, label, key, test_fraction, seed))
    train = materialize(sampling.balance_groups(split.where("fold = 'train'").drop("fold"), platform, label, key, seed))
    test = split.where("fold = 'test'").drop("fold").withColumn("replica", F.lit(1))
    rows = train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True)))
    coded = grouped_classifier.code(rows, platform, CLEAN, label, "held_out")
    model = grouped_classifier.fit(coded, label, "held_out")
    scored = materialize(grouped_classifier.predict(model, coded.rows, platform, CLEAN))
    tested = scored.where("held_out").drop("held_out")
    records = scored.select(F.col(platform).alias("Platform"), CLEAN, "p0", "p1", "p2")
    named = evaluate.prediction_record(records, CLEAN, ["p0", "p1", "p2"], keep=["Platform"])
    right = F.avg((F.col(label) == F.col("predicted")).cast("double"))
    accuracy = tested.groupBy(platform).agg(F.count(F.lit(1)).alias("test_rows"), right.alias("accuracy"))
    return PlatformRun(model, tested, named, accuracy, train)
