"""Prediction records, confusion matrix and the per-class classification report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensio.functions.lexicons import CLASS_NAMES
from tensio.functions.numeric import round_places

REPORT_DIGITS = 6


def argmax_first(probs: Sequence[Column]) -> Column:
    """Index of the largest probability; the first one wins on ties."""
    arr = F.array(*probs)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def prediction_record(df: DataFrame, text: str, probs: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``Text, Predicted_Sentiment, Confidence_Score`` and the three named probabilities, behind the
    columns ``keep``."""
    p = [F.col(c) for c in probs]
    return df.select(
        *keep,
        F.col(text).alias("Text"),
        argmax_first(p).alias("Predicted_Sentiment"),
        F.greatest(*p).alias("Confidence_Score"),
        p[0].alias("Positive_Probability"),
        p[1].alias("Neutral_Probability"),
        p[2].alias("Negative_Probability"),
    )


def class_grid(spark, num_classes: int = len(CLASS_NAMES)) -> DataFrame:
    """All (true, predicted) pairs of the fixed class domain."""
    pairs = [(t, p) for t in range(num_classes) for p in range(num_classes)]
    return spark.createDataFrame(pairs, "y_true int, y_pred int")


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, num_classes: int = len(CLASS_NAMES)) -> DataFrame:
    """Counts for every (true, predicted) pair of the class domain, zeros included.

    Pairs outside the domain (other labels, NULL) that occur have rows of their own, so the
    counts always sum to the rows of ``df``.
    """
    counts = df.groupBy(F.col(y_true).cast("int").alias("y_true"), F.col(y_pred).cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zeros = class_grid(df.sparkSession, num_classes).withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(zeros).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def accuracy(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"))


def classification_report(
    df: DataFrame, y_true: str, y_pred: str, names: Sequence[str] = CLASS_NAMES, digits: int = REPORT_DIGITS
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted avg.

    Empty denominators give 0.  Everything is computed from one pass of conditional
    counts (the input is reduced to one row before any arithmetic).
    """
    k = len(names)
    yt, yp = F.col(y_true), F.col(y_pred)
    aggs = []
    for c in range(k):
        aggs += [
            F.count_if((yt == c) & (yp == c)).alias(f"tp{c}"),
            F.count_if((yt != c) & (yp == c)).alias(f"fp{c}"),
            F.count_if((yt == c) & (yp != c)).alias(f"fn{c}"),
        ]
    aggs.append(F.count(F.lit(1)).alias("total"))
    row = df.agg(*aggs)

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))

    def entry(label: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            p.cast("double").alias("precision"),
            r.cast("double").alias("recall"),
            f.cast("double").alias("f1_score"),
            support.cast("long").alias("support"),
        )

    total = F.col("total")
    prec, rec, f1, sup = [], [], [], []
    for c in range(k):
        tp, fp, fn = F.col(f"tp{c}"), F.col(f"fp{c}"), F.col(f"fn{c}")
        prec.append(ratio(tp, tp + fp))
        rec.append(ratio(tp, tp + fn))
        f1.append(ratio(2 * tp, 2 * tp + fp + fn))
        sup.append(tp + fn)

    def mean(vals: list[Column]) -> Column:
        acc = vals[0]
        for v in vals[1:]:
            acc = acc + v
        return acc / F.lit(float(k))

    def weighted(vals: list[Column]) -> Column:
        acc = vals[0] * sup[0]
        for v, s_ in zip(vals[1:], sup[1:]):
            acc = acc + v * s_
        return ratio(acc, total)

    correct = F.col("tp0")
    for c in range(1, k):
        correct = correct + F.col(f"tp{c}")
    entries = [entry(names[c], prec[c], rec[c], f1[c], sup[c]) for c in range(k)]
    entries += [
        entry("accuracy", F.lit(None), F.lit(None), ratio(correct, total), total),
        entry("macro avg", mean(prec), mean(rec), mean(f1), total),
        entry("weighted avg", weighted(prec), weighted(rec), weighted(f1), total),
    ]
    out = row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
    return out.select(
        "label",
        round_places("precision", digits).alias("precision"),
        round_places("recall", digits).alias("recall"),
        round_places("f1_score", digits).alias("f1_score"),
        "support",
    )
