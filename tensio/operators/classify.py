"""Three-class text classifier trained and applied on the cluster (Spark ML).

The original work trains a recurrent network in one process.  Here the same role — learn
the weak labels from token counts, with class weights, and emit three class probabilities
per post — is played by a Spark ML pipeline: tokenizer → term counts over the bounded
vocabulary → multinomial logistic regression (L-BFGS, gradients tree-aggregated over the
executors).  The numbers differ from a recurrent network's; the record shape is the same.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.functions import text as T
from tensio.functions.lexicons import CLASS_WEIGHTS, MAX_WORDS
from tensio.operators import arrow_text
from tensio.operators.encode import ids_of, vocabulary
from tensio.operators.evaluate import argmax_first
from tensio.operators.partitioning import materialize, share

FEATURES = "_features"
#: How a stored vector says that it is sparse.
SPARSE = 0


def weight_column(label: str, weights: Mapping[int, float]):
    expr = None
    for cls, w in weights.items():
        expr = F.when(F.col(label) == cls, F.lit(float(w))) if expr is None else expr.when(F.col(label) == cls, F.lit(float(w)))
    return expr.otherwise(F.lit(1.0))


def fit_features(train: DataFrame, text_col: str = "cleaned_text", max_words: int = MAX_WORDS) -> PipelineModel:
    """Tokenizer and term counts over the vocabulary of ``train``."""
    # at most max_words - 1 words, with the vocabulary's own tie rule
    words = [r["word"] for r in vocabulary(train, text_col, max_words).orderBy("id").collect()]
    return PipelineModel(
        [
            RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=" ", toLowercase=True),
            CountVectorizerModel.from_vocabulary(words or [""], inputCol="_tokens", outputCol=FEATURES),
        ]
    )


def with_features(features: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` and its term counts, written once: training and prediction read them several times.

    The counts are those of ``features.transform``, made a batch at a time.
    """
    tokenizer, counter = features.stages
    counts = _counts_udf(share(df.sparkSession, pa.array([w for w in counter.vocabulary if w], pa.string())))
    found = df.withColumn("_counts", counts(T.lowercase(tokenizer.getInputCol())))
    vector = F.struct(F.lit(SPARSE).cast("tinyint").alias("type"), F.lit(len(counter.vocabulary)).alias("size"), F.col("_counts.indices"), F.col("_counts.values"))
    schema = TY.StructType([*df.schema.fields, TY.StructField(FEATURES, VectorUDT())])
    return materialize(found.withColumn(FEATURES, vector).drop("_counts"), schema)


def _counts_udf(words):
    @F.arrow_udf("struct<indices: array<int>, values: array<double>>")
    def counts(lowered: pa.Array) -> pa.Array:
        lowered, known = pc.fill_null(lowered, ""), max(len(words.value), 1)
        sizes, places, times = [], [], []
        for start, stop in arrow_text.slices(lowered):
            ids = ids_of(pc.split_pattern(lowered.slice(start, stop - start), " "), words.value)
            owner = np.repeat(np.arange(stop - start), ids.value_lengths().to_numpy())
            cell, n = np.unique(owner * known + ids.flatten().to_numpy() - 1, return_counts=True)
            sizes.append(np.bincount(cell // known, minlength=stop - start))
            places.append(cell % known)
            times.append(n)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([[], *sizes]))]).astype(np.int32))
        indices = pa.array(np.concatenate([[], *places]).astype(np.int32))
        values = pa.array(np.concatenate([[], *times]).astype(np.float64))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, indices), pa.ListArray.from_arrays(ends, values)], names=["indices", "values"])

    return counts


def fit_classifier(
    features: PipelineModel,
    coded: DataFrame,
    label: str = "sentiment",
    weights: Mapping[int, float] = CLASS_WEIGHTS,
    max_iter: int = 20,
    reg_param: float = 0.01,
) -> PipelineModel:
    """Weighted multinomial logistic regression on rows that ``with_features`` coded."""
    data = coded.select(FEATURES, F.col(label).cast("double").alias("_y"), weight_column(label, weights).alias("_w"))
    regression = LogisticRegression(
        featuresCol=FEATURES,
        labelCol="_y",
        weightCol="_w",
        family="multinomial",
        maxIter=max_iter,
        regParam=reg_param,
        probabilityCol="_prob",
        predictionCol="_pred",
        rawPredictionCol="_raw",
    )
    return PipelineModel([*features.stages, regression.fit(data)])


def train_classifier(
    train: DataFrame,
    text_col: str = "cleaned_text",
    label: str = "sentiment",
    weights: Mapping[int, float] = CLASS_WEIGHTS,
    max_words: int = MAX_WORDS,
    max_iter: int = 20,
    reg_param: float = 0.01,
) -> PipelineModel:
    """Fit tokenizer + vocabulary + weighted multinomial logistic regression.

    ``max_iter`` (solver passes over the data) defaults to the original training budget
    of at most 20 epochs.
    """
    features = fit_features(train, text_col, max_words)
    return fit_classifier(features, with_features(features, train), label, weights, max_iter, reg_param)


def predict(model: PipelineModel, df: DataFrame, text_col: str = "cleaned_text") -> DataFrame:
    """Input columns plus ``p0, p1, p2``, ``predicted`` (first max wins) and ``confidence``.

    Rows that ``with_features`` coded keep their term counts, which are left out of the result.
    The classes are 0, 1 and 2 whatever the training rows held: a class above all that the model
    has met has probability 0 (one in between has the model's own, small, probability).
    """
    coded = FEATURES in df.columns
    scored = (model.stages[-1] if coded else model).transform(df).withColumn("_p", vector_to_array("_prob"))
    out = scored.select(*[F.col(f"`{c}`") for c in df.columns if c != FEATURES], *[F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(3)])
    pcols = [F.col("p0"), F.col("p1"), F.col("p2")]
    return out.withColumn("predicted", argmax_first(pcols)).withColumn("confidence", F.greatest(*pcols))
