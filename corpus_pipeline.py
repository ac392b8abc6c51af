"""The corpus pipeline: operators of ``tensio.llm`` applied one after the other to ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``; other
columns are carried along.  Empty tables, NULL or empty texts and repeated rows go through as
each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensio.llm import decontaminate, packing, quality, queries, simhash, substrings
from tensio.llm.batches import staged
from tensio.sources.tables import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, scores at its threshold or more."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, name="__quality").where(F.col("__quality") >= quality.THRESHOLD).drop("__quality")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints the document with the smallest id."""
    return simhash.representatives(docs, size=simhash.SHINGLE_WORDS, most=simhash.MAX_BITS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows, the kept words joined by one space; a
    text that loses nothing stays as it is.  ``n_chars`` follows the text."""
    found = substrings.drop_repeated(docs, keep_text=True, names=("__kept", "__words", "__gone"))
    text = F.when(F.col("__gone") > 0, F.col("__kept")).otherwise(F.col("text"))
    changed = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), queries.END_ID)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier, tokenizers and alignment are not SQL: the rows are tested by brute force.
ORACLE_SQL = None

QUERIES = {**queries.QUERIES, "pipeline": run}
SQL = {**queries.ORACLE, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
