"""Composite flows over the test tables, shared by several queries.

* ``documents`` / ``conversations`` / ``benchmark`` play the role of the platforms' posts;
* the labelled corpus is ``prepare_corpus`` → lexicon labels; balancing, the split, the
  classifier and the reports build on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensio.functions.lexicons import RANDOM_SEED
from tensio.operators import corpus, encode, evaluate, sampling, sentiment
from tensio.operators.cleaning import CLEAN
from tensio.operators.partitioning import materialize, spread_for_cpu
from tensio.plans.demo import demo_lexicon
from tensio.sources.tables import read_table


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table, spread over the cores when the scan yields too few tasks."""
    return spread_for_cpu(read_table(spark, sf_dir, name))


def platform_posts(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """The three post tables with a common ``(k1, k2)`` row order and ``text``."""
    docs = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"), "text")
    conv = texts(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k1"), F.col("turn").alias("k2"), "text")
    bench = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k1"), F.lit(0).cast("long").alias("k2"), "text")
    return [("documents", docs), ("conversations", conv), ("benchmark", bench)]


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, cleaned_text``: cleaned, longer than 10 characters, cleaned-text dedupe."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    prepared = corpus.prepare_corpus([("documents", docs)], "text", ["doc_id"])
    return prepared.select("doc_id", CLEAN)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus plus ``polarity, subjectivity, lexicon_hits, sentiment`` (demo lexicon)."""
    return sentiment.label_posts(document_corpus(spark, sf_dir), demo_lexicon(spark), "doc_id")


def labelled_corpus_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled corpus written once; balancing and splitting read it several times."""
    lab = labelled_documents(spark, sf_dir).select("doc_id", CLEAN, "sentiment")
    return materialize(lab)


def balanced_documents(spark: SparkSession, sf_dir: str, seed: int = RANDOM_SEED) -> DataFrame:
    """Labelled corpus balanced to the median class; ``row_key`` = ``doc_id:replica``."""
    lab = labelled_corpus_stage(spark, sf_dir)
    bal = sampling.balance_classes(lab, "sentiment", "doc_id", seed=seed)
    return bal.withColumn("row_key", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("replica").cast("string")))


# Stand-in classifier output for the evaluation operators: three positive weights per row
# from the row key, normalised to sum 1.  Multipliers/offsets are arbitrary constants.
_STANDIN = [(31, 7), (57, 3), (89, 11)]


def standin_probabilities(df: DataFrame, key: str) -> DataFrame:
    """Add ``p0, p1, p2`` derived from an integer row key (input for the evaluation queries)."""
    weights = [((F.col(key) * a + b) % 97 + 1) for a, b in _STANDIN]
    total = weights[0] + weights[1] + weights[2]
    return df.select("*", *[(w / total).alias(f"p{i}") for i, w in enumerate(weights)])


def balanced_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced corpus with stand-in probabilities and the prediction record columns."""
    bal = standin_probabilities(balanced_documents(spark, sf_dir), "doc_id")
    p = [F.col("p0"), F.col("p1"), F.col("p2")]
    return bal.withColumn("predicted", evaluate.argmax_first(p)).withColumn("confidence", F.greatest(*p))


def platform_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records (stand-in probabilities) for the three platforms, with ``Platform``."""
    out = None
    tables = dict(platform_posts(spark, sf_dir))
    for name, key_expr in (("documents", F.col("k1")), ("conversations", F.col("k1") * 1000 + F.col("k2")), ("benchmark", F.col("k1"))):
        posts = tables[name]
        prepared = corpus.prepare_corpus([(name, posts)], "text", ["k1", "k2"]).withColumn("_key", key_expr)
        rec = evaluate.prediction_record(standin_probabilities(prepared, "_key"), CLEAN, ["p0", "p1", "p2"])
        rec = rec.withColumn("Platform", F.lit(name))
        out = rec if out is None else out.unionByName(rec)
    return out


def labelled_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``platform, key, cleaned_text, sentiment`` of all three platforms, each prepared by itself."""
    out = None
    for name, posts in platform_posts(spark, sf_dir):
        prepared = corpus.prepare_corpus([(name, posts)], "text", ["k1", "k2"])
        keyed = prepared.select(F.lit(name).alias("platform"), F.concat_ws(":", F.lit(name), "k1", "k2").alias("key"), CLEAN)
        out = keyed if out is None else out.unionByName(keyed)
    return sentiment.label_posts(out, demo_lexicon(spark), "key").select("platform", "key", CLEAN, "sentiment")


def training_history(spark: SparkSession, model) -> DataFrame:
    """One row for each platform and pass."""
    rows = [(g, n, a, v, b) for g, n, a, v, b in model.history]
    return spark.createDataFrame(rows, "platform string, pass int, train_loss double, validation_loss double, best_so_far boolean")


def encoded_documents(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Corpus with ``seq`` (token ids over the corpus vocabulary); the corpus is written
    once because both the vocabulary fit and the encoding read it."""
    corp = materialize(document_corpus(spark, sf_dir))
    vocab = encode.vocabulary(corp, CLEAN)
    return encode.sequences(corp, CLEAN, vocab, limit=limit)
