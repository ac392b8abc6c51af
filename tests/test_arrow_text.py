"""Cleaning and coding by the batch: the column expressions' results, each text cleaned and coded once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensio.functions import text as T
from tensio.operators import arrow_text, classify, cleaning, corpus, encode, grouped_classifier, sentiment
from tensio.plans import catalog, flows, sentiment_flow

from conftest import SF001
from test_round3 import posts

PIECES = ["a", "B", " ", "  ", "\t", "\n", "\x1c", "\x85", "\xa0", " ", "　", "é", "İ", "K", "1", "'", "!", "\\", "]", "http", "www", "HTTP://x.y ", "\U0001f600"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(n)] + [None, "", " ", "www", "http ", "a  "]


@pytest.mark.parametrize("most", [1, 60, 1 << 20])
def test_batches_equal_the_column_expressions(spark, monkeypatch, most):
    monkeypatch.setattr(arrow_text.slices, "__defaults__", (most,))
    rows = [(i, t) for i, t in enumerate(texts(1500, 3))]
    df = spark.createDataFrame(rows, "id int, x string").select("id", T.lowercase("x").alias("low"), T.clean_text("x").alias("c"), T.keras_tokens("x").alias("k"))
    want = df.orderBy("id").toArrow().combine_chunks()
    low = want.column("low").chunk(0)
    assert arrow_text.clean(low).to_pylist() == want.column("c").to_pylist()
    assert arrow_text.clean(low.slice(7, 90)).to_pylist() == want.column("c").to_pylist()[7:97]
    assert [[w for w in r if w] for r in arrow_text.keras_words(low).to_pylist()] == [r or [] for r in want.column("k").to_pylist()]
    assert arrow_text.clean(pa.array([], pa.string())).to_pylist() == []


def test_clean_batches_keep_columns(spark):
    df = spark.createDataFrame([(i, {"m": i}, t) for i, t in enumerate(texts(60, 5))], "`k.1` int, m map<string,int>, x string").repartition(3)
    got = {r[1]: (r[0], r[2]) for r in corpus.clean_batches(df, "x", ["k.1", "m"]).collect()}
    want = {r[0]: (r[3], r[1]) for r in cleaning.with_clean_text(df, "x").collect()}
    assert got == want


def test_word_counts_and_vocabularies_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(encode, "COUNTED_BYTES", 40)
    rng = random.Random(8)
    rows = [(rng.randrange(3), " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randint(0, 9)))) for _ in range(200)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, t string").repartition(5)
    want = {}
    for g, t in rows:
        for w in (t or "").split():
            want[g, w] = want.get((g, w), 0) + 1
    assert {(r.g, r.word): r.n for r in encode.keras_word_counts(df, "t", "g").collect()} == want
    for most in (1, 4, 7, 100):
        got = grouped_classifier.group_vocabularies(df, "g", "t", most)
        for g in range(3):
            assert got.get(g, []) == sorted((w for h, w in want if h == g), key=lambda w: (-want[g, w], w))[: most - 1]


def test_coded_rows_score_as_their_texts(spark):
    df = posts(spark, {"a": 120, "b": 40}).withColumn("held", F.crc32("key") % 4 == 0).unionByName(
        spark.createDataFrame([("b", "b:x", None, 1, True), ("c", "c:1", "w1 w2", 0, True), ("a", "a:x", "w1", None, False)], "platform string, key string, cleaned_text string, sentiment int, held boolean")
    )
    coded = grouped_classifier.code(df, "platform", "cleaned_text", "sentiment", "held")
    model = grouped_classifier.fit(coded, "sentiment", "held", max_passes=3)
    by_ids = {tuple(r[:2]): r for r in grouped_classifier.predict(model, coded.rows, "platform", "cleaned_text").collect()}
    by_text = {tuple(r[:2]): r for r in grouped_classifier.predict(model, df, "platform", "cleaned_text").collect()}
    assert by_ids == by_text and len(by_ids) == 163 and by_ids["c", "c:1"].p0 == 1 / 3


def count_calls(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: calls.append(1) or real(*a, **b))
    return calls


def test_platform_texts_are_coded_once(spark, monkeypatch):
    """Before, texts were split for the vocabulary, for the ids and again for the scores."""
    read = []
    real = grouped_classifier.predict
    monkeypatch.setattr(grouped_classifier, "predict", lambda model, df, *a: read.append(df.columns) or real(model, df, *a))
    coded = count_calls(monkeypatch, grouped_classifier, "code")
    sentiment_flow.run_platforms(posts(spark, {"a": 60}), "key")
    assert len(coded) == 1 and grouped_classifier.IDS in read[0]


def test_features_are_made_once_and_score_as_the_texts(spark, monkeypatch):
    """Before, every pass over the texts (two of the training's, each prediction) made the features anew."""
    made = count_calls(monkeypatch, classify, "with_features")
    run = sentiment_flow.run_sentiment(posts(spark, {"a": 150}).drop("platform"), "key")
    assert len(made) == 1 and classify.FEATURES not in run.test.columns
    got = {r.key: (r.p0, r.p1, r.p2) for r in run.test.collect()}
    again = {r.key: (r.p0, r.p1, r.p2) for r in classify.predict(run.model, run.test.select("key", "cleaned_text")).collect()}
    assert got == again and len(got) == 30


def test_features_equal_the_ml_stages(spark):
    rows = [(i, t) for i, t in enumerate(["b a a", "", "  a  x ", "X b\tb", "é é"])]
    df = spark.createDataFrame(rows, "id int, t string")
    features = classify.fit_features(df.where("id < 3"), "t", 3)
    want = {r.id: r[classify.FEATURES] for r in features.transform(df).collect()}
    assert {r.id: r[classify.FEATURES] for r in classify.with_features(features, df).collect()} == want
    empty = classify.fit_features(df.where("id = 1"), "t")
    assert {r[classify.FEATURES] for r in classify.with_features(empty, df).collect()} == {r[classify.FEATURES] for r in empty.transform(df).collect()}


def test_large_lexicon_cleans_the_corpus_once(spark, monkeypatch):
    """Before, four jobs cleaned and deduplicated the documents anew."""
    seen = spark.sparkContext.accumulator(0)
    real = flows.document_corpus

    def counted(s, d):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        df = real(s, d)
        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(flows, "document_corpus", counted)
    rows = catalog.q_lexicon_sentiment_large(spark, SF001).collect()
    assert seen.value == len(rows) > 100


def test_lexicon_paths_agree_when_written(spark):
    lexicon = spark.createDataFrame([("w1", 0.5, 0.1), ("w1", 0.2, 0.3), ("w2", None, 0.1), ("w3", -0.25, 1.0)], "word string, polarity double, subjectivity double")
    df = posts(spark, {"a": 80})
    got = [sorted(sentiment.lexicon_scores(df, T.space_tokens("cleaned_text"), lexicon, "key", broadcast_limit=n, expression_limit=0).collect()) for n in (1, 2, 3, 100)]
    assert got[0] == got[1] == got[2] == got[3]
