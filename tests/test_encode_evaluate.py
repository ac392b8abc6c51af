"""Vocabulary, sequences, padding, label encodings, prediction records and reports."""

from pyspark.sql import functions as F

from tensio.operators import encode, evaluate


def test_vocabulary_ranks_and_cap(spark):
    df = spark.createDataFrame([("b a a c",), ("a b d",)], "t string")
    v = {r["word"]: (r["count"], r["id"]) for r in encode.vocabulary(df, "t").collect()}
    assert v == {"a": (3, 1), "b": (2, 2), "c": (1, 3), "d": (1, 4)}
    capped = {r["word"] for r in encode.vocabulary(df, "t", max_words=3).collect()}
    assert capped == {"a", "b"}


def test_sequences_drop_unknown_and_pad(spark):
    df = spark.createDataFrame([(1, "a zz b a"), (2, ""), (3, "c " * 200)], "id int, t string")
    vocab = spark.createDataFrame([("a", 5, 1), ("b", 3, 2), ("c", 1, 3)], "word string, count long, id int")
    out = encode.sequences(df, "t", vocab).select("id", "seq", encode.pad("seq", 5).alias("p")).collect()
    rows = {r["id"]: r for r in out}
    assert rows[1]["seq"] == [1, 2, 1] and rows[1]["p"] == [1, 2, 1, 0, 0]
    assert rows[2]["seq"] == [] and rows[2]["p"] == [0, 0, 0, 0, 0]
    assert rows[3]["p"] == [3, 3, 3, 3, 3]


def test_label_index_and_one_hot(spark):
    df = spark.createDataFrame([(1, "fr"), (2, "de"), (3, "fr"), (4, "en")], "id int, lang string")
    out = encode.label_index(df, "lang").select("id", "label_idx", encode.one_hot("label_idx", 3).alias("oh"))
    rows = {r["id"]: (r["label_idx"], r["oh"]) for r in out.collect()}
    assert rows == {1: (2, [0.0, 0.0, 1.0]), 2: (0, [1.0, 0.0, 0.0]), 3: (2, [0.0, 0.0, 1.0]), 4: (1, [0.0, 1.0, 0.0])}


def test_prediction_record_first_max_wins(spark):
    df = spark.createDataFrame([("x", 0.4, 0.4, 0.2), ("y", 0.1, 0.3, 0.6)], "t string, a double, b double, c double")
    rows = evaluate.prediction_record(df, "t", ["a", "b", "c"]).collect()
    assert (rows[0]["Predicted_Sentiment"], rows[0]["Confidence_Score"]) == (0, 0.4)
    assert (rows[1]["Predicted_Sentiment"], rows[1]["Confidence_Score"]) == (2, 0.6)
    assert rows[0].asDict().keys() >= {"Text", "Positive_Probability", "Neutral_Probability", "Negative_Probability"}


def test_confusion_and_report(spark):
    pairs = [(0, 0)] * 17 + [(0, 1)] + [(0, 2)] * 2 + [(1, 1)] * 20 + [(2, 0)] * 3 + [(2, 1)] + [(2, 2)] * 16
    df = spark.createDataFrame(pairs, "y int, p int")
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluate.confusion_matrix(df, "y", "p").collect()}
    assert cm[(0, 0)] == 17 and cm[(1, 0)] == 0 and cm[(2, 2)] == 16 and len(cm) == 9
    rep = {r["label"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rep["Positive"]["precision"] == round(17 / 20, 6) and rep["Neutral"]["recall"] == 1.0
    assert rep["Negative"]["recall"] == 0.8 and rep["Negative"]["support"] == 20
    assert rep["accuracy"]["f1_score"] == round(53 / 60, 6) and rep["accuracy"]["precision"] is None
    f1s = [2 * 17 / (2 * 17 + 3 + 3), 2 * 20 / (40 + 2), 2 * 16 / (32 + 2 + 4)]
    assert abs(rep["macro avg"]["f1_score"] - sum(f1s) / 3) < 1e-6
    assert abs(rep["weighted avg"]["f1_score"] - sum(f * 20 for f in f1s) / 60) < 1e-6


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    rep = {r["label"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rep["Neutral"]["precision"] == 0.0 and rep["Neutral"]["support"] == 0


def test_sentiment_run_both_orders(spark):
    from tensio.plans.sentiment_flow import run_sentiment

    rows = []
    words = {0: "great happy good fun", 1: "table chair window door", 2: "sad awful bad worse"}
    for i in range(90):
        c = i % 3
        rows.append((i, f"{words[c]} post number {'x' * (i % 7)}", c))
    df = spark.createDataFrame(rows, "id long, cleaned_text string, sentiment int")
    for order in (True, False):
        run = run_sentiment(df, "id", split_before_balance=order)
        rep = {r["label"]: r for r in run.report.collect()}
        assert rep["accuracy"]["f1_score"] > 0.9
        preds = run.predictions.collect()
        assert all(abs(r["Positive_Probability"] + r["Neutral_Probability"] + r["Negative_Probability"] - 1) < 1e-9 for r in preds)
        assert all(r["Confidence_Score"] == max(r["Positive_Probability"], r["Neutral_Probability"], r["Negative_Probability"]) for r in preds)
    run = run_sentiment(df, "id", split_before_balance=True)
    test_ids = {r["id"] for r in run.test.collect()}
    assert len(test_ids) == 18
