"""Weak labels and the two lexicon scoring paths."""

import pytest
from pyspark.sql import functions as F

from tensio.functions import text as T
from tensio.operators import sentiment


@pytest.mark.parametrize(
    "p, s, label",
    [(0.1, 0.5, 1), (0.1001, 0.5, 0), (-0.1, 0.5, 1), (-0.1001, 0.5, 2), (0.0, 0.0, 2), (0.05, 0.2, 1), (-0.05, 0.6, 1)],
)
def test_weak_label(spark, p, s, label):
    df = spark.createDataFrame([(p, s)], "p double, s double")
    assert df.select(sentiment.weak_label("p", "s").alias("y")).first()["y"] == label


LEX = [("good", 0.7, 0.6), ("bad", -0.7, 0.667), ("the", 0.0, 0.1)]


def test_lexicon_paths_agree(spark):
    posts = spark.createDataFrame(
        [(1, "good good bad"), (2, "nothing here"), (3, "the bad"), (4, "")], "id int, cleaned_text string"
    )
    lex = spark.createDataFrame(LEX, "word string, polarity double, subjectivity double")
    tiny = sentiment.lexicon_scores(posts, T.space_tokens("cleaned_text"), lex, "id")
    small = sentiment.lexicon_scores(posts, T.space_tokens("cleaned_text"), lex, "id", expression_limit=0)
    large = sentiment.lexicon_scores(posts, T.space_tokens("cleaned_text"), lex, "id", broadcast_limit=0)
    a = {r["id"]: (r["polarity"], r["subjectivity"], r["lexicon_hits"]) for r in small.collect()}
    b = {r["id"]: (r["polarity"], r["subjectivity"], r["lexicon_hits"]) for r in large.collect()}
    c = {r["id"]: (r["polarity"], r["subjectivity"], r["lexicon_hits"]) for r in tiny.collect()}
    assert a == b == c
    plan = tiny._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "ArrowEvalPython" in small._jdf.queryExecution().executedPlan().toString()
    # micro-units: (700000 + 700000 - 700000) / 3 = 233333.33 -> 233333; (600000 + 600000 + 667000) / 3 = 622333.33 -> 622333
    assert a[1] == (0.233333, 0.622333, 3)
    assert a[3] == (-0.35, 0.3835, 2)  # -700000 / 2; (100000 + 667000) / 2 = 383500
    assert a[2] == (0.0, 0.0, 0) and a[4] == (0.0, 0.0, 0)


def test_label_posts(spark):
    posts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "zzz")], "id int, cleaned_text string")
    lex = spark.createDataFrame(LEX, "word string, polarity double, subjectivity double")
    out = {r["id"]: r["sentiment"] for r in sentiment.label_posts(posts, lex, "id").collect()}
    assert out == {1: 0, 2: 2, 3: 2}
