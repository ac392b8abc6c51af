"""Every operator accepts empty input and returns empty (or all-zero) results."""

from tensio.functions import text as T
from tensio.functions.lexicons import PROFILE_V2
from tensio.operators import cleaning, corpus, encode, evaluate, sentiment, topics


def test_empty_everywhere(spark):
    posts = spark.createDataFrame([], "id long, text string")
    assert cleaning.clean_dataset(posts, "text", ["id"], PROFILE_V2).count() == 0
    s = cleaning.stage_counts(posts, "text", PROFILE_V2).first()
    assert (s["raw_rows"], s["deduped_rows"], s["kept_rows"]) in ((None, 0, 0), (0, 0, 0))
    assert corpus.prepare_corpus([("a", posts)], "text", ["id"]).count() == 0
    share = topics.topic_share(posts, "text").collect()
    assert len(share) == 4 and all(r["hits"] == 0 and r["pct"] is None for r in share)
    cleaned = cleaning.with_clean_text(posts, "text")
    vocab = encode.vocabulary(cleaned, "cleaned_text")
    assert vocab.count() == 0 and encode.sequences(cleaned, "cleaned_text", vocab).count() == 0
    for lex_rows in ([("good", 0.5, 0.5)], [(f"w{i}", 0.1, 0.1) for i in range(100)]):
        lex = spark.createDataFrame(lex_rows, "word string, polarity double, subjectivity double")
        assert sentiment.label_posts(cleaned, lex, "id").count() == 0
    preds = spark.createDataFrame([], "y int, p int")
    rep = {r["label"]: r for r in evaluate.classification_report(preds, "y", "p").collect()}
    assert rep["accuracy"]["support"] == 0 and rep["Positive"]["precision"] == 0.0
    assert all(r["n"] == 0 for r in evaluate.confusion_matrix(preds, "y", "p").collect())
