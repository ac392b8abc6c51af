"""Topic share: whole-token matching, double-listed words, zero hits, order, labels."""

from tensio.operators import topics


def share(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return topics.topic_share(df, "text").collect()


def test_double_listed_words_count_in_both_topics(spark):
    rows = {r["topic"]: r for r in share(spark, ["team education team"])}
    assert {t: r["hits"] for t, r in rows.items()} == {
        "social_peer": 2, "extracurricular": 2, "academic": 1, "future_career": 1,
    }
    assert abs(sum(r["pct"] for r in rows.values()) - 100.0) < 1e-9
    assert rows["social_peer"]["display"] == "Friends & Social Life\n(33.3%)"


def test_phrases_never_match(spark):
    rows = {r["topic"]: r["hits"] for r in share(spark, ["peer-pressure best friend"])}
    assert rows["social_peer"] == 2 and rows["academic"] == 0


def test_no_hits_gives_null_share(spark):
    rows = share(spark, ["nothing to see", None])
    assert len(rows) == 4 and all(r["hits"] == 0 and r["pct"] is None and r["display"] is None for r in rows)


def test_sorted_by_share_then_dictionary_order(spark):
    rows = share(spark, ["exam exam exam music club job"])
    assert [r["topic"] for r in rows] == ["academic", "extracurricular", "future_career", "social_peer"]
    assert [r["hits"] for r in rows] == [3, 2, 1, 0]


def test_keyword_counts(spark):
    df = spark.createDataFrame([("Team TEAM exam",)], "text string")
    got = {(r["topic"], r["keyword"]): r["hits"] for r in topics.topic_keyword_counts(df, "text").collect()}
    assert got == {("social_peer", "team"): 2, ("extracurricular", "team"): 2, ("academic", "exam"): 1}


def test_share_labels_for_a_9_5_2_2_split(spark):
    texts = (
        ["so much homework tonight"] * 4
        + ["the exam was brutal", "failed my test again", "grade anxiety", "math is hard", "essay due"]
        + ["my friends left", "lost a friend", "party alone", "no support", "drama again"]
        + ["missed practice", "music is all i have"]
        + ["no job yet", "scared about the future"]
        + ["just tired"]
    )
    assert len(texts) == 19  # 18 posts with a hit, one without
    rows = share(spark, texts)
    assert [(r["topic"], r["hits"]) for r in rows] == [
        ("academic", 9), ("social_peer", 5), ("extracurricular", 2), ("future_career", 2),
    ]
    assert [r["display"] for r in rows] == [
        "School & Studies\n(50.0%)",
        "Friends & Social Life\n(27.8%)",
        "Activities & Sports\n(11.1%)",
        "Career & Future\n(11.1%)",
    ]
