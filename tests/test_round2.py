"""Inputs that once lost rows or changed values: NULL and foreign labels, blanks, quoted
newlines, number and time texts, map columns, lexicons of every size, missing classes."""

import os

import pytest
from pyspark.sql import functions as F

from tensio.functions import text as T
from tensio.operators import classify, cleaning, encode, evaluate, sampling, sentiment
from tensio.plans import study
from tensio.session import ensure_checkpoint_dir
from tensio.sources import adapters, csv, sinks


def labelled(spark, n=200):
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 3).cast("int")).alias("y"))


def test_null_labels_stay(spark):
    df = labelled(spark)
    index = {r.y: r.label_idx for r in encode.label_index(df, "y").select("y", "label_idx").distinct().collect()}
    assert index == {0: 0, 1: 1, 2: 2, None: 3} and encode.label_index(df, "y").count() == 200
    split = sampling.stratified_split(df.withColumn("k", F.col("id").cast("string")), "y", "k").collect()
    assert len(split) == 200 and sum(r.fold == "test" for r in split) == 40
    sizes = {y: sum(r.y == y and r.fold == "test" for r in split) for y in (None, 0, 1, 2)}
    assert all(abs(sizes[y] - 0.2 * sum(r.y == y for r in split)) < 1 for y in sizes)
    balanced = sampling.balance_classes(df, "y", "id").groupBy("y").count().collect()
    assert len(balanced) == 4 and len({r["count"] for r in balanced}) == 1


def test_many_labels_are_indexed(spark):
    df = spark.range(3000).select(F.concat(F.lit("label"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("y"))
    rows = encode.label_index(df, "y").collect()
    assert all(r.label_idx == int(r.y[5:]) for r in rows) and len(rows) == 3000


def test_sample_sizes_by_top_n_and_by_cut_agree(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("k"))
    want = {r.k for r in sampling.seeded_sample(df, 1234, "k").collect()}
    monkeypatch.setattr(sampling, "TOP_N", 0)
    assert {r.k for r in sampling.seeded_sample(df, 1234, "k").collect()} == want
    for n in (0, 4999, 5000, 9000):
        assert sampling.seeded_sample(df, n, "k").count() == min(n, 5000)


def test_confusion_matrix_counts_every_row(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (7, 0), (None, 1), (2, None)], "y int, p int")
    cells = {(r.y_true, r.y_pred): r.n for r in evaluate.confusion_matrix(df, "y", "p").collect()}
    assert sum(cells.values()) == 5 and cells[7, 0] == cells[None, 1] == cells[2, None] == 1 and len(cells) == 12


def test_csv_keeps_blanks_and_quoted_newlines(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "out")
    sinks.write_csv(spark.createDataFrame([(1, "  lead and trail  "), (2, " ")], "i int, t string"), path)
    assert sorted(r.t for r in csv.read_csv(spark, path).collect()) == [" ", "  lead and trail  "]
    raw = os.path.join(tmpdir_path, "s.csv")
    with open(raw, "w", encoding="latin-1") as f:
        f.write('4,1,Tue Apr 07 06:29:03 PDT 2009,NO_QUERY,u,"two\nlines"\n0,2,2009-04-07 06:29:03,NO_QUERY,u,one\n0,3,no time,NO_QUERY,u,x\n0,4,t,q,u,too,long\n')
    rows, _, report, _ = adapters.load_sentiment_140(spark, raw)
    got = {r.id: r for r in rows.collect()}
    assert got[1].text == "two\nlines" and got[2].timestamp.year == 2009 and got[3].timestamp is None and got[3].timestamp_text == "no time"
    assert report.first().skipped_lines == 1 and len(got) == 3


@pytest.mark.parametrize("raw, value", [("1d", None), ("2f", None), ("0x1p3", None), (" 3.5 ", 3.5), ("-1e3", -1000.0), (".5", 0.5), ("5.", 5.0), ("nan", None), ("", None), (None, None), ("1,000", None)])
def test_numbers(spark, raw, value):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(T.coerce_numeric("t").alias("v")).first().v == value


def test_times(spark):
    texts = ["2020-01-02", "2020-01-02 03:04", "2020-01-02 03:04:05", "2020-01-02T03:04:05Z", "2020-01-02T03:04:05+01:00", "2020-01-02T03:04:05.250", "01/02/2020 03:04", "2020/01/02", "Thu Jan 02 03:04:05 +0000 2020", "13/45/2020", "x"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.parse_post_time("t").cast("string").alias("v")).collect()]
    assert got == ["2020-01-02 00:00:00", "2020-01-02 03:04:00", "2020-01-02 03:04:05", "2020-01-02 03:04:05", "2020-01-02 02:04:05", "2020-01-02 03:04:05.25", "2020-01-02 03:04:00", "2020-01-02 00:00:00", "2020-01-02 03:04:05", None, None]


def test_dedupe_with_a_map_column(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1}), (2, "a", {"y": 2}), (3, "b", None)], "i int, t string, m map<string,int>")
    rows = cleaning.dedupe_first(df, ["t"], ["i"]).orderBy("i").collect()
    assert [(r.i, r.m) for r in rows] == [(1, {"x": 1}), (3, None)]


def test_lexicon_of_every_size_gives_the_same_values(spark):
    """Ties in the seventh decimal, repeated words and NULL entries, through all three paths."""
    base = [("good", 0.0000005, 0.3), ("good", 0.7, 0.1), ("bad", -0.0000005, 0.9), ("odd", None, 0.5), (None, 0.5, 0.5), ("sad", -0.3333335, None), ("fine", 0.1234565, 0.4)]
    posts = spark.createDataFrame([(1, "good good odd"), (2, "bad fine"), (3, "sad odd"), (4, ""), (5, "w17 good w64000")], "id int, cleaned_text string")
    seen = set()
    for size in (0, 64, 70_000):
        more = spark.range(size).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity"))
        lexicon = spark.createDataFrame(base, "word string, polarity double, subjectivity double").unionByName(more)
        scored = sentiment.lexicon_scores(posts, T.space_tokens("cleaned_text"), lexicon, "id", broadcast_limit=1000).where("id < 5")
        seen.add(tuple(sorted((r.id, r.polarity, r.subjectivity, r.lexicon_hits) for r in scored.collect())))
    assert len(seen) == 1
    assert dict((i, (p, h)) for i, p, _, h in seen.pop()) == {1: (1e-06, 2), 2: (0.061728, 2), 3: (0.0, 0), 4: (0.0, 0)}


@pytest.mark.parametrize("classes", [(0, 1), (1,), (0, 2), (0, 1, 2)])
def test_classifier_has_three_classes(spark, classes):
    rows = [(i, c, f"word{c} common text{i % 4}") for i in range(24) for c in classes]
    df = spark.createDataFrame(rows, "id int, sentiment int, cleaned_text string")
    out = classify.predict(classify.train_classifier(df), df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.p0 + r.p1 + r.p2 - 1) < 1e-6 and r.predicted == r.sentiment
        assert all(getattr(r, f"p{c}") == 0 for c in range(max(classes) + 1, 3))


def test_raw_text_stays_out_of_the_corpus_shuffle(spark):
    from tensio.operators import corpus

    posts = spark.createDataFrame([(1, "Some long text here"), (2, "Some long text, here")], "k int, raw string")
    out = corpus.prepare_corpus([("a", posts)], "raw", ["k"])
    assert "raw" not in out.columns and out.count() == 1
    exchange = out._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert "raw" not in exchange


def test_study_keys_do_not_depend_on_the_scan(spark, tmpdir_path):
    posts = spark.createDataFrame([(f"post number {'x' * i} of many",) for i in range(40)], "cleaned_text string")
    keys = []
    for n in (1, 3, 8):
        path = os.path.join(tmpdir_path, f"p{n}")
        sinks.write_csv(posts.repartition(n), path)
        keys.append({(r.post_key, r.cleaned_text) for r in study.load_cleaned(spark, [path]).collect()})
    assert keys[0] == keys[1] == keys[2] and len(keys[0]) == 40


def test_source_report(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "c.csv")
    with open(path, "w") as f:
        f.write("Body_Title;label\n" + "teenage exam stress at school;1\n" * 2 + "nothing here;0\nno label;x\n")
    report = study.source_report(spark, "reddit_combi", path)
    assert tuple(report.counts.first()) == (3, 2, 1)
    assert report.scores.first()["count"] == 2 and report.preview.count() == 1 and report.means.count() == 1
    assert report.notes["dropped_rows"].first().dropped_rows == 1 and [r.n for r in report.notes["labels"].collect()] == [2, 1]


def test_checkpoint_folder(spark):
    assert ensure_checkpoint_dir(spark)
