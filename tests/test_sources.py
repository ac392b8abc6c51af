"""CSV readers, adapters and sinks on small hand-written files."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.sources import adapters, csv, sinks


def write(d, name, text, encoding="utf-8"):
    p = os.path.join(d, name)
    with open(p, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return p


def test_multiline_quoted_records_and_na(spark, tmpdir_path):
    p = write(
        tmpdir_path,
        "mh.csv",
        'post_id,post_text,label\n1,"teen\nstress, at school",1\n2,NA,0\n3,none,1\n4,,0\n',
    )
    df, col = adapters.load_mental_health_twitter(spark, p)
    assert col == "text"
    rows = df.orderBy("_row").collect()
    assert [r["text"] for r in rows] == ["teen\nstress, at school", None, "none", None]
    assert csv.peek_columns(spark, p) == ["post_id", "post_text", "label"]


def test_semicolon_with_empty_trailing_headers(spark, tmpdir_path):
    p = write(tmpdir_path, "tw2.csv", "text;label;;;\nteenage worries;1;;;\nhello;0;;;\n")
    df, col = adapters.load_twitter_data_2(spark, p)
    assert df.count() == 2 and "text" in df.columns
    out = adapters.clean_source(df, col).collect()
    assert [r["cleaned_text"] for r in out] == ["teenage worries"]


def test_sentiment140_tolerant_read(spark, tmpdir_path):
    lines = [
        '0,1,Tue Apr 07 06:29:03 PDT 2009,NO_QUERY,u1,teen stress at school',
        '4,2,Tue Apr 07 06:30:03 PDT 2009,q,u2,teenage exam',
        '4,3,Tue Apr 07 06:31:03 PDT 2009,q,u3,too,many,fields',
        '2,4,junk,q,u4,teen teen adolescent',
        '0,5,Tue Apr 07 06:32:03 PDT 2009,q,u5',
    ]
    p = write(tmpdir_path, "s140.csv", "\n".join(lines) + "\n", encoding="latin-1")
    rows, col, report, stats = adapters.load_sentiment_140(spark, p)
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["query"] == "" and got[1]["sentiment"] == 0 and got[2]["sentiment"] == 1
    assert got[4]["sentiment"] is None and got[4]["timestamp"] is None
    assert got[1]["timestamp"] is not None
    assert report.first()["skipped_lines"] == 1
    s = stats.first()
    assert (s["dropped_missing_text"], s["positive"], s["negative"]) == (1, 1, 1)


def test_reddit_title_and_combi(spark, tmpdir_path):
    t = write(tmpdir_path, "rt.csv", "Post Title;label;;\nteen life;1;;\nteen stress;abc;;\n")
    df, col = adapters.load_reddit_title(spark, t)
    assert col == "title" and [r["label"] for r in df.orderBy("_row").collect()] == [1.0, None]
    c = write(tmpdir_path, "rc.csv", "body;category\nteen life;1\nteen stress;abc\n")
    df2, col2 = adapters.load_reddit_combi(spark, c)
    assert col2 == "Body_Title" and df2.count() == 1
    dist = adapters.label_distribution(df).collect()
    assert [(r["label"], r["n"]) for r in dist] == [(1.0, 1)]


def test_missing_and_empty_files(spark, tmpdir_path):
    with pytest.raises(csv.SourceError):
        csv.read_csv(spark, os.path.join(tmpdir_path, "nope.csv"))
    empty = write(tmpdir_path, "empty.csv", "")
    with pytest.raises(csv.SourceError):
        csv.read_csv(spark, empty)
    with pytest.raises(csv.SourceError):
        csv.resolve_column(spark.createDataFrame([(1,)], "a int"), "text", ["text"])


def test_read_many_skips_bad_files(spark, tmpdir_path):
    good = write(tmpdir_path, "good.csv", "cleaned_text\nhello there friend\n")
    bad = write(tmpdir_path, "bad.csv", "other\nx\n")

    def load(s, p):
        return csv.require_columns(csv.read_csv(s, p), ["cleaned_text"])

    out = csv.read_many(spark, [good, bad, os.path.join(tmpdir_path, "missing.csv")], load)
    assert [p for p, _ in out] == [good]
    with pytest.raises(csv.SourceError):
        csv.read_many(spark, [bad], load)


def test_csv_sink_round_trip_and_class_export(spark, tmpdir_path):
    df = spark.createDataFrame(
        [("a, \"quoted\"\nline", 2, 0.5), ("plain", 0, 0.9)], "Text string, Predicted_Sentiment int, Confidence_Score double"
    )
    out = os.path.join(tmpdir_path, "all")
    sinks.write_csv(df, out)
    back = csv.read_csv(spark, out)
    assert sorted(r["Text"] for r in back.collect()) == ["a, \"quoted\"\nline", "plain"]
    neg = os.path.join(tmpdir_path, "neg")
    sinks.write_class(df, neg, "Predicted_Sentiment", 2)
    assert [r["Text"] for r in csv.read_csv(spark, neg).collect()] == ["a, \"quoted\"\nline"]
    part = os.path.join(tmpdir_path, "part")
    sinks.write_partitioned(df, part, "Predicted_Sentiment")
    assert spark.read.parquet(part).filter("Predicted_Sentiment = 0").count() == 1


def test_label_distribution_orders(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1.0,), (None,), (2.0,), (2.0,), (2.0,)], "label double")
    by_value = [(r["label"], r["n"]) for r in adapters.label_distribution(df).collect()]
    by_count = [(r["label"], r["n"]) for r in adapters.label_distribution(df, order="count").collect()]
    assert by_value == [(0.0, 1), (1.0, 2), (2.0, 3)]
    assert by_count == [(2.0, 3), (1.0, 2), (0.0, 1)]


def test_utf8_bom_header(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "bom.csv")
    with open(p, "wb") as f:
        f.write(b"\xef\xbb\xbftext,label\nteenage stress,1\n")
    df, col = adapters.load_mental_health_twitter(spark, p)
    assert "text" in df.columns and df.first()["text"] == "teenage stress"


def test_encoding_list_skips_unsupported(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cp.csv")
    with open(p, "wb") as f:
        f.write(b"text,label\ncaf\xe9 teenage,1\n")
    df = csv.read_csv(spark, p, encoding=["windows-1252", "ISO-8859-1"])
    assert df.first()["text"] == "café teenage"
    with pytest.raises(csv.SourceError):
        csv.read_csv(spark, p, encoding="windows-1252")
    rows, report = csv.read_csv_tolerant(
        spark, p, TY.StructType([TY.StructField("text", TY.StringType()), TY.StructField("label", TY.StringType())]),
        header=True, encoding=["cp1252", "ISO-8859-1"],
    )
    assert rows.first()["text"] == "café teenage"
