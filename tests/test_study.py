"""The file-to-file study flow end to end on small hand-written sources."""

import os

from tensio.plans import study


def _posts(n, offset):
    moods = ["so good and happy", "a plain table", "so bad and sad"]
    topics = ["exam at school", "friends party", "music club", "career job"]
    return [f"Teenage {moods[i % 3]} day {topics[i % 4]} number{'x' * ((i + offset) % 9)}" for i in range(n)]


def test_study_end_to_end(spark, tmpdir_path):
    raw = os.path.join(tmpdir_path, "raw")
    os.makedirs(raw)
    with open(os.path.join(raw, "mh.csv"), "w") as f:
        f.write("post_id,post_text,label\n")
        for i, t in enumerate(_posts(40, 0)):
            f.write(f'{i},"{t}",1\n')
        f.write('99,"Teenage so good and happy day exam at school number",1\n')  # repeated below
    with open(os.path.join(raw, "tw2.csv"), "w") as f:
        f.write("text;label;;\n")
        for t in _posts(30, 3):
            f.write(f"{t};0;;\n")
    with open(os.path.join(raw, "s140.csv"), "w", encoding="latin-1") as f:
        for i, t in enumerate(_posts(30, 5)):
            f.write(f'4,{i},Tue Apr 07 06:29:03 PDT 2009,NO_QUERY,u{i},"{t}"\n')
    with open(os.path.join(raw, "rt.csv"), "w") as f:
        f.write("title;label;;\n")
        for t in _posts(45, 7):
            f.write(f"{t};1;;\n")

    out = os.path.join(tmpdir_path, "out")
    res = study.clean_sources(
        spark,
        {
            "mental_health_twitter": os.path.join(raw, "mh.csv"),
            "twitter_data_2": os.path.join(raw, "tw2.csv"),
            "sentiment_140": os.path.join(raw, "s140.csv"),
            "reddit_title": os.path.join(raw, "rt.csv"),
            "reddit_combi": os.path.join(raw, "missing.csv"),
        },
        out,
    )
    assert isinstance(res["reddit_combi"], Exception)
    assert res["twitter_data_2"].count() == 30

    lex = spark.createDataFrame(
        [("good", 0.7, 0.6), ("happy", 0.8, 1.0), ("bad", -0.7, 0.7), ("sad", -0.5, 1.0), ("plain", 0.0, 0.9)],
        "word string, polarity double, subjectivity double",
    )
    tw = [os.path.join(out, study.cleaned_name(n)) for n in ("mental_health_twitter", "twitter_data_2", "sentiment_140")]
    run = study.analyze_platform(spark, tw, "Twitter", out, lex)
    assert {r["label"] for r in run.report.collect()} >= {"Positive", "Neutral", "Negative", "accuracy"}
    study.analyze_platform(spark, [os.path.join(out, study.cleaned_name("reddit_title"))], "Reddit", out, lex)
    assert os.path.isdir(os.path.join(out, "negative_sentiment_predictions_twitter"))

    combined = study.combine_class_exports(spark, out, ["Twitter", "Reddit"])
    rows = combined.collect()
    assert {r["Platform"] for r in rows} <= {"Twitter", "Reddit"} and all(r["Predicted_Sentiment"] == "2" for r in rows)

    share = study.topic_report(spark, os.path.join(out, "sentiment_predictions_twitter")).collect()
    assert len(share) == 4 and abs(sum(r["pct"] for r in share) - 100.0) < 1e-9


def test_command_line(spark, tmpdir_path, capsys):
    from tensio.__main__ import main

    raw = os.path.join(tmpdir_path, "tw2.csv")
    with open(raw, "w") as f:
        f.write("text;label;;\n")
        for t in _posts(60, 1):
            f.write(f"{t};0;;\n")
    out = os.path.join(tmpdir_path, "out")
    assert main(["clean", "--out", out, f"twitter_data_2={raw}"]) == 0
    distinct = len(set(_posts(60, 1)))  # exact duplicates are dropped
    assert f"twitter_data_2: {distinct} posts kept" in capsys.readouterr().out
    lex = os.path.join(tmpdir_path, "lex.csv")
    with open(lex, "w") as f:
        f.write("word,polarity,subjectivity\ngood,0.7,0.6\nhappy,0.8,1.0\nbad,-0.7,0.7\nsad,-0.5,1.0\nplain,0.0,0.9\n")
    cleaned = os.path.join(out, study.cleaned_name("twitter_data_2"))
    assert main(["sentiment", "--out", out, "--platform", "Twitter", "--lexicon", lex, cleaned]) == 0
    assert "accuracy" in capsys.readouterr().out
    assert main(["topics", os.path.join(out, "sentiment_predictions_twitter")]) == 0
    assert "School & Studies" in capsys.readouterr().out
