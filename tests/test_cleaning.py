"""Dedupe, the cleaning flow, counts and the single-evaluation plan shape."""

from pyspark.sql import functions as F

from tensio.functions.lexicons import PROFILE_V2
from tensio.operators import cleaning as C


def test_dedupe_keeps_first_by_order_and_one_null(spark):
    df = spark.createDataFrame(
        [(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (5, None, "n1"), (4, None, "n2")], "id int, text string, other string"
    )
    out = {(r["text"], r["id"], r["other"]) for r in C.dedupe_first(df, ["text"], ["id"]).collect()}
    assert out == {("a", 1, "y"), ("b", 2, "z"), (None, 4, "n2")}


def test_dedupe_hot_key_many_partitions(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(16)
    out = C.dedupe_first(df, ["text"], ["id"], copies_col="copies")
    hot = out.filter("text = 'hot'").first()
    assert hot["id"] == 1 and hot["copies"] == 2000
    assert out.count() == 1 + 1000


def test_clean_dataset_threshold_and_columns(spark):
    df = spark.createDataFrame(
        [
            (1, "Teenage stress at school!"),
            (2, "Teenage stress at school!"),  # exact duplicate, dropped
            (3, "exam school teen"),  # 0.45: dropped
            (4, "stress exam teen"),  # 0.5: kept
            (5, None),
            (6, "nothing relevant"),
        ],
        "id int, text string",
    )
    out = C.clean_dataset(df, "text", ["id"], PROFILE_V2)
    rows = {r["id"]: r for r in out.collect()}
    assert set(rows) == {1, 4}
    r = rows[1]
    assert r["cleaned_text"] == "teenage stress at school"
    assert r["age_terms_found"] == "teen, teenage" and r["age_term_count"] == 2
    assert r["stress_terms_found"] == "stress" and r["educational_terms_found"] == "school"
    assert r["slang_terms_found"] == "none" and r["slang_term_count"] == 0
    assert r["relevance_score"] == 0.75
    assert out.columns[:2] == ["id", "text"]


def test_regex_chain_evaluated_once(spark):
    df = spark.createDataFrame([(1, "a teen")], "id int, text string")
    out = C.clean_dataset(df, "text", ["id"], PROFILE_V2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1


def test_stage_counts_and_describe(spark):
    df = spark.createDataFrame([(1, "teenage"), (2, "teenage"), (3, "hello"), (4, "stress exam teen")], "id int, text string")
    s = C.stage_counts(df, "text", PROFILE_V2).first()
    assert (s["raw_rows"], s["deduped_rows"], s["kept_rows"]) == (4, 3, 2)
    scored = C.score_posts(C.dedupe_first(df, ["text"], ["id"]), "text", PROFILE_V2)
    d = C.score_describe(scored).first()
    assert d["count"] == 3 and d["min"] == 0.0 and d["max"] == 0.5 and d["p50"] == 0.5
    assert abs(d["mean"] - 1 / 3) < 1e-12 and abs(d["p25"] - 0.25) < 1e-12


def test_preview_cuts_text(spark):
    df = spark.createDataFrame([(i, f"teenage {i} " + "x" * 200) for i in range(5)], "id int, text string")
    kept = C.clean_dataset(df, "text", ["id"], PROFILE_V2)
    p = C.preview(kept, "text", ["id"]).collect()
    assert [r["id"] for r in p] == [0, 1, 2]
    assert len(p[0]["original_preview"]) == 103 and p[0]["original_preview"].endswith("...")
    assert p[0]["score_text"] == "0.50"


def test_drop_null_and_stats(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 0.0)], "id int, label double")
    assert C.drop_null(df, ["label"]).count() == 2
    s = C.drop_stats(df, "label").first()
    assert (s["initial_rows"], s["dropped_rows"], s["kept_rows"]) == (3, 1, 2)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "teenage stress", "x"), (2, "teenage stress", "y")], "`post.id` int, `Post Text` string, `a b` string")
    out = C.clean_dataset(df, "Post Text", ["post.id"], PROFILE_V2).collect()
    assert len(out) == 1 and out[0]["post.id"] == 1 and out[0]["a b"] == "x"


def test_dotted_text_column(spark):
    df = spark.createDataFrame([(1, "Teen exam stress")], "id int, `body.text` string")
    out = C.clean_dataset(df, "body.text", ["id"], PROFILE_V2).first()
    assert out["cleaned_text"] == "teen exam stress" and out["relevance_score"] == 0.5


def test_dedupe_ties_on_order_are_deterministic(spark):
    rows = [(1, "a", "z"), (1, "a", "b"), (1, "a", "m")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "id int, text string, other string").repartition(parts)
        assert C.dedupe_first(df, ["text"], ["id"]).first()["other"] == "b"
