"""Column expressions against the edge rows of FIXTURES.md §3."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tensio.functions import text as T
from tensio.functions.lexicons import PROFILE_V1, PROFILE_V2


def one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("12345 !!!", ""),
        ("See HTTPS://x.y/z?q=1 now", "see now"),
        ("awwwsome day", "a day"),
        ("A1 b c\u001cd", "a b c d"),
        ("I'm blue-haired, 15min", "im bluehaired min"),
        ("Tab\tand\nnew\r\nline", "tab and new line"),
        ("Crème brûlée café", "crme brle caf"),
        ("visit www.example.com/x today", "visit today"),
    ],
)
def test_clean_text_edges(spark, raw, cleaned):
    assert one(spark, T.clean_text, raw) == cleaned


def test_clean_text_equals_python_rule_on_unicode_whitespace(spark):
    import re

    def ref(s):
        s = s.lower()
        s = re.sub(r"http\S+|www\S+|https\S+", "", s)
        s = re.sub(r"[^a-zA-Z\s]", "", s)
        return " ".join(s.split())

    samples = ["a b　c", "x\u0085y z", "http://a b", "Ünïcödé ok", "  lead trail  "]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    got = [r["y"] for r in df.select(T.clean_text("x").alias("y")).collect()]
    assert got == [ref(s) for s in samples]


def test_clean_text_is_idempotent_and_letters_only(spark):
    df = spark.createDataFrame([("Hello, World! 123 http://x.y",), ("ÀÉÎ õü ß",)], "x string")
    once = df.select(T.clean_text("x").alias("c"))
    rows = once.select("c", T.clean_text("c").alias("cc")).collect()
    for r in rows:
        assert r["c"] == r["cc"]
        assert set(r["c"]) <= set("abcdefghijklmnopqrstuvwxyz ")


def test_found_terms_substring_order_and_none(spark):
    df = spark.createDataFrame([("dreamteam",), ("teenage",), ("stress stress stress",), ("",)], "t string")
    out = df.select(
        T.found_terms("t", PROFILE_V2.families["slang"]).alias("slang"),
        T.found_terms("t", PROFILE_V2.families["age"]).alias("age"),
        T.found_terms("t", PROFILE_V2.families["stress"]).alias("stress"),
        T.term_count("t", PROFILE_V2.families["age"]).alias("n_age"),
        T.term_count("t", PROFILE_V2.families["stress"]).alias("n_stress"),
    ).collect()
    assert out[0]["slang"] == "tea"
    assert out[1]["age"] == "teen, teenage" and out[1]["n_age"] == 2
    assert out[2]["stress"] == "stress" and out[2]["n_stress"] == 1
    assert out[3]["slang"] == "none" and out[3]["n_age"] == 0


def test_count_from_found_matches_direct_count(spark):
    df = spark.createDataFrame([("teenage adolescent",), ("nothing here",)], "t string")
    fam = PROFILE_V2.families["age"]
    rows = df.select(T.count_from_found(T.found_terms("t", fam)).alias("a"), T.term_count("t", fam).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(3, 3), (0, 0)]


@pytest.mark.parametrize(
    "text, v2, v1",
    [
        ("teenage", 0.5, 0.4),  # (0, 0, 2)
        ("stress exam teen", 0.5, 0.5),  # (1, 1, 1): exactly on the threshold
        ("exam school teen", 0.45, 0.5),  # (0, 2, 1)
        ("stress anxiety exam school", 0.5, 0.6),  # (2, 2, 0)
        ("stress anxiety panic exam school class grade teenage adolescent", 1.0, 1.0),  # caps
        ("", 0.0, 0.0),
    ],
)
def test_relevance_score(spark, text, v2, v1):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(T.relevance_score("t", PROFILE_V2).alias("a"), T.relevance_score("t", PROFILE_V1).alias("b")).first()
    assert r["a"] == v2 and r["b"] == v1


def test_tokenize_words_unicode(spark):
    assert one(spark, T.tokenize_words, "Héllo wörld_1 x-y, PEER-pressure") == ["héllo", "wörld_1", "x", "y", "peer", "pressure"]


def test_keras_tokens(spark):
    assert one(spark, T.keras_tokens, "Hello, world!  it's\tfine") == ["hello", "world", "it's", "fine"]


def test_na_tokens_and_sentinel(spark):
    df = spark.createDataFrame([("NA",), ("none",), ("null",), ("",), ("ok",), ("NO_QUERY",)], "x string")
    rows = df.select(T.na_to_null("x").alias("a"), T.sentinel_replace("x", "NO_QUERY", "").alias("b")).collect()
    assert [r["a"] for r in rows] == [None, "none", None, None, "ok", "NO_QUERY"]
    assert rows[-1]["b"] == ""


def test_value_map_and_coerce(spark):
    df = spark.createDataFrame([(0, "1"), (4, " 2.5 "), (2, "abc"), (None, None)], "s int, l string")
    rows = df.select(T.value_map("s", {0: 0, 4: 1}).alias("m"), T.coerce_numeric("l").alias("c")).collect()
    assert [r["m"] for r in rows] == [0, 1, None, None]
    assert [r["c"] for r in rows] == [1.0, 2.5, None, None]


def test_parse_post_time_named_and_numeric_zones(spark):
    df = spark.createDataFrame(
        [("Tue Apr 07 06:29:03 PDT 2009",), ("Fri Oct 30 05:36:14 +0000 2015",), ("junk",), (None,)], "x string"
    )
    rows = [r["t"] for r in df.select(T.parse_post_time("x").alias("t")).collect()]
    assert rows[0] == dt.datetime(2009, 4, 7, 13, 29, 3)
    assert rows[1] == dt.datetime(2015, 10, 30, 5, 36, 14)
    assert rows[2] is None and rows[3] is None


def test_percent_label_rounds_like_python(spark):
    vals = [0.15, 6.25, 12.35, 99.95, 50.0, 27.77777777777778]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r["s"] for r in df.select(T.percent_label(F.lit("L"), F.col("v")).alias("s")).collect()]
    assert got == [f"L\n({v:.1f}%)" for v in vals]
