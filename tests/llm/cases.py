"""Rows that every operator must take: NULLs, empty and long texts, ties, repeats, clashing names."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i * 7919 % 10007} and" for i in range(30_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, "One"), (5, "Two words"), (6, LONG), (7, "same text here for two rows " * 12), (8, "same text here for two rows " * 12),
    (8, "same text here for two rows " * 12), (9, "é ü ñ 梦 \U0001f600 <|endoftext|> </s>   x"), (None, "a row without an id, of some words"), (10, "SAME Text Here For Two Rows " * 12),
]


def edge_rows(spark):
    """The rows above with columns whose names the operators use themselves."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in ("key", "score", "n_words", "th", "fp", "kept", "held", "hash", "bucket", "offset", "n tokens.x")]
    )
    return spark.createDataFrame([(i, t, *["extra"] * 11) for i, t in TEXTS], schema)


def no_rows(spark):
    return edge_rows(spark).where("false")


def documents(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def same_rows(got, want):
    """Equal as multisets."""
    assert sorted(map(str, got)) == sorted(map(str, want))
