"""Lexicon polarity/subjectivity per post and the weak three-class label.

The per-row polarity library of the original work is re-aimed: the user brings a lexicon
DataFrame ``(word, polarity, subjectivity)``; a post's polarity and subjectivity are the
means over its tokens found in the lexicon (every occurrence counts), both 0 without a
hit.  Lexicon values are taken at 6-decimal precision (integer micro-units); a mean is the
exact integer quotient rounded half away from zero to a micro-unit, so every engine and
every execution path gives the same double, which the label rule compares with ±0.1.

Three physical shapes, chosen by the lexicon's size (counted, not assumed):

* tiny lexicon (≤ ``expression_limit`` words): a literal map in the plan, looked up per
  token with built-in higher-order functions — JVM only, no shuffle;
* small lexicon (≤ ``broadcast_limit`` words): shipped once per executor as a broadcast
  dictionary and applied to each row's token array by an Arrow-batched pandas UDF — no
  shuffle, the post stays in its partition;
* large lexicon: tokens are exploded with the post key, joined to the lexicon (hashed,
  its part of each partition), summed per post and joined back to the posts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.functions import text as T
from tensio.functions.lexicons import POLARITY_MARGIN, SUBJECTIVITY_CUT
from tensio.operators.partitioning import materialize, share

LEXICON_EXPRESSION_LIMIT = 64
LEXICON_BROADCAST_LIMIT = 200_000
MICRO = 1_000_000

_SCORE_TYPE = TY.StructType(
    [
        TY.StructField("polarity", TY.DoubleType()),
        TY.StructField("subjectivity", TY.DoubleType()),
        TY.StructField("lexicon_hits", TY.IntegerType()),
    ]
)


def normalised(lexicon: DataFrame) -> DataFrame:
    """``(word, pu, su)``: one row per word, values in integer micro-units.

    The same rule for a lexicon of any size: values are rounded half away from zero at 6
    decimals; entries with a NULL word or value are no entries; of a word's entries the smallest
    (polarity, then subjectivity) counts.
    """
    micro = lexicon.select("word", *[F.round(F.col(c).cast("double") * F.lit(float(MICRO))).cast("long").alias(n) for c, n in (("polarity", "pu"), ("subjectivity", "su"))])
    one = micro.dropna().groupBy("word").agg(F.min(F.struct("pu", "su")).alias("v"))
    return one.select("word", "v.pu", "v.su")


def mean_micro(total: int, n: int) -> int:
    """``total / n`` rounded half away from zero to an integer (exact integer arithmetic)."""
    if total >= 0:
        return (2 * total + n) // (2 * n)
    return -((-2 * total + n) // (2 * n))


def _mean_sql(total: str, n: str) -> Column:
    """Spark form of ``mean_micro(total, n) / MICRO`` over long columns."""
    q = (
        f"CASE WHEN {total} >= 0 THEN (2 * {total} + {n}) div (2 * {n}) "
        f"ELSE -((-2 * {total} + {n}) div (2 * {n})) END"
    )
    return F.expr(q).cast("double") / F.lit(float(MICRO))


def _make_scorer(bc):
    @F.pandas_udf(_SCORE_TYPE)
    def score(tokens: pd.Series) -> pd.DataFrame:
        lex = bc.value
        pol, sub, hits = [], [], []
        for arr in tokens:
            sp = ss = n = 0
            if arr is not None:
                for w in arr:
                    v = lex.get(w)
                    if v is not None:
                        sp += v[0]
                        ss += v[1]
                        n += 1
            if n:
                pol.append(mean_micro(sp, n) / MICRO)
                sub.append(mean_micro(ss, n) / MICRO)
            else:
                pol.append(0.0)
                sub.append(0.0)
            hits.append(n)
        return pd.DataFrame({"polarity": pol, "subjectivity": sub, "lexicon_hits": hits})

    return score


def _expression_scores(df: DataFrame, tokens: Column, table: dict[str, tuple[int, int]]) -> DataFrame:
    """Tiny lexicon as a literal map: per-token lookup and sums with higher-order functions."""
    entries = []
    for word, (pu, su) in table.items():
        entries += [F.lit(word), F.struct(F.lit(pu).cast("long").alias("pu"), F.lit(su).cast("long").alias("su"))]
    lex_map = F.create_map(*entries)
    found = F.filter(F.transform(tokens, lambda w: F.try_element_at(lex_map, w)), lambda v: v.isNotNull())
    zero = F.lit(0).cast("long")
    staged = df.withColumn("_found", F.coalesce(found, F.array().cast("array<struct<pu:bigint,su:bigint>>")))
    staged = staged.withColumn("_sp", F.aggregate("_found", zero, lambda acc, v: acc + v["pu"]))
    staged = staged.withColumn("_ss", F.aggregate("_found", zero, lambda acc, v: acc + v["su"]))
    staged = staged.withColumn("_n", F.size("_found").cast("long"))
    hit = F.col("_n") > 0
    return staged.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(hit, _mean_sql("_sp", "_n")).otherwise(F.lit(0.0)).alias("polarity"),
        F.when(hit, _mean_sql("_ss", "_n")).otherwise(F.lit(0.0)).alias("subjectivity"),
        F.col("_n").cast("int").alias("lexicon_hits"),
    )


def lexicon_scores(
    df: DataFrame,
    tokens: Column,
    lexicon: DataFrame,
    key: str,
    broadcast_limit: int = LEXICON_BROADCAST_LIMIT,
    expression_limit: int = LEXICON_EXPRESSION_LIMIT,
) -> DataFrame:
    """Add ``polarity``, ``subjectivity`` and ``lexicon_hits`` computed from ``tokens``.

    ``key`` must identify a row of ``df`` (used by the large-lexicon path only).
    """
    lex = normalised(lexicon)
    if lexicon.limit(broadcast_limit + 1).count() > broadcast_limit:
        lex = materialize(lex)  # read by the fetch and, if large, by the join
    # one bounded fetch decides the path: more than broadcast_limit rows means "large"
    head = lex.limit(broadcast_limit + 1).collect()
    if len(head) <= broadcast_limit:
        table = {r["word"]: (r["pu"], r["su"]) for r in head}
        if 0 < len(table) <= expression_limit:
            return _expression_scores(df, tokens, table)
        scorer = _make_scorer(share(df.sparkSession, table))
        return df.withColumn("_lex", scorer(tokens)).select(
            "*", "_lex.polarity", "_lex.subjectivity", "_lex.lexicon_hits"
        ).drop("_lex")
    micro = lex.select("word", F.col("pu").alias("_pu"), F.col("su").alias("_su"))
    df = materialize(df)  # read twice below: the rows are cleaned once
    exploded = df.select(F.col(key).alias("_k"), F.explode(tokens).alias("word"))
    sums = (
        exploded.join(micro.hint("shuffle_hash"), "word")  # words differ, so they spread evenly; the tokens are not sorted
        .groupBy("_k")
        .agg(F.sum("_pu").alias("_sp"), F.sum("_su").alias("_ss"), F.count(F.lit(1)).alias("_n"))
    )
    per_post = sums.select(
        "_k",
        _mean_sql("_sp", "_n").alias("polarity"),
        _mean_sql("_ss", "_n").alias("subjectivity"),
        F.col("_n").cast("int").alias("lexicon_hits"),
    )
    out = df.join(per_post, F.col(f"`{key}`") == F.col("_k"), "left").drop("_k")
    return out.fillna({"polarity": 0.0, "subjectivity": 0.0, "lexicon_hits": 0}, subset=["polarity", "subjectivity", "lexicon_hits"])


def weak_label(polarity: Column | str, subjectivity: Column | str) -> Column:
    """0 positive, 1 neutral, 2 negative; no lexicon hit (0, 0) is negative."""
    p = F.col(polarity) if isinstance(polarity, str) else polarity
    s = F.col(subjectivity) if isinstance(subjectivity, str) else subjectivity
    return (
        F.when(p > F.lit(POLARITY_MARGIN), F.lit(0))
        .when(p < F.lit(-POLARITY_MARGIN), F.lit(2))
        .when((s < F.lit(SUBJECTIVITY_CUT)) & (p <= F.lit(0.0)), F.lit(2))
        .otherwise(F.lit(1))
    )


def label_posts(df: DataFrame, lexicon: DataFrame, key: str, text_col: str = "cleaned_text", out: str = "sentiment") -> DataFrame:
    """Score the cleaned text against the lexicon and add the weak label column."""
    scored = lexicon_scores(df, T.space_tokens(text_col), lexicon, key)
    return scored.withColumn(out, weak_label("polarity", "subjectivity"))


def class_histogram(df: DataFrame, label: str = "sentiment") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
