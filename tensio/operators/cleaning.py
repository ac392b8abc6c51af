"""Cleaning and relevance operators (DataFrame → DataFrame).

Order matters for two reasons that a Spark user has to state explicitly:

* "keep the first row" needs an order key, because a DataFrame has no row order;
* a filter on a column computed from ``cleaned_text`` is pushed below the projection that
  made it, and every ``contains`` then carries its own copy of the regex chain.
  ``with_clean_text`` therefore ends in a one-element ``explode``, which Catalyst does not
  push filters through or collapse projections across, so the chain runs once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tensio.functions import text as T
from tensio.functions.lexicons import PROFILE_V2, ScoreProfile

CLEAN = "cleaned_text"
SCORE = "relevance_score"


def _c(name: str) -> Column:
    """A top-level column by its exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], copies_col: str | None = None) -> DataFrame:
    """Keep, for each distinct ``keys`` value, the row that comes first by ``order``.

    Written as an aggregate (``min`` of a struct led by the order key), so Spark combines map-side
    before the shuffle: a key holding a large share of all rows is reduced to one row per
    input partition, instead of sending all its copies to one task as a window would.
    NULL keys form one group (one NULL row survives), as with an in-memory dedupe.
    ``copies_col`` optionally keeps the number of rows each survivor stands for.
    """
    keys = list(keys)
    names, maps = list(df.columns), [f.name for f in df.schema.fields if isinstance(f.dataType, MapType)]
    if maps:  # a map has no order; its entries have
        df = df.withColumns({c: F.map_entries(_c(c)) for c in maps})
    rest = [c for c in names if c not in keys]
    # min over (order, then every other column): the order key decides, and rows that tie on
    # it are still told apart by their values, so a recomputed task picks the same row.
    ranked = F.struct(*[_c(c).alias(f"_o{i}") for i, c in enumerate(order)], *[_c(c).alias(c) for c in rest])
    aggs = [F.min(ranked).alias("_first")]
    if copies_col:
        aggs.append(F.count(F.lit(1)).alias(copies_col))
    # A fixed-width hash as the leading key lets the sort/hash of wide text keys compare
    # 8 bytes first; the key itself stays in the grouping, so the result is exact.
    out = df.groupBy(F.xxhash64(*[_c(k) for k in keys]).alias("_key_hash"), *[_c(k) for k in keys]).agg(*aggs)
    by_name = {k: _c(k) for k in keys}
    by_name.update({c: F.col("_first").getField(c) for c in rest})
    if copies_col:
        by_name[copies_col] = _c(copies_col)
    by_name.update({c: F.map_from_entries(by_name[c]) for c in maps})
    ordered = names + ([copies_col] if copies_col else [])
    # restore the input column order
    return out.select(*[by_name[c].alias(c) for c in ordered])


def drop_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def drop_stats(df: DataFrame, key: str) -> DataFrame:
    """Rows before, rows dropped (NULL key) and rows kept, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(F.col(key).isNull()).alias("dropped_rows"),
        F.count(F.col(key)).alias("kept_rows"),
    )


def with_clean_text(df: DataFrame, text_col: str, out: str = CLEAN) -> DataFrame:
    """Add the cleaned text behind an evaluation barrier (see module docstring)."""
    return df.select("*", F.explode(F.array(T.clean_text(text_col))).alias(out))


def with_term_counts(df: DataFrame, profile: ScoreProfile = PROFILE_V2, text: str = CLEAN) -> DataFrame:
    """``<family>_term_count`` for every family of the profile."""
    return df.select(
        "*", *[T.term_count(text, terms).alias(f"{fam}_term_count") for fam, terms in profile.families.items()]
    )


def with_found_terms(df: DataFrame, profile: ScoreProfile = PROFILE_V2, text: str = CLEAN) -> DataFrame:
    """``<family>_terms_found``: matched terms in dictionary order, or ``'none'``."""
    return df.select(
        "*", *[T.found_terms(text, terms).alias(f"{fam}_terms_found") for fam, terms in profile.families.items()]
    )


def with_score(df: DataFrame, profile: ScoreProfile = PROFILE_V2, text: str = CLEAN) -> DataFrame:
    """Relevance score from the term-count columns (added when missing)."""
    if not all(f"{fam}_term_count" in df.columns for fam in profile.families):
        df = with_term_counts(df, profile, text)
    counts = {fam: F.col(f"{fam}_term_count") for fam in profile.families}
    score = F.when(F.col(text) == "", F.lit(0.0)).otherwise(T.relevance_from_counts(counts, profile))
    return df.withColumn(SCORE, score)


def relevant(df: DataFrame, profile: ScoreProfile = PROFILE_V2) -> DataFrame:
    return df.filter(F.col(SCORE) >= F.lit(profile.threshold))


def score_posts(df: DataFrame, text_col: str, profile: ScoreProfile = PROFILE_V2) -> DataFrame:
    """Clean, count and score every row (no filter, no found-term strings)."""
    return with_score(with_term_counts(with_clean_text(df, text_col), profile), profile)


def relevant_posts(df: DataFrame, text_col: str, profile: ScoreProfile = PROFILE_V2) -> DataFrame:
    """Cleaned, scored rows at or above the profile's threshold, with found-term strings.

    Found-term strings are built after the filter, so only kept rows pay for them.
    """
    return with_found_terms(relevant(score_posts(df, text_col, profile), profile), profile)


def clean_dataset(df: DataFrame, text_col: str, order: Sequence[str], profile: ScoreProfile = PROFILE_V2) -> DataFrame:
    """Dedupe on raw text (first row wins) → clean → score → threshold → found terms + counts.

    Output: the input columns, ``cleaned_text``, ``relevance_score``, four ``*_terms_found``
    and four ``*_term_count`` columns.
    """
    # The score follows from the text alone, so filtering first keeps the same rows, and only
    # the relevant ones go through the dedupe's shuffle.
    deduped = dedupe_first(relevant(score_posts(df, text_col, profile), profile), [text_col], order)
    scored = with_found_terms(deduped, profile)
    fams = list(profile.families)
    cols = (
        list(df.columns)
        + [CLEAN, SCORE]
        + [f"{f}_terms_found" for f in fams]
        + [f"{f}_term_count" for f in fams]
    )
    return scored.select(*[_c(c) for c in cols])


def stage_counts(df: DataFrame, text_col: str, profile: ScoreProfile = PROFILE_V2) -> DataFrame:
    """Raw, deduplicated and kept row counts from a single pass over the data."""
    kept = with_score(with_term_counts(with_clean_text(df.select(_c(text_col).alias(text_col)), text_col), profile), profile)
    # A digest stands for the text in the exchange; all copies of a text have one score.
    groups = kept.groupBy(F.sha2(_c(text_col), 256).alias("_digest")).agg(
        F.count(F.lit(1)).alias("_copies"), F.first(F.col(SCORE) >= F.lit(profile.threshold)).alias("_keep")
    )
    return groups.agg(
        F.sum("_copies").alias("raw_rows"),
        F.count(F.lit(1)).alias("deduped_rows"),
        F.count_if("_keep").alias("kept_rows"),
    )


def score_describe(df: DataFrame, col: str = SCORE) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (linear interpolation), max — exact."""
    c = F.col(col)
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        q.alias("_q"),
        F.max(c).alias("max"),
    ).select(
        "count", "mean", "std", "min",
        F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"),
        "max",
    )


def term_count_means(df: DataFrame, profile: ScoreProfile = PROFILE_V2) -> DataFrame:
    return df.agg(*[F.avg(f"{fam}_term_count").alias(f"avg_{fam}_terms") for fam in profile.families])


def preview(df: DataFrame, text_col: str, order: Sequence[str], n: int = 3, width: int = 100) -> DataFrame:
    """The first ``n`` kept rows: texts cut to ``width`` characters plus ``...``, score to 2 places."""
    return (
        df.orderBy(*order)
        .limit(n)
        .select(
            *[F.col(c) for c in order],
            F.concat(F.substring(text_col, 1, width), F.lit("...")).alias("original_preview"),
            F.concat(F.substring(CLEAN, 1, width), F.lit("...")).alias("cleaned_preview"),
            F.format_number(F.col(SCORE), 2).alias("score_text"),
            *[F.col(c) for c in df.columns if c.endswith("_terms_found")],
        )
    )
