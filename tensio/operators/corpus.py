"""Corpus preparation across sources (platform files): union, length filter, clean dedupe."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.functions.lexicons import MIN_TEXT_LENGTH
from tensio.operators import arrow_text
from tensio.operators.cleaning import CLEAN, dedupe_first
from tensio.session import ship_package


def union_sources(frames: Sequence[tuple[str, DataFrame]], rank_col: str = "source_rank", name_col: str = "platform") -> DataFrame:
    """Union tables with different columns by name; missing columns become NULL.

    Each input is tagged with its name and its position (``source_rank``), which later
    serves as the "earlier file wins" order.
    """
    if not frames:
        raise ValueError("no sources given")
    tagged = [
        df.withColumn(name_col, F.lit(name)).withColumn(rank_col, F.lit(i).cast("int"))
        for i, (name, df) in enumerate(frames)
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def min_length(df: DataFrame, col: str = CLEAN, min_len: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Keep texts strictly longer than ``min_len`` characters."""
    return df.filter(F.length(col) > F.lit(min_len))


def dedupe_cross_source(df: DataFrame, order: Sequence[str], key: str = CLEAN, rank_col: str = "source_rank") -> DataFrame:
    """Drop repeated cleaned texts across sources; the earliest source, then row, wins."""
    return dedupe_first(df, [key], [rank_col, *order])


def clean_batches(df: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """``cleaned_text`` and the columns of ``keep``: ``with_clean_text`` a batch at a time.

    Spark lower-cases the text; the rest of the cleaning is numpy passes over a batch's bytes.
    """
    ship_package(df.sparkSession)
    # kept columns pass through under neutral names, so any name will do
    source = df.select(F.lower(F.col(f"`{text_col}`")).alias("_lowered"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    schema = TY.StructType([TY.StructField(CLEAN, TY.StringType()), *source.schema.fields[1:]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([arrow_text.clean(batch.column(0)), *batch.columns[1:]], names=names)

    return source.mapInArrow(run, schema).select(CLEAN, *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)])


def prepare_corpus(frames: Sequence[tuple[str, DataFrame]], text_col: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per source: clean, keep texts longer than 10 chars; then union, drop NULL, dedupe.

    ``frames`` are ``(platform name, DataFrame)`` pairs in priority order; each must
    have ``text_col`` and the ``order`` columns.  Only the cleaned text, the ``order`` columns
    and those named in ``keep`` go through the dedupe; the raw text does not travel unless
    it is named.
    """
    prepared = []
    for name, df in frames:
        wanted = [CLEAN, *dict.fromkeys([*order, *keep])]
        prepared.append((name, min_length(clean_batches(df, text_col, wanted[1:]))))
    combined = union_sources(prepared).dropna(subset=[CLEAN])
    return dedupe_cross_source(combined, order)
