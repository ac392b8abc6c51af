"""Exact order statistics of a column of any size, by refining a histogram.

``percentile`` keeps a map of all distinct values in one task.  Here a double becomes a 64-bit
integer of the same order, and a rank is found by its leading bits: each pass counts the values
below every 12 further bits of the wanted prefixes (combined map-side, at most 4,096 counts per
rank), and stops for a rank as soon as its bin holds one value or few rows.  Six passes at most,
each reading the one column; a column of few distinct values needs one or two.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tensio.session import ship_package

DIGIT_BITS = 12
#: A bin of at most so many rows is fetched and ordered.
FEW_ROWS = 10_000


def order_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 counts as 0.0)."""
    bits = (values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) ^ np.int64(-(2**63))


@F.arrow_udf(TY.LongType())
def _order_key(values: pa.Array) -> pa.Array:
    return pa.array(order_bits(values.to_numpy(zero_copy_only=False)))


def values_at(df: DataFrame, col: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at the 0-based ``ranks`` of the ordered column, NULL and NaN left out."""
    ship_package(df.sparkSession)
    v = F.col(f"`{col}`").cast("double")
    keyed = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).select("v", _order_key("v").alias("key"))
    found: dict[int, float] = {}
    few: list[tuple[int, int, int, int]] = []  # (rank, rank within the bin, prefix, bits below the prefix)
    open_ranks = {int(r): (0, int(r)) for r in set(ranks)}  # rank -> (prefix, rank within it)
    shift = 64
    while open_ranks and shift > 0:
        below, shift = shift, max(shift - DIGIT_BITS, 0)
        prefix = F.lit(0).cast("long") if below == 64 else F.shiftrightunsigned("key", below)
        wanted = sorted({p for p, _ in open_ranks.values()})
        digit = F.shiftrightunsigned("key", shift).alias("bin")
        bins = keyed.where(prefix.isin(wanted)).groupBy(prefix.alias("prefix"), digit).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        by_prefix: dict[int, list] = {}
        for r in bins.collect():  # at most 2**DIGIT_BITS rows for each wanted prefix
            by_prefix.setdefault(r["prefix"], []).append(r)
        going = {}
        for rank, (p, inner) in open_ranks.items():
            # Bins share their prefix, so only the low bits differ: unsigned order within one prefix.
            for r in sorted(by_prefix[p], key=lambda r: r["bin"] % (1 << 64)):
                if inner < r["n"]:
                    break
                inner -= r["n"]
            if r["low"] == r["high"]:
                found[rank] = r["low"]
            elif r["n"] <= FEW_ROWS:
                few.append((rank, inner, r["bin"], shift))
            else:
                going[rank] = (r["bin"], inner)
        open_ranks = going
    for b, s in sorted({(b, s) for _, _, b, s in few}):
        rows = np.sort(np.array([r["v"] for r in keyed.where((F.shiftrightunsigned("key", s) if s else F.col("key")) == b).select("v").collect()]))
        for rank, inner, bin_, shift_ in few:
            if (bin_, shift_) == (b, s):
                found[rank] = float(rows[inner])
    return found


def describe_column(df: DataFrame, col: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row: ``count, mean, std`` (n-1), ``min``, a column per quantile (``p25`` …), ``max``.

    Quantiles interpolate between the two neighbouring values.  NULL and NaN do not count; an
    empty column has a count of 0 and NULLs.
    """
    v = F.col(f"`{col}`").cast("double")
    real = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    total = real.agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).first()
    n = total["count"]
    places = [q * (n - 1) for q in quantiles]
    at = values_at(real, "v", [r for p in places for r in (math.floor(p), math.ceil(p))]) if n else {}
    between = [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places] if n else [None] * len(places)
    names = [f"p{q * 100:g}" for q in quantiles]
    fields = ", ".join(["count long", "mean double", "std double", "min double", *[f"`{c}` double" for c in names], "max double"])
    return df.sparkSession.createDataFrame([(n, total["mean"], total["std"], total["min"], *between, total["max"])], fields)
