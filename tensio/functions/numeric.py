"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_places(c: Column | str, digits: int) -> Column:
    """Round to ``digits`` decimal places as Python's ``round`` does: correctly rounded from
    the exact binary value of the double, exact ties to even.

    Spark's ``round`` rounds the shortest decimal form half-up instead, so a mean such as
    0.1109375 (binary value just below the tie) would come out one unit higher.
    ``format_number`` rounds the exact value half-even; its grouping commas are removed and
    the text is read back as a double.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.format_number(col, digits), ",", "").try_cast("double")
