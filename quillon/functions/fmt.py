"""Text form of results: checksums by one space, ``NULL`` for an empty sum and for zero."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_64 = Decimal(2**64)


def checksum_line(df: DataFrame) -> Column:
    """A string column made of the sums ``s0, s1, ...`` of ``df``."""
    return F.concat_ws(" ", *(F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit("NULL")) for c in df.columns))


def format_row(values) -> str:
    return " ".join(str(v) if v else "NULL" for v in values)


def wrapping(column: Column) -> Column:
    """A whole number (bigint, or decimal of scale 0) modulo 2**64, as decimal(20,0)."""
    return F.pmod(column.cast("decimal(38,0)"), F.lit(TWO_64)).cast("decimal(20,0)")


def wrapping_sum(column: Column) -> Column:
    """SUM modulo 2**64, as decimal(20,0).

    Values are reduced first; their sum has 38 digits, which 10**18 rows do not fill.
    """
    return wrapping(F.sum(wrapping(column).cast("decimal(28,0)")))
