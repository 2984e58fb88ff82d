"""Exact arithmetic on unsigned 64-bit amounts held as decimals.

``div`` on decimals yields BIGINT and wraps beyond 2**63 without an error, so
floors are formed from the remainder instead.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

U64 = "decimal(20,0)"
WIDE = "decimal(38,0)"


def wide(x: Column) -> Column:
    return x.cast(WIDE)


def floor_div(n: Column, d: Column) -> Column:
    """floor(n / d) of non-negative whole decimals; NULL if d is 0."""
    n, d = wide(n), F.nullif(wide(d), F.lit(0).cast(WIDE))
    return wide((n - n % d) / d)


def ceil_div(n: Column, d: Column) -> Column:
    return floor_div(wide(n) + wide(d) - 1, d)


def share_bps(part: Column, total: Column) -> Column:
    """ceil(part * 10000 / total); NULL if the total is 0 or less than the part."""
    return F.when((total > 0) & (part <= total), ceil_div(wide(part) * 10000, total)).cast("int")


def ratio_key(n: Column, d: Column) -> Column:
    """A struct that orders n / d exactly as the fractions do, without cross products.

    Four limbs: the whole part, then three times 18 fractional digits. Two distinct
    fractions with denominators below 2**64 differ by more than 10**-39.
    """
    d = wide(d)
    limbs, rest = [floor_div(n, d)], wide(n) % F.nullif(d, F.lit(0).cast(WIDE))
    for _ in range(3):
        scaled = wide(rest) * F.lit(10**18).cast("decimal(19,0)")
        limbs.append(floor_div(scaled, d))
        rest = wide(scaled) % F.nullif(d, F.lit(0).cast(WIDE))
    return F.struct(*(x.alias(f"l{i}") for i, x in enumerate(limbs)))


def negated(key: Column) -> Column:
    """A ratio key that orders the other way round."""
    return F.struct(*((-key[f"l{i}"]).alias(f"l{i}") for i in range(4)))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative decimals, by a bounded fold.

    Euclid's remainders halve every two steps, so 94 steps settle any 64-bit pair.
    """
    start = F.struct(wide(a).alias("a"), wide(b).alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), wide(s.a % F.nullif(s.b, F.lit(0).cast(WIDE))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(94)), start, step, lambda s: s.a)


_I64 = 2**63 - 1


def change_bps_native(q0: Column, b0: Column, q1: Column, b1: Column) -> Column:
    """trunc(10000 * (q1/b1 / (q0/b0) - 1)) where all products fit 38 digits, else NULL."""
    first, last = F.try_multiply(wide(q0), wide(b1)), F.try_multiply(wide(q1), wide(b0))
    scaled = F.try_multiply(F.abs(last - first), F.lit(10000).cast("decimal(5,0)"))
    size = floor_div(scaled, first)
    fits = (first < F.lit(str(10**33)).cast(WIDE)) & (last < F.lit(str(10**33)).cast(WIDE)) & (first > 0)
    return F.when(fits & (size <= F.lit(_I64).cast(WIDE)), F.when(last >= first, size).otherwise(-size)).cast("long")


@F.pandas_udf(LongType())
def _wide_change(q0: pd.Series, b0: pd.Series, q1: pd.Series, b1: pd.Series) -> pd.Series:
    """The change of rows whose products pass 38 digits; the others come as NULL."""

    def one(a, b, c, d):
        if a is None or not a or not b or not d:
            return None
        first, last = int(a) * int(d), int(c) * int(b)
        size = abs(last - first) * 10000 // first
        return (size if last >= first else -size) if size <= _I64 else None

    return pd.Series([one(*row) for row in zip(q0, b0, q1, b1, strict=True)], dtype="Int64")


def with_price_change(df: DataFrame, q0: str, b0: str, q1: str, b1: str) -> DataFrame:
    """Add price_change_bps in one pass; only rows whose products pass 38 digits have values for Python.

    NULL where a price is missing or the change is beyond 64 bits.
    """
    names = (q0, b0, q1, b1)
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names))
    big = F.coalesce(F.greatest(*(F.col(c) for c in names)) >= F.lit(10**16), F.lit(False)) & known
    wide_ones = _wide_change(*(F.when(big, F.col(c)) for c in names))
    return df.withColumn("price_change_bps", F.when(big, wide_ones).otherwise(change_bps_native(*(F.col(c) for c in names))))
