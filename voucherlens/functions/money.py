"""Column expressions for amounts, rates and their printed form.

Exact work is done in *units*, whole numbers of the last decimal place of a column's own type:
cents for ``decimal(12,2)``, ten-thousandths for ``decimal(18,4)``. Floating-point columns have
no last place and are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voucherlens import schema as S

# Units of columns up to this many digits are longs; thirty of them still add up in a long.
LONG_DIGITS = 16
# Amounts of up to this many digits are printed by short expressions.
PRINTED_DIGITS = 18


def exact_type(df: DataFrame, column: str) -> T.DecimalType:
    """The decimal type of a column; whole numbers count as decimals without fraction."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        return kind
    if isinstance(kind, T.IntegralType):
        return T.DecimalType(19, 0)
    raise TypeError(f"{column} is {kind.simpleString()}; cast it to a decimal type first, amounts "
                    "are added and compared exactly")


def units(amount: Column, kind: T.DecimalType = S.MONEY) -> Column:
    """An amount of type ``kind`` as a whole number of its last decimal place (exact)."""
    scaled = amount * F.lit(10 ** kind.scale) if kind.scale else amount
    small = kind.precision <= LONG_DIGITS
    return scaled.cast("long" if small else T.DecimalType(38, 0))


def from_units(number: Column, kind: T.DecimalType = S.MONEY) -> Column:
    """A sum of units as a decimal amount again."""
    exact = number.cast(T.DecimalType(38 - kind.scale, 0))
    return (exact * F.lit(1).cast("decimal(1,0)") / F.lit(10 ** kind.scale)
            if kind.scale else exact)


def is_wide(kind: T.DecimalType) -> bool:
    """Whether amounts, or sums of them, may have more digits than the short forms below take."""
    return kind.precision > PRINTED_DIGITS


def text2(x: Column, wide: bool = False) -> Column:
    """A number with two decimals, e.g. ``1234.50``."""
    return x.cast("decimal(38,2)" if wide else "decimal(18,2)").cast("string")


def mean_text2(total: Column, n: Column, wide: bool = False) -> Column:
    """The exact mean ``total / n`` with two decimals; halves go to the even digit.

    Wide totals are divided with a remainder, as a quotient of theirs would not have the places
    to see a half.
    """
    if not wide:
        return F.bround(total.cast("decimal(28,6)") / n.cast("decimal(18,0)"), 2).cast("string")
    cents = total * F.lit(100)
    whole = n.cast("decimal(18,0)")
    rest = F.pmod(cents, whole)
    down = ((cents - rest).cast("decimal(38,0)") / whole).cast("decimal(38,0)")
    odd = F.pmod(down, F.lit(2).cast("decimal(1,0)")) == 1
    up = (rest * 2 > whole) | ((rest * 2 == whole) & odd)
    nearest = (down + F.when(up, 1).otherwise(0).cast("decimal(1,0)")).cast("decimal(38,0)")
    return (nearest / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,2)").cast("string")


def mean(total: Column, n: Column, scale: int = 2) -> Column:
    """The mean ``total / n`` as the double nearest to it; NULL when ``n`` is 0.

    ``total`` has ``scale`` decimals. Both sides are made whole numbers first, so that there is
    one rounding and not two.
    """
    shift = F.lit(10 ** scale)
    return (total * shift).cast("double") / F.nullif(n * shift, F.lit(0)).cast("double")


def mean2(total: Column, n: Column) -> Column:
    """The exact mean ``total / n`` rounded to two decimals; halves go away from zero."""
    return F.round(total / F.nullif(n, F.lit(0)), 2)


def pct2(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` rounded to two decimals; NULL when ``whole`` is 0."""
    return F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), 2)
