"""Money amounts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java reads type suffixes ("2.5d") and hex floats ("0x1p3") that are not amounts.
JAVA_ONLY_NUMBER = r"[xX]|[0-9.]\s*[dDfF]\s*$"


def coerce_money(amount: Column, is_text: bool = True) -> Column:
    """Amount as a double with two decimals; null, unreadable and overflowing values become 0.

    Rounds half to even on the binary value scaled by 100, as NumPy does: 0.125 gives 0.12.
    An amount spelled infinite stays infinite here and becomes null in a DECIMAL column.
    """
    value = amount.try_cast("double")
    if is_text:
        overflowed = (F.abs(value) == float("inf")) & ~F.lower(amount).contains("inf")
        value = F.when(~amount.rlike(JAVA_ONLY_NUMBER) & ~overflowed, value)
    value = F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
    return F.rint(value * 100) / 100
