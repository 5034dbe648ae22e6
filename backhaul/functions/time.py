"""Zone-less timestamp arithmetic as column expressions (session zone UTC)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from `earlier` to `later`."""
    return (micros(later) - micros(earlier)) / F.lit(float(DAY_MICROS))


def month_of(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def trailing_months(ts: Column, months: int, as_of: datetime | None) -> Column:
    """True from the first day of the month `months` before `as_of` (default: now) on."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of.isoformat()).cast("timestamp_ntz")
    return ts >= F.add_months(F.trunc(now, "month"), -months).cast("timestamp_ntz")
