"""Text clean-up as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from backhaul.schemas import CONDITIONS

# Spellings of each return reason.
REASON_ALIASES = {
    "defective": "defective",
    "broken": "defective",
    "damaged": "defective",
    "wrong size": "wrong_size",
    "wrong_size": "wrong_size",
    "sizing": "wrong_size",
    "not as described": "not_as_described",
    "not_as_described": "not_as_described",
    "misrepresented": "not_as_described",
    "changed mind": "changed_mind",
    "changed_mind": "changed_mind",
    "buyer remorse": "changed_mind",
    "late": "late_delivery",
    "late_delivery": "late_delivery",
    "duplicate": "duplicate",
}

# Spellings of each received condition.
CONDITION_ALIASES = {
    "new": "new_unopened",
    "sealed": "new_unopened",
    "unopened": "new_unopened",
    "opened": "opened_unused",
    "lightly used": "used",
    "used": "used",
    "broken": "damaged",
    "damaged": "damaged",
}

# Cell texts that pandas reads as missing.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Every character Python counts as whitespace; all lie below U+3001.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Trim Unicode whitespace; Spark's plain `trim` removes only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def null_tokens(text: Column) -> Column:
    return F.when(~text.isin(*NA_TOKENS), text)


def _canonical(text: Column, aliases: dict[str, str], default: str) -> Column:
    lookup = F.create_map(*map(F.lit, chain.from_iterable(aliases.items())))
    return F.coalesce(F.try_element_at(lookup, F.lower(strip(text.cast("string")))), F.lit(default))


def normalize_reason(text: Column) -> Column:
    """Canonical return reason; null and unknown spellings become `other`."""
    return _canonical(text, REASON_ALIASES, "other")


def normalize_condition(text: Column, keep_canonical: bool = False) -> Column:
    """Canonical received condition; null and unknown spellings become `used`.

    Most canonical names are not spellings of themselves, so a second pass turns
    `new_unopened` into `used`. `keep_canonical` lets canonical names through.
    """
    aliases = dict(CONDITION_ALIASES)
    if keep_canonical:
        aliases |= {c: c for c in CONDITIONS}
    return _canonical(text, aliases, "used")


def coerce_flag(flag: Column) -> Column:
    """Boolean from a boolean, number or text; null and unreadable values become false."""
    text = strip(flag.cast("string"))
    number = F.nanvl(text.try_cast("double"), F.lit(0.0))
    return F.coalesce(text.try_cast("boolean"), number != F.lit(0.0), F.lit(False))
