"""Cleaning of the raw returns table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from backhaul.functions import coerce_flag, coerce_money, normalize_condition, normalize_reason
from backhaul.operators.dedupe import dedupe_returns
from backhaul.sources.csv import SEQ

# Amounts that are coerced when present.
MONEY_COLUMNS = ("refund_amount", "restocking_fee", "processing_cost", "recovered_value")


def normalize_returns(raw: DataFrame, keep_canonical: bool = False) -> DataFrame:
    """Clean every column; one output row per input row."""
    flag = coerce_flag(F.col("fraud_flagged")) if "fraud_flagged" in raw.columns else F.lit(False)
    changes = {
        "return_reason": normalize_reason(F.col("return_reason")),
        "condition_received": normalize_condition(F.col("condition_received"), keep_canonical),
        "fraud_flagged": flag,
    }
    for c in MONEY_COLUMNS:
        if c in raw.columns:
            changes[c] = coerce_money(F.col(c), isinstance(raw.schema[c].dataType, StringType))
    if "disposition" not in raw.columns:
        changes["disposition"] = F.lit(None).cast("string")
    return raw.withColumns(changes)


def transform_returns(raw: DataFrame, seq: str = SEQ, keep_canonical: bool = False) -> DataFrame:
    """Cleaned returns, latest row per `return_id`."""
    return normalize_returns(raw, keep_canonical).transform(dedupe_returns, seq)
