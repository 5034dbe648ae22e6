from backhaul.functions.money import coerce_money
from backhaul.functions.text import coerce_flag, normalize_condition, normalize_reason, null_tokens, strip
from backhaul.functions.time import days_between, micros, month_of, trailing_months

__all__ = [
    "coerce_flag",
    "coerce_money",
    "days_between",
    "micros",
    "month_of",
    "normalize_condition",
    "normalize_reason",
    "null_tokens",
    "strip",
    "trailing_months",
]
