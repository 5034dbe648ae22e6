from backhaul.operators.dedupe import dedupe_returns
from backhaul.operators.position import with_position
from backhaul.operators.rules import RULES, Rule, compute_all_signals, detect
from backhaul.operators.trailing import with_trailing_count
from backhaul.operators.upsert import insert_if_absent, merge_upsert, update_scores

__all__ = [
    "RULES",
    "Rule",
    "compute_all_signals",
    "dedupe_returns",
    "detect",
    "insert_if_absent",
    "merge_upsert",
    "update_scores",
    "with_position",
    "with_trailing_count",
]
