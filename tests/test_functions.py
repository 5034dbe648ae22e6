from __future__ import annotations

from random import Random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from backhaul.functions import (
    coerce_flag,
    coerce_money,
    days_between,
    month_of,
    normalize_condition,
    normalize_reason,
    strip,
    trailing_months,
)
from backhaul.functions.text import CONDITION_ALIASES, REASON_ALIASES, WHITESPACE
from backhaul.session import configure_tables
from backhaul.schemas import CONDITIONS, RETURN_REASONS
from conftest import day


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_reason_spellings(spark):
    given_ = ["Broken", "wrong size", "Buyer Remorse", "weird thing", None, "late", "late delivery", "LATE_DELIVERY"]
    assert apply(spark, normalize_reason, given_) == [
        "defective", "wrong_size", "changed_mind", "other", "other", "late_delivery", "other", "late_delivery",
    ]


def test_reasons_stay_within_domain(spark):
    spellings = [*REASON_ALIASES, "", "other", "anything"]
    assert set(apply(spark, normalize_reason, spellings)) == set(RETURN_REASONS)


def test_condition_spellings(spark):
    given_ = ["New", "opened", "lightly used", "BROKEN", None, "what"]
    expected = ["new_unopened", "opened_unused", "used", "damaged", "used", "used"]
    assert apply(spark, normalize_condition, given_) == expected
    assert set(apply(spark, normalize_condition, list(CONDITION_ALIASES))) <= set(CONDITIONS)


def test_canonical_conditions_pass_only_on_request(spark):
    names = ["new_unopened", "opened_unused", "missing_parts"]
    assert apply(spark, normalize_condition, names) == ["used"] * 3
    assert apply(spark, lambda c: normalize_condition(c, keep_canonical=True), names) == names


def test_strip_removes_what_python_strips(spark):
    padded = ["\t late\n", " late ", " 　la te\x85", "late\x1f", WHITESPACE + "x" + WHITESPACE, ""]
    assert apply(spark, strip, padded) == [s.strip() for s in padded]
    assert apply(spark, normalize_reason, ["\tLate "]) == ["late_delivery"]


def test_money_literals(spark):
    texts = ["10.555", None, "oops", "1,000", "1_000", "0x10", " 2.5 ", "1e3", "0.125", "1.015", "2.5d", "1F",
             "0x1p3", "nan", "-3.456", "inf", "-Infinity", "5.", ".5"]
    assert apply(spark, coerce_money, texts) == [
        10.56, 0.0, 0.0, 0.0, 0.0, 0.0, 2.5, 1000.0, 0.12, 1.01, 0.0, 0.0,
        0.0, 0.0, -3.46, float("inf"), float("-inf"), 5.0, 0.5,
    ]


def test_money_from_numbers(spark):
    numbers = [10.555, None, float("nan"), 0.125]
    as_number = lambda c: coerce_money(c, is_text=False)
    assert apply(spark, as_number, numbers, "double") == [10.56, 0.0, 0.0, 0.12]


def test_money_agrees_with_pandas(spark):
    """Amounts up to ten million and random mixes of the characters numbers are made of."""
    random = Random(7)
    texts = [repr(random.uniform(-1e7, 1e7)) for _ in range(2000)]
    texts += [f"{random.randint(-99999, 99999) / 1000}" for _ in range(2000)]
    texts += ["".join(random.choices("0123456789.e+-dfx_ ", k=random.randint(1, 6))) for _ in range(6000)]
    ours = np.array(apply(spark, coerce_money, texts))
    theirs = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce").fillna(0.0).round(2).to_numpy(float)
    # Beyond 1e15 the two parsers may differ in the last bit.
    differ = [(t, a, b) for t, a, b in zip(texts, ours, theirs) if a != b and not abs(a - b) <= 1e-15 * abs(b)]
    assert differ == []


def test_flags(spark):
    texts = ["True", "false", None, "1", "0", "1.0", "junk", " TRUE "]
    assert apply(spark, coerce_flag, texts) == [True, False, False, True, False, True, False, True]
    assert apply(spark, coerce_flag, [True, False, None], "boolean") == [True, False, False]


def test_days_are_fractional(spark):
    df = spark.createDataFrame([("2025-01-03 12:00:00", "2025-01-01 00:00:00")], "a string, b string")
    a, b = F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")
    assert df.select(days_between(a, b), days_between(b, a)).first() == (2.5, -2.5)


def test_month_keeps_zone_less_type(spark):
    df = spark.sql("select timestamp_ntz'2025-03-30 02:30:00' as t").select(month_of(F.col("t")).alias("m"))
    assert df.schema["m"].dataType.typeName() == "timestamp_ntz"
    assert df.first()["m"] == day("2025-03-01")


@pytest.mark.parametrize(
    "as_of, months, start",
    [("2025-08-31T10:00:00", 6, "2025-02-01"), ("2025-03-15", 12, "2024-03-01"), ("2024-12-31", 6, "2024-06-01")],
)
def test_trailing_months_start_on_the_first(spark, as_of, months, start):
    df = spark.sql(
        f"select timestamp_ntz'{start} 00:00:00' as t union all select timestamp_ntz'{start} 00:00:00' - interval '1' second"
    )
    kept = df.where(trailing_months(F.col("t"), months, day(as_of))).collect()
    assert [r.t for r in kept] == [day(start)]


def test_methods_for_queries_over_tables_are_compiled(spark):
    """The JVM compiles no method of more than 8000 bytes; a session's own limit stays."""
    one, own = configure_tables(spark.newSession()), spark.newSession()
    assert one.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    assert one.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    own.conf.set("spark.sql.codegen.hugeMethodLimit", "20000")
    assert configure_tables(own).conf.get("spark.sql.codegen.hugeMethodLimit") == "20000"
