from __future__ import annotations

from decimal import Decimal
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from backhaul.plans import features, model

FRAME = (
    "return_id long, label boolean, refund_amount decimal(10,2), restocking_fee decimal(10,2), cycle_time_hours int, "
    "return_reason string, return_channel string, condition_received string, days_since_purchase double, customer_lifetime_returns long"
)


def sample(n=400, seed=3):
    random = Random(seed)
    rows = []
    for i in range(n):
        refund = Decimal(random.randint(100, 90000)) / 100
        days = random.uniform(0, 45)
        reason = random.choice(["changed_mind", "defective", "duplicate"])
        risk = 0.002 * float(refund) - 0.05 * days + (1.2 if reason == "duplicate" else 0) + random.gauss(0, 1)
        rows.append(
            (i, risk > 1.0, refund, Decimal(0), random.randint(6, 168), reason, random.choice(["mail", "pickup"]),
             random.choice(["used", "damaged", None]), days, random.randint(0, 12))
        )
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(sample(), FRAME).cache()


@pytest.fixture(scope="module")
def fitted(frame):
    return model.fit(frame)


def design(rows):
    """The same inputs in NumPy: scaled numerics, then one column per sorted category."""
    number = {"refund_amount": 2, "restocking_fee": 3, "cycle_time_hours": 4, "customer_lifetime_returns": 9, "days_since_purchase": 8}
    x = np.array([[float(r[number[c]]) for c in features.NUMERIC_FEATURES] for r in rows])
    std = x.std(axis=0)
    columns = [(x - x.mean(axis=0)) / np.where(std == 0, 1, std)]
    for at in (5, 6, 7):
        values = [r[at] or "__null__" for r in rows]
        columns.append(np.array([[float(v == c) for c in sorted(set(values))] for v in values]))
    return np.hstack(columns)


def test_fit_minimises_the_penalised_loss(frame, fitted):
    rows = sample()
    x, y = design(rows), np.array([r[1] for r in rows], float)
    n, d = x.shape
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    z, penalty = np.hstack([x, np.ones((n, 1))]), np.diag([1.0] * d + [0.0])
    w = np.zeros(d + 1)
    for _ in range(60):  # Newton steps on |w|^2 / 2 + sum of weighted losses
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (weight * (p - y)) + penalty @ w
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, gradient)
    regression = fitted.stages[-1]
    np.testing.assert_allclose(regression.coefficients.toArray(), w[:-1], atol=1e-4)
    assert regression.intercept == pytest.approx(w[-1], abs=1e-4)
    ours = {r.return_id: r.probability for r in model.score(fitted, frame).collect()}
    np.testing.assert_allclose([ours[i] for i in range(n)], 1 / (1 + np.exp(-z @ w)), atol=1e-5)


def test_constant_numeric_is_only_centred(frame):
    scaled = model.standardizer(frame).transform(frame)
    assert {r.restocking_fee_z for r in scaled.collect()} == {0.0}


def test_unseen_category_encodes_as_zeros(spark, frame, fitted):
    row = sample(1)[0]
    odd = spark.createDataFrame([(*row[:5], "never seen", None, None, *row[8:])], FRAME)
    out = fitted.transform(odd).first()
    assert out.return_reason_hot.toArray().tolist() == [0, 0, 0]
    # No channel was null in training; a null condition was.
    assert out.return_channel_hot.toArray().tolist() == [0, 0]
    assert out.condition_received_hot.toArray().tolist() == [1, 0, 0]


def test_class_weights(spark):
    labels = spark.createDataFrame([(True,), (False,), (False,), (False,), (None,)], "label boolean")
    assert [tuple(r) for r in model.class_weights(labels).collect()] == [(False, 3, 4 / 6), (True, 1, 2.0)]


def test_training_needs_labels_of_both_kinds(frame):
    with pytest.raises(RuntimeError):
        model.fit(frame.where("false"))
    with pytest.raises(ValueError, match="both"):
        model.fit(frame.where("label"))


def test_null_numeric_fails(spark, frame):
    row = sample(1)[0]
    broken = frame.unionByName(spark.createDataFrame([(*row[:4], None, *row[5:])], FRAME))
    with pytest.raises(Exception):
        model.fit(broken)


def test_save_and_load(spark, frame, fitted, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        model.load(spark, path)
    model.save(fitted, path)
    model.save(fitted, path)
    before = sorted(model.score(fitted, frame).collect())
    assert sorted(model.score(model.load(spark, path), frame).collect()) == before


def test_flag_uses_the_unrounded_score(spark):
    scores = spark.createDataFrame([(1, 0.6996), (2, 0.7), (3, 0.0625), (4, 0.9999)], "return_id long, probability double")
    out = {r.return_id: (str(r.fraud_score), r.fraud_flagged) for r in model.stored_scores(scores).collect()}
    assert out == {1: ("0.700", False), 2: ("0.700", True), 3: ("0.062", False), 4: ("1.000", True)}


def frames(seed):
    return [seed.table(n) for n in ("returns", "order_items", "orders", "customers")]


def test_feature_frames(seed):
    rows = {r.return_id: r for r in features.training_frame(*frames(seed)).collect()}
    assert {i: r.days_since_purchase for i, r in rows.items()} == {9001: 4.0, 9002: 10.0, 9003: 2.0, 9004: 1.0}
    assert {i: r.label for i, r in rows.items()} == {9001: False, 9002: False, 9003: False, 9004: True}
    assert {r.customer_lifetime_returns for r in rows.values()} == {1}
    assert features.scoring_frame(*frames(seed)).count() == 4


def test_missing_item_drops_the_row_and_missing_customer_counts_zero(seed):
    returns, items, orders, customers = frames(seed)
    out = features.training_frame(returns, items.where("order_item_id <> 5001"), orders, customers.where("customer_id <> 2"))
    assert {r.return_id: r.customer_lifetime_returns for r in out.collect()} == {9002: 0, 9003: 1, 9004: 1}


def test_lifetime_count_spans_all_returns(spark, seed):
    from pyspark.sql import functions as F

    returns, *rest = frames(seed)
    scored = returns.withColumn("customer_id", F.lit(1).cast("long")).withColumn(
        "fraud_score", F.when(F.col("return_id") > 9001, "0.5").cast("decimal(4,3)")
    )
    out = features.scoring_frame(scored, *rest).collect()
    assert [(r.return_id, r.customer_lifetime_returns) for r in out] == [(9001, 4)]


def test_vocabularies_are_bounded(spark, frame):
    prepared = model.standardizer(frame).transform(frame)
    model.check_vocabularies(prepared)
    model.check_vocabularies(prepared, most=3)
    with pytest.raises(ValueError, match=r"more than 2 categories in condition_received \(3\), return_reason \(3\)"):
        model.check_vocabularies(prepared, most=2)


def test_a_million_channels_are_refused(spark):
    """An uncleaned column must not come to the driver whole."""
    many = spark.range(1_000_000).select(
        F.concat(F.lit("c"), F.col("id")).alias("return_channel_cat"),
        *[F.lit("x").alias(f"{c}_cat") for c in features.CATEGORICAL_FEATURES if c != "return_channel"],
    )
    with pytest.raises(ValueError, match=r"return_channel \(1000000\)"):
        model.encoder_stages(many)
