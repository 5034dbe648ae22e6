"""Table definitions: columns, keys, defaults, value domains and upsert rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

BIGINT = LongType()
INT = IntegerType()
TEXT = StringType()
BOOLEAN = BooleanType()
TIMESTAMP = TimestampNTZType()
TOTAL = DecimalType(12, 2)
MONEY = DecimalType(10, 2)
SCORE = DecimalType(4, 3)


def required(name: str, kind: DataType) -> StructField:
    return StructField(name, kind, nullable=False)


def optional(name: str, kind: DataType) -> StructField:
    return StructField(name, kind)


@dataclass(frozen=True)
class Table:
    name: str
    schema: StructType
    key: str
    # Columns a batch supplies: overwritten on conflict, or only set when the key is new.
    updated: tuple[str, ...] = ()
    inserted: tuple[str, ...] = ()
    # Values for columns a batch leaves out. NOW stands for the load time.
    defaults: dict[str, object] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    references: dict[str, str] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


NOW = object()

# Enum domains.
SEGMENTS = ("new", "casual", "loyal", "vip")
CATEGORIES = ("apparel", "electronics", "home", "beauty")
ORDER_CHANNELS = ("web", "mobile", "bopis", "store")
RETURN_REASONS = (
    "defective",
    "wrong_size",
    "not_as_described",
    "changed_mind",
    "late_delivery",
    "duplicate",
    "other",
)
RETURN_CHANNELS = ("mail", "in_store", "pickup")
CONDITIONS = ("new_unopened", "opened_unused", "used", "damaged", "missing_parts")
DISPOSITIONS = ("restock", "refurbish", "liquidate", "donate", "destroy")
SIGNAL_TYPES = (
    "serial_returner",
    "wardrobing",
    "bopis_not_returned",
    "time_anomaly",
    "value_mismatch",
    "condition_mismatch",
)
SEVERITIES = ("low", "medium", "high")

# Columns, types, nullability, defaults and references of the six tables.
CUSTOMERS = Table(
    name="customers",
    schema=StructType(
        [
            required("customer_id", BIGINT),
            optional("email", TEXT),
            required("segment", TEXT),
            required("created_at", TIMESTAMP),
            optional("lifetime_value", TOTAL),
            optional("risk_score", SCORE),
        ]
    ),
    key="customer_id",
    updated=("email", "segment", "lifetime_value", "risk_score"),
    inserted=("created_at",),
    defaults={"lifetime_value": 0},
    domains={"segment": SEGMENTS},
)

PRODUCTS = Table(
    name="products",
    schema=StructType(
        [
            required("product_id", BIGINT),
            required("sku", TEXT),
            required("category", TEXT),
            optional("subcategory", TEXT),
            required("unit_price", MONEY),
            optional("return_window_days", INT),
        ]
    ),
    key="product_id",
    updated=("sku", "category", "subcategory", "unit_price", "return_window_days"),
    defaults={"return_window_days": 30},
    unique=("sku",),
    domains={"category": CATEGORIES},
)

ORDERS = Table(
    name="orders",
    schema=StructType(
        [
            required("order_id", BIGINT),
            required("customer_id", BIGINT),
            required("order_date", TIMESTAMP),
            required("channel", TEXT),
            required("total_amount", TOTAL),
            optional("shipping_postal_code", TEXT),
        ]
    ),
    key="order_id",
    updated=("customer_id", "order_date", "channel", "total_amount", "shipping_postal_code"),
    references={"customer_id": "customers"},
    domains={"channel": ORDER_CHANNELS},
)

ORDER_ITEMS = Table(
    name="order_items",
    schema=StructType(
        [
            required("order_item_id", BIGINT),
            required("order_id", BIGINT),
            required("product_id", BIGINT),
            required("quantity", INT),
            required("unit_price", MONEY),
            optional("discount_amount", MONEY),
        ]
    ),
    key="order_item_id",
    updated=("order_id", "product_id", "quantity", "unit_price", "discount_amount"),
    defaults={"discount_amount": 0},
    references={"order_id": "orders", "product_id": "products"},
)

RETURNS = Table(
    name="returns",
    schema=StructType(
        [
            required("return_id", BIGINT),
            required("order_item_id", BIGINT),
            required("customer_id", BIGINT),
            required("return_date", TIMESTAMP),
            required("return_reason", TEXT),
            required("return_channel", TEXT),
            optional("condition_received", TEXT),
            optional("disposition", TEXT),
            required("refund_amount", MONEY),
            optional("restocking_fee", MONEY),
            optional("processing_cost", MONEY),
            optional("recovered_value", MONEY),
            optional("cycle_time_hours", INT),
            optional("fraud_flagged", BOOLEAN),
            optional("fraud_score", SCORE),
            required("created_at", TIMESTAMP),
        ]
    ),
    key="return_id",
    updated=(
        "condition_received",
        "disposition",
        "refund_amount",
        "processing_cost",
        "recovered_value",
        "cycle_time_hours",
        "fraud_flagged",
    ),
    inserted=(
        "order_item_id",
        "customer_id",
        "return_date",
        "return_reason",
        "return_channel",
        "restocking_fee",
    ),
    defaults={
        "restocking_fee": 0,
        "processing_cost": 0,
        "recovered_value": 0,
        "fraud_flagged": False,
        "created_at": NOW,
    },
    references={"order_item_id": "order_items", "customer_id": "customers"},
    domains={
        "return_reason": RETURN_REASONS,
        "return_channel": RETURN_CHANNELS,
        "condition_received": CONDITIONS,
        "disposition": DISPOSITIONS,
    },
)

FRAUD_SIGNALS = Table(
    name="fraud_signals",
    schema=StructType(
        [
            required("signal_id", BIGINT),
            required("return_id", BIGINT),
            required("signal_type", TEXT),
            required("severity", TEXT),
            required("score", SCORE),
            optional("evidence", TEXT),
            optional("model_version", TEXT),
            required("created_at", TIMESTAMP),
        ]
    ),
    key="signal_id",
    defaults={"created_at": NOW},
    references={"return_id": "returns"},
    domains={"signal_type": SIGNAL_TYPES, "severity": SEVERITIES},
)

TABLES = {t.name: t for t in (CUSTOMERS, PRODUCTS, ORDERS, ORDER_ITEMS, RETURNS, FRAUD_SIGNALS)}

# Columns a returns file must have.
REQUIRED_RETURN_COLUMNS = (
    "return_id",
    "order_item_id",
    "customer_id",
    "return_date",
    "return_reason",
    "return_channel",
    "condition_received",
    "refund_amount",
)
