"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType

from backhaul import functions, jobs, schemas, sources
from backhaul.adapter import LOADED_AT, SampleWarehouse, open_tables
from backhaul.operators import dedupe, quality, rules, upsert
from backhaul.operators.position import with_position
from backhaul.operators.trailing import with_trailing_count
from backhaul.plans import cleaning, features, model, reports, signals, views
from backhaul.session import scratch_path, written
from backhaul.sources.csv import ADDED, MALFORMED, SEQ
from backhaul.sources.warehouse import Warehouse, write_csv

AS_OF = datetime(2001, 7, 15)

Build = Callable[[SampleWarehouse], DataFrame]
QUERIES: dict[str, Build] = {}


def query(build: Build) -> Build:
    QUERIES[build.__name__] = build
    return build


def comparable(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Engine-neutral types: decimals as doubles, integers as bigints, given ratios rounded."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in (digits or {}):
            c = F.round(c.cast("double"), digits[f.name])
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, IntegerType):
            c = c.cast("bigint")
        cells.append(c.alias(f.name))
    return df.select(*cells)


def facts(w: SampleWarehouse, *names: str) -> list[DataFrame]:
    return [w.table(n) for n in names]


# --- CSV sources and sinks -------------------------------------------------------------------


def _scan(w: SampleWarehouse, name: str, reader) -> DataFrame:
    """A table exported as CSV and read back, without the lines that cannot be."""
    rows = reader(w.spark, w.csv(name))
    return comparable(rows.where(F.col(MALFORMED).isNull()).drop(*ADDED))


@query
def scan_returns(w):
    return _scan(w, "returns", sources.read_returns)


@query
def scan_customers(w):
    return _scan(w, "customers", sources.read_customers)


@query
def scan_orders(w):
    return _scan(w, "orders", sources.read_orders)


@query
def scan_order_items(w):
    return _scan(w, "order_items", sources.read_order_items)


@query
def scan_products(w):
    return _scan(w, "products", sources.read_products)


@query
def scan_malformed(w):
    """The lines of the returns file with too many or too few fields, and how many cells they fill."""
    rows = sources.read_returns(w.spark, w.csv("returns")).where(F.col(MALFORMED).isNotNull())
    cells = [F.col(c).isNotNull().cast("bigint") for c in rows.columns if c not in ADDED]
    return rows.select(MALFORMED, reduce(lambda a, b: a + b, cells).alias("n_cells"))


# --- keyed writes ----------------------------------------------------------------------------


def _upsert(w: SampleWarehouse, name: str) -> DataFrame:
    batch = w.table(f"{name}_batch")
    few = upsert.is_few(batch)
    return comparable(upsert.merge_upsert(w.history(name), batch, schemas.TABLES[name], "seq", few=few))


@query
def upsert_customers(w):
    return _upsert(w, "customers")


@query
def upsert_products(w):
    return _upsert(w, "products")


@query
def upsert_orders(w):
    return _upsert(w, "orders")


@query
def upsert_order_items(w):
    return _upsert(w, "order_items")


@query
def upsert_returns(w):
    """The rows of the batch that can be stored, merged; see `run_etl_rejects` for the others."""
    batch = cleaning.normalize_returns(w.table("returns_raw"))
    good = batch.where(upsert.storable(batch, schemas.RETURNS))
    merged = upsert.merge_upsert(
        w.history("returns"), good, schemas.RETURNS, "seq", LOADED_AT, few=upsert.is_few(good)
    )
    return comparable(merged)


@query
def insert_if_absent(w):
    batch = w.table("customers_batch")
    return comparable(upsert.insert_if_absent(w.history("customers"), batch, schemas.CUSTOMERS, "seq"))


@query
def score_writeback(w):
    """Unscored returns take their strongest signal as score."""
    scores = (
        signals.all_signals(*facts(w, "returns", "order_items", "orders"))
        .groupBy("return_id")
        .agg(F.max("score").alias("probability"))
        .join(w.table("returns").where("fraud_score is null").select("return_id"), "return_id")
    )
    updated = upsert.update_scores(w.table("returns"), model.stored_scores(scores))
    return comparable(updated.select("return_id", "fraud_score", "fraud_flagged"))


def _loaded_files(w: SampleWarehouse, again: bool = False) -> Warehouse:
    """Raw files loaded over a warehouse that holds older returns; loaded once, or `again`."""
    if "etl" in w.exported and not again:
        return Warehouse(w.spark, w.exported["etl"])
    for name in ("customers", "products", "orders", "order_items", "returns"):
        w.csv(name)
    old = Warehouse(w.spark, scratch_path(w.spark, "old"))
    old.write("returns", w.history("returns"))
    new = old.next(scratch_path(w.spark, "new"))
    jobs.run_etl(w.location("csv"), old, new, LOADED_AT)
    w.exported["etl"] = new.paths[0]
    return new


@query
def run_etl(w):
    """The returns table after a load."""
    return comparable(_loaded_files(w, again=True).table("returns"))


@query
def run_etl_rejects(w):
    """The rows of the returns file that a load sets aside."""
    new = _loaded_files(w)
    rows = w.spark.read.parquet(f"{new.location('rejects')}/returns")
    return comparable(rows.select("return_id", "customer_id", "return_date", "return_reason", "refund_amount", MALFORMED))


@query
def run_etl_dimensions(w):
    """Rows, keys and amounts of the other tables after a load."""
    new = _loaded_files(w)
    parts = []
    for name, amount in (("customers", "lifetime_value"), ("products", "unit_price"), ("orders", "total_amount"), ("order_items", "unit_price")):
        df = new.table(name)
        parts.append(
            df.agg(
                F.count("*").alias("n_rows"),
                F.sum(schemas.TABLES[name].key).alias("keys"),
                F.sum(amount).cast("double").alias("amount"),
            ).select(F.lit(name).alias("table_name"), "n_rows", "keys", "amount")
        )
    return reduce(DataFrame.unionByName, parts)


@query
def scan_mixed_dates(w):
    """Orders whose dates are written in several ways, some unreadable, read from CSV."""
    at = F.col("order_date")
    text = (
        F.when(F.col("order_id") % 5 == 0, F.date_format(at, "M/d/yyyy"))
        .when(F.col("order_id") % 5 == 1, F.date_format(at, "MMM d, yyyy"))
        .when(F.col("order_id") % 5 == 2, F.lit("soon"))
        .when(F.col("order_id") % 5 == 3, F.date_format(at, "yyyyMMdd"))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )
    path = scratch_path(w.spark, "mixed-dates")
    write_csv(w.table("orders").withColumn("order_date", text), path)
    return sources.read_orders(w.spark, path).select("order_id", "order_date")


def _slashed_dates(w: SampleWarehouse, mixed: bool) -> str:
    """Orders with slashed dates as CSV, spread over its files; every third row month first if mixed."""
    at = F.col("order_date")
    text = F.date_format(at, "d/M/yyyy H:mm")
    if mixed:
        text = F.when(F.col("order_id") % 3 == 0, F.date_format(at, "M/d/yyyy H:mm")).otherwise(text)
    path = scratch_path(w.spark, "slashed-dates")
    write_csv(w.table("orders").withColumn("order_date", text).repartition("order_id"), path)
    return path


@query
def scan_day_first_dates(w):
    """Orders from files that write the day before the month, which only some of the dates show."""
    return sources.read_orders(w.spark, _slashed_dates(w, mixed=False)).select("order_id", "order_date")


@query
def scan_date_orders(w):
    """Dates of files that mix both orders: how many read one way only, how many either way."""
    found = sources.date_orders(w.spark, _slashed_dates(w, mixed=True), schemas.ORDERS)
    sums = [F.sum(c).alias(c) for c in ("n_month_first", "n_day_first", "n_either")]
    return found.groupBy("column_name").agg(*sums)


@query
def fraud_signal_log(w):
    return comparable(w.table("fraud_signals").drop("signal_id", "created_at"))


# --- integrity -------------------------------------------------------------------------------


def _loaded(w: SampleWarehouse, *names: str) -> dict[str, DataFrame]:
    return {n: w.table(n) for n in names}


@query
def dq_pk(w):
    frames = _loaded(w, "customers", "products", "orders", "order_items", "fraud_signals")
    return quality.primary_key_violations({**frames, "returns": w.table("returns_raw")})


@query
def dq_unique_sku(w):
    frames = {"products": w.history("products").unionByName(w.table("products"))}
    return quality.unique_violations(frames)


def _some_astray(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The frames with some references that point nowhere."""
    wrong = {"orders": {"customer_id": 97}, "order_items": {"order_id": 89, "product_id": 83}, "returns": {"order_item_id": 79, "customer_id": 73}}
    out = dict(frames)
    for name, columns in wrong.items():
        key = F.col(schemas.TABLES[name].key)
        out[name] = out[name].withColumns(
            {c: F.when(key % every == 0, -F.col(c)).otherwise(F.col(c)) for c, every in columns.items()}
        )
    return out


@query
def dq_fk(w):
    """All six references over whole tables, some of whose rows point nowhere."""
    frames = _loaded(w, "customers", "products", "orders", "order_items", "returns", "fraud_signals")
    return quality.foreign_key_violations(_some_astray(frames))


@query
def dq_all(w):
    """Every rule over every table, each table read once: raw returns, some references astray."""
    frames = _loaded(w, "customers", "products", "orders", "order_items", "fraud_signals")
    return quality.integrity_report(_some_astray({**frames, "returns": w.table("returns_raw")}))


@query
def dq_not_null(w):
    frames = _loaded(w, "customers", "products", "orders", "order_items", "fraud_signals")
    return quality.not_null_violations({**frames, "returns": w.table("returns_raw")})


@query
def dq_domain(w):
    frames = _loaded(w, "customers", "products", "orders", "order_items", "fraud_signals")
    return quality.domain_violations({**frames, "returns": w.table("returns_raw")})


# --- cleaning --------------------------------------------------------------------------------


@query
def normalize_reason(w):
    raw = w.table("returns_raw")
    return raw.select(
        "return_id", F.col("seq").cast("bigint").alias("seq"),
        functions.normalize_reason(F.col("return_reason")).alias("return_reason"),
    )


@query
def normalize_condition(w):
    raw = w.table("returns_raw")
    return raw.select(
        "return_id", F.col("seq").cast("bigint").alias("seq"),
        functions.normalize_condition(F.col("condition_received")).alias("condition_received"),
    )


@query
def coerce_money(w):
    raw = w.table("returns_raw")
    return raw.select(
        "return_id", F.col("seq").cast("bigint").alias("seq"),
        functions.coerce_money(F.col("refund_amount")).alias("refund_amount"),
    )


@query
def dedupe_returns(w):
    kept = dedupe.dedupe_returns(w.table("returns_raw"), "seq")
    return comparable(kept.select("return_id", "return_date", "return_reason", "refund_amount", "seq"))


@query
def transform_returns(w):
    return comparable(cleaning.transform_returns(w.table("returns_raw"), "seq"))


# --- views, KPIs, reports --------------------------------------------------------------------

SIX = 6


@query
def v_monthly_return_metrics(w):
    digits = {"avg_cycle_hours": SIX, "fraud_rate": SIX}
    return comparable(views.VIEWS["v_monthly_return_metrics"](w), digits)


@query
def v_return_reasons_by_category(w):
    return comparable(views.VIEWS["v_return_reasons_by_category"](w))


@query
def v_disposition_outcomes(w):
    return comparable(views.VIEWS["v_disposition_outcomes"](w))


@query
def v_customer_return_summary(w):
    return comparable(views.VIEWS["v_customer_return_summary"](w))


@query
def v_high_risk_returns(w):
    return comparable(views.VIEWS["v_high_risk_returns"](w))


@query
def order_totals(w):
    return comparable(views.order_totals(w.table("order_items")))


@query
def kpi_return_rate(w):
    rates = views.kpi_return_rate(*facts(w, "returns", "order_items", "orders"))
    return comparable(rates, {"return_rate": SIX})


@query
def kpi_return_rate_rolling(w):
    """Trailing 30 and 90 days, for every day of the calendar between the first event and the last."""
    rates = views.kpi_return_rate_rolling(*facts(w, "returns", "order_items", "orders"))
    return comparable(rates, {"return_rate": SIX})


@query
def kpi_return_rate_between(w):
    """One quarter and one window in which nothing happened."""
    tables = facts(w, "returns", "order_items", "orders")
    windows = [(date(1996, 4, 1), date(1996, 7, 1)), (date(2030, 1, 1), date(2030, 2, 1))]
    parts = [
        views.kpi_return_rate_between(*tables, *ends).withColumn("first_day", F.lit(str(ends[0]))) for ends in windows
    ]
    return comparable(reduce(DataFrame.unionByName, parts), {"return_rate": SIX})


@query
def kpi_headline(w):
    digits = {"fraud_rate": SIX, "recovery_rate": SIX, "cycle_time_hours": SIX}
    return comparable(views.kpi_headline(w.table("returns")), digits)


@query
def q_disposition_optimization(w):
    report = reports.disposition_optimization(*facts(w, "returns", "order_items", "products"), AS_OF)
    return comparable(report, {"avg_cycle_hours": SIX})


@query
def q_return_reasons_breakdown(w):
    report = reports.return_reasons_breakdown(*facts(w, "returns", "order_items", "products"), AS_OF)
    return comparable(report, {"avg_cycle_hours": SIX})


@query
def q_fraud_investigation(w):
    """The return with the highest id that raised the most signals."""
    log = w.table("fraud_signals")
    counts = log.groupBy("return_id").agg(F.count("*").alias("n"))
    worst = counts.agg(F.max(F.struct("n", "return_id")).alias("worst")).first()["worst"]["return_id"]
    return comparable(reports.fraud_investigation(w.table("returns"), log, worst))


@query
def q_disposition_optimization_order(w):
    """The rows of the report with their place in it; dispositions break ties."""
    report = reports.disposition_optimization(*facts(w, "returns", "order_items", "products"), AS_OF)
    keys = (F.col("category").asc_nulls_last(), F.col("net_value").desc_nulls_first(), "disposition")
    return comparable(with_position(report, *keys).select("category", "disposition", "net_value", "position"))


@query
def q_return_reasons_order(w):
    """The same; categories and reasons break ties."""
    report = reports.return_reasons_breakdown(*facts(w, "returns", "order_items", "products"), AS_OF)
    keys = (F.col("month").desc_nulls_first(), F.col("return_count").desc_nulls_first(), "category", "return_reason")
    return with_position(report, *keys).select("month", "category", "return_reason", "return_count", "position")


@query
def q_fraud_investigation_order(w):
    """Signals of all returns of the highest id's customer, as the investigation report orders them."""
    returns, log = w.table("returns"), w.table("fraud_signals")
    last = returns.agg(F.max(F.struct("return_id", "customer_id")).alias("last")).select("last.customer_id")
    signals_of = returns.join(last, "customer_id", "left_semi").join(log, "return_id", "left").select("return_id", "signal_type")
    return with_position(signals_of, "return_id", F.col("signal_type").asc_nulls_last())


@query
def returns_by_refund(w):
    """Every return with its place by refund, the highest first."""
    refunds = w.table("returns").select("return_id", "refund_amount")
    return comparable(with_position(refunds, F.col("refund_amount").desc_nulls_last(), "return_id"))


@query
def sql_by_name(w):
    """SQL text over the registered table and view names, with a bound parameter."""
    return comparable(
        w.sql(
            """select s.segment, count(*) as n_returns, sum(s.lifetime_refunds) as refunds
               from v_customer_return_summary s join v_high_risk_returns h on h.customer_id = s.customer_id
               where h.refund_amount >= :floor group by s.segment""",
            floor=100,
        )
    )


# --- signals ---------------------------------------------------------------------------------


def _signal_input(w: SampleWarehouse) -> DataFrame:
    return signals.signal_input(*facts(w, "returns", "order_items", "orders"))


@query
def trailing_return_count(w):
    return with_trailing_count(w.table("returns")).select("return_id", "trailing_returns")


@query
def signal_input(w):
    enriched = _signal_input(w).select("return_id", "unit_price", "days_since_purchase")
    return comparable(enriched, {"days_since_purchase": SIX})


@query
def signal_serial_returner(w):
    return comparable(rules.detect_serial_returners(w.table("returns")), {"score": SIX})


@query
def signal_wardrobing(w):
    return rules.detect_wardrobing(_signal_input(w))


@query
def signal_time_anomaly(w):
    return rules.detect_late_night_returns(w.table("returns"))


@query
def signal_value_mismatch(w):
    return rules.detect_value_mismatch(_signal_input(w))


@query
def all_signals(w):
    found = signals.all_signals(*facts(w, "returns", "order_items", "orders"))
    return comparable(found, {"score": SIX})


def _events(w: SampleWarehouse) -> DataFrame:
    """A second, denser set of returns: all events, with their user as customer."""
    return w.raw("events").select(
        F.col("event_id").alias("return_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("return_date"),
    )


@query
def trailing_return_count_events(w):
    return with_trailing_count(_events(w)).select("return_id", "trailing_returns")


@query
def all_signals_events(w):
    """Rules that need prices or purchase dates find no such columns and stay silent."""
    return comparable(rules.compute_all_signals(_events(w)), {"score": SIX})


@query
def all_signals_since(w):
    """What an hourly job logs: signals of returns loaded lately, against the whole history. Here
    returns count as loaded on their date."""
    new = w.next(scratch_path(w.spark, "since"))
    new.write("returns", w.table("returns").withColumn("created_at", F.col("return_date")))
    for name in ("order_items", "orders"):
        w.table(name)
    jobs.compute_signals(new, LOADED_AT + timedelta(days=1), since=datetime(1998, 2, 1))
    return comparable(new.table("fraud_signals").drop("signal_id", "created_at"))


# --- model -----------------------------------------------------------------------------------


def _feature_tables(w: SampleWarehouse) -> list[DataFrame]:
    return facts(w, "returns", "order_items", "orders", "customers")


def _training_frame(w: SampleWarehouse) -> DataFrame:
    """Stored once per session: several queries fit on it."""
    if "training_frame" not in w.ready:
        frame = features.training_frame(*_feature_tables(w))
        w.ready["training_frame"] = written(frame, "training-frame")
    return w.ready["training_frame"]


@query
def training_frame(w):
    frame = features.training_frame(*_feature_tables(w))
    return comparable(frame, {"days_since_purchase": SIX})


@query
def scoring_frame(w):
    frame = features.scoring_frame(*_feature_tables(w))
    return comparable(frame, {"days_since_purchase": SIX})


@query
def standardize_numeric(w):
    frame = _training_frame(w)
    scaled = [f"{c}_z" for c in features.NUMERIC_FEATURES]
    out = model.standardizer(frame).transform(frame).select("return_id", *scaled)
    return comparable(out, dict.fromkeys(scaled, SIX))


@query
def one_hot_categories(w):
    """Hot slots of each category column as a string of zeros and one."""
    frame = _training_frame(w)
    frame = model.standardizer(frame).transform(frame)
    for stage in model.encoder_stages(frame):
        frame = stage.transform(frame)
    bits = [
        F.array_join(vector_to_array(f"{c}_hot").cast("array<int>"), "").alias(f"{c}_hot")
        for c in features.CATEGORICAL_FEATURES
    ]
    return frame.select("return_id", *bits)


@query
def class_weights(w):
    return comparable(model.class_weights(_training_frame(w)), {"weight": SIX})


@query
def logistic_regression(w):
    """Per coefficient of the fitted model the slope of the penalised loss there, per row: zero."""
    frame = _training_frame(w)
    return model.slopes(model.fit(frame), frame)


@query
def score_returns(w):
    """Score what is unscored with a saved model and write back: scores that were there already, and
    whether the new ones are there, in range and in line with their flags."""
    path = w.location("model")
    if "model" not in w.exported:
        model.save(model.fit(_training_frame(w)), path)
        w.exported["model"] = path
    new = w.next(scratch_path(w.spark, "scored"))
    jobs.score_returns(w, new, path)
    before = w.table("returns").select("return_id", F.col("fraud_score").isNull().alias("unscored"))
    score, flag = F.col("fraud_score").cast("double"), F.col("fraud_flagged")
    # A stored 0.700 may be a rounded 0.6996, which raises no flag.
    fits = score.between(0, 1) & ((flag == (score >= 0.7)) | (score == 0.7))
    return new.table("returns").join(before, "return_id").select(
        "return_id",
        F.when(~F.col("unscored"), score).alias("fraud_score"),
        F.when(~F.col("unscored"), flag).alias("fraud_flagged"),
        (F.col("unscored") & F.coalesce(fits, F.lit(False))).alias("newly_scored"),
    )


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Build):
        return lambda spark, sf_dir: build(open_tables(spark, sf_dir))

    return {name: bound(build) for name, build in QUERIES.items()}
