"""Batch jobs. Each reads one warehouse version and writes another, or appends to a log."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from backhaul import schemas, sources
from backhaul.operators.dedupe import dedupe_returns
from backhaul.operators.upsert import FEW_ROWS, fill_scores, merge_upsert, scored_again, storable, update_scores
from backhaul.plans import features, model
from backhaul.plans.cleaning import normalize_returns
from backhaul.plans.signals import all_signals, history_bounds, signal_log
from backhaul.session import configure_tables, staged
from backhaul.sources.csv import SEQ
from backhaul.sources.warehouse import Warehouse

log = logging.getLogger(__name__)


class Load(NamedTuple):
    """Rows of a batch that were merged into a table, and rows set aside."""

    loaded: int
    rejected: int


def ranked_files(rows: DataFrame) -> DataFrame:
    """Rows as read from files, the file of their `ingest_seq` given by its rank among the names: as good
    an order, without a path in every row that is sorted. One row per file is broadcast."""
    order = rows.schema[SEQ].dataType
    if not isinstance(order, StructType) or "file" not in order.fieldNames():
        return rows
    names = rows.select(F.col(f"{SEQ}.file").alias("_file")).distinct()
    ranks = names.withColumn("_rank_of_file", F.row_number().over(Window.orderBy("_file")))
    rest = [F.col(f"{SEQ}.{c}").alias(c) for c in order.fieldNames() if c != "file"]
    placed = rows.join(F.broadcast(ranks), F.col(f"{SEQ}.file").eqNullSafe(F.col("_file")))
    return placed.withColumn(SEQ, F.struct(F.col("_rank_of_file").alias("file"), *rest)).select(*rows.columns)


def upsert(
    old: Warehouse,
    new: Warehouse,
    name: str,
    batch: DataFrame,
    loaded_at: datetime | None = None,
    latest: Callable[[DataFrame], DataFrame] | None = None,
) -> Load:
    """Merge a batch into a table of `old`, write the result to `new`.

    The batch is staged first, so its files are parsed once and its row order is settled; staging
    goes when the table is written. Rows that lack a required value are written to `rejects` below the
    new version, as they came, and take no further part, so they cannot displace good rows. `latest`
    reduces the others to one row per key.
    """
    table = schemas.TABLES.get(name)
    if table is None or not table.updated:
        raise ValueError(f"No upsert rule for table '{name}'")
    # Counted after staging: a session that has observed a write cannot fit models any more (4.1.2:
    # its observations cannot be sent to tasks).
    with staged(batch, f"{name}-batch") as rows:
        good = storable(rows, table)
        loaded, rejected = rows.agg(F.count_if(good), F.count_if(~good)).first()
        if rejected:
            new.write_rejects(name, rows.where(~good))
        fit = ranked_files(rows.where(good))
        rows_of_key = latest(fit) if latest else fit
        merged = merge_upsert(
            old.table(name), rows_of_key, table, SEQ, loaded_at, unique=latest is not None, few=loaded <= FEW_ROWS
        )
        new.write(name, merged)
    log.info("%s: %d rows of the batch merged, %d set aside", name, loaded, rejected)
    return Load(loaded, rejected)


def run_etl(
    raw_dir: str, old: Warehouse, new: Warehouse, loaded_at: datetime | None = None
) -> dict[str, Load]:
    """Load the five raw files into a new warehouse version; rows merged and set aside per table.

    Dimensions go first. A failed run leaves `old` as it was. Loading resets `fraud_flagged`
    from the file and keeps `fraud_score`, so a flag set by scoring lasts until the next load
    of that return.
    """
    spark, raw = configure_tables(old.spark), raw_dir.rstrip("/")
    batches = {
        "customers": sources.read_customers(spark, f"{raw}/customers.csv"),
        "products": sources.read_products(spark, f"{raw}/products.csv"),
        "orders": sources.read_orders(spark, f"{raw}/orders.csv"),
        "order_items": sources.read_order_items(spark, f"{raw}/order_items.csv"),
        "returns": normalize_returns(sources.read_returns(spark, f"{raw}/returns.csv")),
    }
    latest = {"returns": dedupe_returns}
    return {
        name: upsert(old, new, name, batch, loaded_at, latest.get(name)) for name, batch in batches.items()
    }


def compute_signals(store: Warehouse, created_at: datetime, since: datetime | None = None) -> bool:
    """Run every rule over the warehouse's returns and append the signals to its log.

    With `since`, only returns loaded from then on are examined, against what their trailing counts
    can see of the history: what an hourly run needs. `created_at` names the run: one that is in the log
    already is not logged again, so a job may be repeated. Returns whether it was logged.
    """
    configure_tables(store.spark)
    if store.has_signals_of(created_at):
        return False
    returns = store.table("returns")
    fresh, history = returns, None
    if since is not None:
        fresh = store.between("returns", "created_at", since)
        bounds = history_bounds(fresh)
        history = store.between("returns", "return_date", *bounds) if bounds else returns.limit(0)
    signals = all_signals(fresh, store.table("order_items"), store.table("orders"), history=history)
    store.append_signals(signal_log(signals, created_at))
    return True


def _feature_tables(store: Warehouse) -> list[DataFrame]:
    return [store.table(name) for name in ("returns", "order_items", "orders", "customers")]


def train(store: Warehouse, model_path: str) -> str:
    """Fit the fraud model on all labelled returns and save it."""
    configure_tables(store.spark)
    fitted = model.fit_stored(features.training_frame(*_feature_tables(store)))
    model.save(fitted, model_path)
    return model_path


def score_returns(old: Warehouse, new: Warehouse, model_path: str) -> int:
    """Score unscored returns and write the returns table to a new version; rows scored.

    Writes nothing if there is nothing to score.
    """
    fitted = model.load(configure_tables(old.spark), model_path)
    probabilities = model.score(fitted, features.scoring_frame(*_feature_tables(old)))
    with staged(model.stored_scores(probabilities), "scores") as scores:
        scored = scores.count()
        if scored:
            returns = old.table("returns")
            # A key that repeats may have rows with and without a score; all take the new one.
            put = update_scores if scored_again(returns, scores) else fill_scores
            new.write("returns", put(returns, scores))
    log.info("New scores for %d returns", scored)
    return scored
