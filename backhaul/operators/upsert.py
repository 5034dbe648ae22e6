"""Keyed writes expressed as joins: each returns the new version of the target."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.schemas import NOW, Table
from backhaul.sources.csv import SEQ


#: Batches up to this many rows are broadcast; a row has a few hundred bytes at most.
FEW_ROWS = 100_000


def load_time(loaded_at: datetime | None) -> Column:
    if loaded_at is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(loaded_at.isoformat()).cast("timestamp_ntz")


def conform(batch: DataFrame, table: Table, seq: str = SEQ, loaded_at: datetime | None = None) -> DataFrame:
    """The batch with exactly the table's columns and types, plus `seq` if it has one.

    Omitted columns take their default; a value that does not fit its type becomes null.
    Nulls given by the batch stay null. Omitting a required column without default fails.
    """
    missing = [c for c in table.required if c not in batch.columns and c not in table.defaults]
    if missing:
        raise ValueError(f"Batch for {table.name} lacks columns: {missing}")
    cells = []
    for f in table.schema.fields:
        if f.name in batch.columns:
            value = F.col(f.name).try_cast(f.dataType)
        elif table.defaults.get(f.name) is NOW:
            value = load_time(loaded_at)
        else:
            value = F.lit(table.defaults.get(f.name)).cast(f.dataType)
        cells.append(value.alias(f.name))
    if seq in batch.columns:
        cells.append(F.col(seq))
    return batch.select(*cells)


def storable(batch: DataFrame, table: Table) -> Column:
    """Whether a row of the batch can be stored: the required columns it supplies hold a value that
    fits their type. Never null."""
    given = [c for c in table.required if c in batch.columns]
    fits = [F.col(c).try_cast(table.schema[c].dataType).isNotNull() for c in given]
    return reduce(lambda a, b: a & b, fits, F.lit(True))


def is_few(batch: DataFrame) -> bool:
    """Whether a batch has so few rows that it can go to where the target is."""
    return batch.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def merge_upsert(
    target: DataFrame,
    batch: DataFrame,
    table: Table,
    seq: str = SEQ,
    loaded_at: datetime | None = None,
    unique: bool = False,
    few: bool = False,
) -> DataFrame:
    """Insert new keys and update the `updated` columns of known ones, in order of `seq`.

    When a key repeats in the batch, updated columns take its last row and insert-only columns
    its first. Both are folded per key before the shuffle, and both join sides are unique per
    key, so repeated keys do not skew the join. Columns no batch supplies keep the target's
    value, or get their default on new rows. `unique`: no key repeats in the batch, so nothing is
    folded.

    Target and batch meet in a full outer join, which shuffles both. With `few`, for a batch of at
    most `FEW_ROWS` rows, the target stays where it is: its rows take their new values from the
    batch, broadcast; its key column, read once more, tells which keys of the batch it lacks, and
    those rows are added. The result is the same.
    """
    given = [c for c in table.columns if c in (table.key, *table.updated, *table.inserted)]
    rows = conform(batch.select(*[c for c in given if c in batch.columns], seq), table, seq, loaded_at)
    fixed = [c for c in table.columns if c != table.key and c not in table.updated]
    folds = [F.max_by(F.struct(*table.updated), seq).alias("_last")]
    if fixed:
        folds.append(F.min_by(F.struct(*fixed), seq).alias("_first"))
    if unique:
        ends = [F.struct(*table.updated).alias("_last"), *([F.struct(*fixed).alias("_first")] if fixed else [])]
        new = rows.select(table.key, *ends).withColumn("_given", F.lit(True))
    else:
        new = rows.groupBy(table.key).agg(*folds).withColumn("_given", F.lit(True))
    old = target.select(*table.columns).withColumn("_known", F.lit(True))
    cells = {table.key: F.col(table.key)}
    for c in table.updated:
        cells[c] = F.when(F.col("_given"), F.col(f"_last.{c}")).otherwise(F.col(c))
    for c in fixed:
        cells[c] = F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_first.{c}"))
    row = [cells[c].alias(c) for c in table.columns]
    if not few:
        return old.join(new, table.key, "full_outer").select(*row)
    new = F.broadcast(new)
    known = F.broadcast(target.select(table.key).join(new.select(table.key), table.key, "left_semi").distinct())
    added = new.join(known, table.key, "left_anti")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields if f.name != table.key]
    inserted = added.select("*", *blank).select(*row)
    return old.join(new, table.key, "left").select(*row).unionByName(inserted)


def insert_if_absent(
    target: DataFrame,
    batch: DataFrame,
    table: Table,
    seq: str = SEQ,
    loaded_at: datetime | None = None,
) -> DataFrame:
    """Add the first batch row of every key the target lacks; known keys stay as they are."""
    rows = conform(batch, table, seq, loaded_at)
    first = (
        rows.groupBy(table.key)
        .agg(F.min_by(F.struct(*table.columns), seq).alias("_first"))
        .join(target.select(table.key), table.key, "left_anti")
        .select("_first.*")
    )
    return target.select(*table.columns).unionByName(first)


def update_scores(returns: DataFrame, scores: DataFrame) -> DataFrame:
    """Set `fraud_score` and `fraud_flagged` of the scored returns; the rest stay as they are."""
    new = scores.select(
        "return_id",
        F.col("fraud_score").alias("_score"),
        F.col("fraud_flagged").alias("_flagged"),
        F.lit(True).alias("_scored"),
    )
    return (
        returns.join(new, "return_id", "left")
        .withColumns(
            {
                "fraud_score": F.when(F.col("_scored"), F.col("_score")).otherwise(F.col("fraud_score")),
                "fraud_flagged": F.when(F.col("_scored"), F.col("_flagged")).otherwise(F.col("fraud_flagged")),
            }
        )
        .select(*returns.columns)
    )


def scored_again(returns: DataFrame, scores: DataFrame) -> bool:
    """Whether new scores meet a return that has one already. Looks at ids only."""
    ids = returns.where(F.col("fraud_score").isNotNull()).select("return_id")
    return not ids.join(scores.select("return_id"), "return_id", "left_semi").isEmpty()


def fill_scores(returns: DataFrame, scores: DataFrame) -> DataFrame:
    """`update_scores` for scores that meet no return that has one already (see `scored_again`): only
    returns without a score are shuffled to meet them."""
    missing = F.col("fraud_score").isNull()
    return returns.where(~missing).unionByName(update_scores(returns.where(missing), scores))
