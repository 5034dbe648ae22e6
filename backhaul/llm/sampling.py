"""Bounded samples of rows. A row is known by a hash of its id and text, so that an id that many rows
share does not bring them all; rows that repeat id and text count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_sampled_row"


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def distinct_rows(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, row hash and other columns of all rows, each row once."""
    return docs.select(F.col("doc_id").cast("long"), row_key().alias(ROW), *others).distinct()


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """At most `n` of the distinct rows, those with the lowest hash."""
    return rows.orderBy(F.xxhash64(ROW), "doc_id", ROW).limit(n)


def rows_of(docs: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """The chosen rows, once each: the columns given, of the documents or of the choice."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias(ROW))
    picked = chosen.withColumnsRenamed({"doc_id": "_id", ROW: "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(ROW) == F.col("_key"))
    found = texts.join(F.broadcast(picked), same).drop("_id", "_key")
    return found.dropDuplicates([c for c in found.columns if c != "text"]).select(*columns)
