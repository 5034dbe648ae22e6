"""Raw CSV drops.

Every reader returns the columns its file has, typed by the table definition, plus two more.
`ingest_seq` is a struct that orders rows as they lie in the files, which decides "later row wins"
wherever a key repeats. `malformed_row` is null for a row with as many fields as its header. A row
with more or fewer, whose values cannot be told apart from those of the columns beside them, has
nulls in all columns of the file and its raw text there, so it has no key and no load takes it.

`3/4/2025` reads two ways. The cells of a file that read one way only (`25/4/2025`) settle the order of
day and month for all its cells in that column (`date_orders`); without any, or with some of either
kind, the month comes first. That takes a look at all lines of the files, when a reader is called, but
parses only those that hold such a date; `date_order="month"` or `"day"` tells the order and saves it.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType, TimestampNTZType

from backhaul import schemas
from backhaul.functions import null_tokens

log = logging.getLogger(__name__)

SEQ = "ingest_seq"
MALFORMED = "malformed_row"
#: What a reader adds to the columns of a file.
ADDED = (SEQ, MALFORMED)
_FILE, _DAYS = "_day_first_file", "_day_first"
#: Formats tried in turn for dates that are not ISO.
DATE_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyyMMdd")
_SLASHED = r"^\s*([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}"

# Cleaned by `transform_returns`, which must see the original text.
RETURN_TEXT_COLUMNS = (
    "refund_amount",
    "restocking_fee",
    "processing_cost",
    "recovered_value",
    "fraud_flagged",
)


def _typed(text: Column, kind: DataType, formats: tuple[str, ...]) -> Column:
    """Cell as the given type, null if it does not read as one."""
    if isinstance(kind, IntegralType):
        # A whole-number column with gaps is often written as "72.0"; any other fraction is no id.
        number = text.try_cast("decimal(30,10)")
        return F.when(number == F.floor(number), number).try_cast(kind)
    if isinstance(kind, TimestampNTZType):
        others = [F.try_to_timestamp(text, F.lit(f)).cast(kind) for f in formats]
        return F.coalesce(text.try_cast(kind), *others)
    return text.try_cast(kind)


def _dates(header: StructType, table: schemas.Table) -> list[str]:
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return [c for c in header.fieldNames() if isinstance(kinds.get(c), TimestampNTZType)]


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def _parsed(spark: SparkSession, path: str, header: StructType, multi_line: bool) -> DataFrame:
    """Cells as text, and the raw text of rows of another length than the header.

    Any text is text, so the parser finds fault with the number of fields only. It must not skip those
    of unused columns, or it could not count them.
    """
    return (
        _reader(spark, multi_line)
        .schema(header.add(MALFORMED, StringType()))
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", False)
        .csv(path)
    )


def date_orders(spark: SparkSession, path: str, table: schemas.Table, multi_line: bool = False) -> DataFrame:
    """How the slashed dates of each file and date column are written: file, column_name, cells that
    read with the month first only, with the day first only and either way, and the `reading` that
    follows: `month` (also without evidence), `day` or `mixed`. Columns without such dates have no row.
    Rows of another length than the header have no say.
    """
    header = _reader(spark, multi_line).csv(path).schema
    columns = _dates(header, table)
    file = F.col("_metadata.file_path").alias("file")
    if multi_line:
        rows = _parsed(spark, path, header, multi_line).select(file, "*")
    else:
        options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
        fields = ", ".join(f"`{c}` string" for c in [*header.fieldNames(), MALFORMED])
        lines = spark.read.text(path).where(F.col("value").rlike(r"[0-9]/[0-9]{1,2}/[0-9]{4}"))
        rows = lines.select(file, F.from_csv("value", fields, options).alias("row")).select("file", "row.*")
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("text")) for c in columns]
    none = "array<struct<column_name:string,text:string>>"
    each = rows.where(F.col(MALFORMED).isNull()).select("file", F.inline(F.array(*cells).cast(none)))
    first, second = (F.regexp_extract("text", _SLASHED, i).cast("int") for i in (1, 2))
    each = each.where(F.col("text").rlike(_SLASHED)).select("file", "column_name", first.alias("a"), second.alias("b"))
    month_fits = F.col("a").between(1, 12) & F.col("b").between(1, 31)
    day_fits = F.col("b").between(1, 12) & F.col("a").between(1, 31)
    counts = each.groupBy("file", "column_name").agg(
        F.count_if(month_fits & ~day_fits).alias("n_month_first"),
        F.count_if(day_fits & ~month_fits).alias("n_day_first"),
        F.count_if(month_fits & day_fits).alias("n_either"),
    )
    month, day = F.col("n_month_first") > 0, F.col("n_day_first") > 0
    return counts.withColumn("reading", F.when(month & day, "mixed").when(day, "day").otherwise("month"))


def _read(
    spark: SparkSession,
    path: str,
    table: schemas.Table,
    as_text: tuple[str, ...] = (),
    multi_line: bool = False,
    date_formats: tuple[str, ...] = DATE_FORMATS,
    date_order: str = "vote",
) -> DataFrame:
    if date_order not in ("vote", "month", "day"):
        raise ValueError(f"date_order is vote, month or day, not {date_order!r}")
    # The first file's header names the columns; enforceSchema=False then makes any file of a
    # folder whose header differs fail instead of being read misaligned.
    header = _reader(spark, multi_line).csv(path).schema
    if taken := sorted({*ADDED, _FILE, _DAYS} & {c.lower() for c in header.fieldNames()}):
        raise ValueError(f"{path} has columns whose names are reserved: {taken}")
    names = header.fieldNames()
    rows = _parsed(spark, path, header, multi_line)
    types = {f.name: f.dataType for f in table.schema.fields if f.name not in as_text}
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Spark refuses to read the faulty text alone, so it comes with the first column.
    first = F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))
    torn = F.when(F.length(F.concat(MALFORMED, first)) >= 0, F.col(MALFORMED))
    dates = [c for c in _dates(header, table) if c not in as_text]
    swapped = tuple("d/M/" + f.removeprefix("M/d/") if f.startswith("M/d/") else f for f in date_formats)
    voting = dates and date_order == "vote" and swapped != date_formats
    day_first = _day_first(date_orders(spark, path, table, multi_line)) if voting else {}
    if date_order == "day":
        date_formats = swapped

    def cell(c: str) -> Column:
        text, kind = null_tokens(F.col(f"`{c}`")), types.get(c, StringType())
        value = _typed(text, kind, date_formats)
        if c in day_first:
            value = F.when(F.col(f"{_DAYS}.{c}"), _typed(text, kind, swapped)).otherwise(value)
        return F.when(F.col(MALFORMED).isNull(), value).alias(c)

    if not day_first:
        return rows.select(*map(cell, names), seq.alias(SEQ), torn.alias(MALFORMED))
    # One row per file that writes the day first, whose names the driver holds anyway to read them.
    files = sorted(set().union(*day_first.values()))
    marks = spark.createDataFrame(
        [(f, tuple(f in day_first[c] for c in day_first)) for f in files],
        f"{_FILE} string, {_DAYS} struct<{', '.join(f'{c}: boolean' for c in day_first)}>",
    )
    placed = rows.select(*[F.col(f"`{c}`") for c in names], seq.alias(SEQ), torn.alias(MALFORMED))
    joined = placed.join(F.broadcast(marks), F.col(f"{SEQ}.file") == F.col(_FILE), "left")
    return joined.select(*map(cell, names), SEQ, MALFORMED)


def _day_first(orders: DataFrame) -> dict[str, set[str]]:
    """Per column the files that write the day first; a warning for those that write both."""
    out: dict[str, set[str]] = {}
    for r in orders.where("reading <> 'month'").collect():
        if r.reading == "day":
            out.setdefault(r.column_name, set()).add(r.file)
        else:
            log.warning(
                "%s: dates of %s are mixed, %d with the month and %d with the day first; read with the month first",
                r.file, r.column_name, r.n_month_first, r.n_day_first,
            )
    return out


def malformed_rows(rows: DataFrame) -> DataFrame:
    """Place and raw text of the malformed rows of what a reader returned."""
    return rows.where(F.col(MALFORMED).isNotNull()).select(SEQ, MALFORMED)


def read_returns(spark: SparkSession, path: str, **options) -> DataFrame:
    """Returns file; amounts and the fraud flag stay text. Fails if a required column is missing."""
    df = _read(spark, path, schemas.RETURNS, RETURN_TEXT_COLUMNS, **options)
    missing = sorted(set(schemas.REQUIRED_RETURN_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks required columns: {missing}")
    return df


def read_customers(spark: SparkSession, path: str, **options) -> DataFrame:
    return _read(spark, path, schemas.CUSTOMERS, **options)


def read_products(spark: SparkSession, path: str, **options) -> DataFrame:
    return _read(spark, path, schemas.PRODUCTS, **options)


def read_orders(spark: SparkSession, path: str, **options) -> DataFrame:
    return _read(spark, path, schemas.ORDERS, **options)


def read_order_items(spark: SparkSession, path: str, **options) -> DataFrame:
    return _read(spark, path, schemas.ORDER_ITEMS, **options)
