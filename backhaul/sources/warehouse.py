"""Parquet warehouse: one folder per table below a version folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from backhaul import schemas
from backhaul.functions import month_of

# Columns that reports filter by time: files cover few months and are sorted inside.
TIME_COLUMNS = {"returns": "return_date", "orders": "order_date"}
# Spark does not compare zone-less timestamps with Parquet's statistics, but dates it does. So the day
# of these columns is stored beside them, for `between` to skip files and row groups by.
DAY_COLUMNS = {"returns": ("return_date", "created_at"), "orders": ("order_date",)}


def day_column(ts: str) -> str:
    return f"{ts}_day"


class Warehouse:
    """Tables of one version folder; those it does not hold are read from earlier versions."""

    def __init__(self, spark: SparkSession, path: str, *earlier: str):
        self.spark = spark
        self.paths = [p.rstrip("/") for p in (path, *earlier)]

    def next(self, path: str) -> Warehouse:
        """A new version on top of this one, to be written at `path`."""
        return Warehouse(self.spark, path, *self.paths)

    def location(self, name: str) -> str:
        return f"{self.paths[0]}/{name}"

    def table(self, name: str) -> DataFrame:
        """The newest version of a table, or an empty one if it was never written."""
        schema = schemas.TABLES[name].schema
        for path in self.paths:
            if self._complete(f"{path}/{name}"):
                return self.spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.fieldNames())
        return self.spark.createDataFrame([], schema)

    def between(self, name: str, ts: str, low: datetime, high: datetime | None = None) -> DataFrame:
        """The rows of a table whose `ts` is from `low` to `high`, both included; later ones, too, if
        there is no `high`. Only row groups with such days are read."""
        rows, day = self.table(name), None
        for path in self.paths:
            if self._complete(f"{path}/{name}"):
                stored = self.spark.read.parquet(f"{path}/{name}")
                if day_column(ts) in stored.columns:  # not so in tables that others wrote
                    rows, day = stored, F.col(day_column(ts))
                break
        ends = [(F.lit(t.isoformat()).cast("timestamp_ntz"), F.lit(t.date())) for t in (low, high) if t is not None]
        rows = rows.where(F.col(ts) >= ends[0][0])
        rows = rows if day is None else rows.where(day >= ends[0][1])
        if high is not None:
            rows = rows.where(F.col(ts) <= ends[1][0])
            rows = rows if day is None else rows.where(day <= ends[1][1])
        return rows.select(*schemas.TABLES[name].columns)

    def _complete(self, folder: str) -> bool:
        """Whether a write to the folder has ended; one that broke off leaves files but no mark."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def write(self, name: str, df: DataFrame) -> None:
        """Write a whole table; refuses to replace one, since readers may be on it."""
        df = df.select(*schemas.TABLES[name].columns)
        if name in TIME_COLUMNS:
            df = by_month(df, TIME_COLUMNS[name])
            df = df.withColumns({day_column(c): F.to_date(c) for c in DAY_COLUMNS[name]})
        bloom(df.write, schemas.TABLES[name].key).parquet(self.location(name))

    def write_rejects(self, name: str, rows: DataFrame) -> None:
        """Keep rows of a batch that could not be stored, as they came."""
        rows.write.parquet(f"{self.paths[0]}/rejects/{name}")

    def has_signals_of(self, created_at: datetime) -> bool:
        """Whether the log holds a run of this time."""
        at = F.lit(created_at.isoformat()).cast("timestamp_ntz")
        return not self.table("fraud_signals").where(F.col("created_at") == at).isEmpty()

    def append_signals(self, signals: DataFrame) -> None:
        """Add rows to the log. It has a folder per day of `created_at`; files are sorted by return
        and carry a Bloom filter on it, so a period and a single return each read little."""
        rows = signals.select(*schemas.FRAUD_SIGNALS.columns).withColumn("day", F.to_date("created_at"))
        rows = rows.hint("rebalance").sortWithinPartitions("day", "return_id")
        bloom(rows.write, "return_id").mode("append").partitionBy("day").parquet(self.location("fraud_signals"))

    def register(self) -> None:
        """Temp views for the tables and KPI views, so their SQL runs by name."""
        from backhaul.plans import views

        for name in schemas.TABLES:
            self.table(name).createOrReplaceTempView(name)
        for name, build in views.VIEWS.items():
            build(self).createOrReplaceTempView(name)

    def sql(self, query: str, **args) -> DataFrame:
        """Run SQL over the registered names; `:name` markers are bound from `args`."""
        self.register()
        return self.spark.sql(query, args=args or None)


def bloom(writer: DataFrameWriter, column: str) -> DataFrameWriter:
    """Files that tell readers of single values of a column whether they can be skipped."""
    return writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
        f"parquet.bloom.filter.adaptive.enabled#{column}", "true"
    )


def by_month(df: DataFrame, ts: str) -> DataFrame:
    """Cluster rows by month; a month too big for one partition is split by AQE."""
    months = df.withColumn("_month", month_of(F.col(ts))).hint("rebalance", F.col("_month"))
    return months.drop("_month").sortWithinPartitions(ts)


def append_lines(lines: DataFrame, header: str, path: str) -> None:
    """Add files of raw lines, given as the one column `line`, to a folder of CSV files."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition
    both = F.when(first, F.array(F.lit(header), F.col("line"))).otherwise(F.array("line"))
    lines.select(both.alias("lines")).select(F.explode("lines")).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Export a table as CSV with a header, readable by the readers in this package."""
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
