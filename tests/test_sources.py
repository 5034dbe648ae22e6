from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from backhaul import schemas, sources
from backhaul.functions.text import NA_TOKENS
from backhaul.sources.csv import ADDED, MALFORMED, SEQ, malformed_rows
from backhaul.sources.warehouse import Warehouse, write_csv
from conftest import day


def day_of(date, hour=0, minute=0):
    return day(date).replace(hour=hour, minute=minute)

HEADER = "return_id,order_item_id,customer_id,return_date,return_reason,return_channel,condition_received,refund_amount"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_returns_are_typed_and_amounts_stay_text(spark, tmp_path):
    path = write(tmp_path / "returns.csv", HEADER, "1,2,3,2025-01-05,Broken,mail,New,oops", "x,2,3,bad,,mail,NA,1.5")
    rows = sources.read_returns(spark, path).orderBy(SEQ).drop(*ADDED).collect()
    assert tuple(rows[0]) == (1, 2, 3, day("2025-01-05"), "Broken", "mail", "New", "oops")
    assert tuple(rows[1]) == (None, 2, 3, None, None, "mail", None, "1.5")


def test_whole_numbers_may_carry_a_fraction_of_zero(spark, tmp_path):
    path = write(tmp_path / "items.csv", "order_item_id,quantity", "9223372036854775807,72.0", "5.0,", "99999999999999999999,3e9", "x,-2")
    rows = [tuple(r) for r in sources.read_order_items(spark, path).drop(*ADDED).collect()]
    assert rows == [(2**63 - 1, 72), (5, None), (None, None), (None, -2)]


def test_missing_columns_are_listed_sorted(spark, tmp_path):
    path = write(tmp_path / "returns.csv", "return_id,customer_id,refund_amount", "1,2,3")
    with pytest.raises(ValueError, match=r"\['condition_received', 'order_item_id', 'return_channel', 'return_date', 'return_reason'\]"):
        sources.read_returns(spark, path)


def test_column_order_is_free_and_extra_columns_stay(spark, tmp_path):
    path = write(tmp_path / "products.csv", "unit_price,note,sku,product_id", "36.36,hello,A-1,7")
    row = sources.read_products(spark, path).drop(*ADDED).first()
    assert row.asDict() == {"unit_price": row.unit_price, "note": "hello", "sku": "A-1", "product_id": 7}
    assert str(row.unit_price) == "36.36"


def test_na_tokens_are_null(spark, tmp_path):
    lines = [f'{i},"{token}"' for i, token in enumerate(NA_TOKENS)]
    path = write(tmp_path / "customers.csv", "customer_id,email", *lines, "99,na")
    df = sources.read_customers(spark, path)
    assert [r.email for r in df.where("email is not null").collect()] == ["na"]
    assert df.count() == len(NA_TOKENS) + 1


def test_files_of_a_folder_must_agree(spark, tmp_path):
    write(tmp_path / "a.csv", "customer_id,email", "1,x")
    write(tmp_path / "b.csv", "email,customer_id", "y,2")
    with pytest.raises(Exception, match="header"):
        sources.read_customers(spark, str(tmp_path)).collect()


def test_sequence_follows_the_file(spark, tmp_path):
    path = write(tmp_path / "customers.csv", "customer_id,email", *[f"{i % 7},{i}" for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = sources.read_customers(spark, path)
        assert df.rdd.getNumPartitions() > 3
        assert [r.email for r in df.orderBy(SEQ).collect()] == [str(i) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_of_another_length_than_the_header_have_no_cells(spark, tmp_path):
    lines = ["1,a,b", '2,"x,y",c', "3,a", "4,a,b,c", "", '5,"open,b', "6,,", "7", '8,"a ""q"" b",z', "9,a,b,"]
    path = write(tmp_path / "customers.csv", "customer_id,email,segment", *lines)
    df = sources.read_customers(spark, path)
    whole = df.where(F.col(MALFORMED).isNull()).drop(*ADDED).collect()
    assert [tuple(r) for r in whole] == [(1, "a", "b"), (2, "x,y", "c"), (6, None, None), (8, 'a "q" b', "z")]
    torn = df.where(F.col(MALFORMED).isNotNull()).orderBy(SEQ).drop(SEQ).collect()
    assert [tuple(r) for r in torn] == [(None, None, None, x) for x in ("3,a", "4,a,b,c", '5,"open,b', "7", "9,a,b,")]
    # However few columns are asked for, all are counted.
    assert [r.customer_id for r in df.select("customer_id").collect()] == [1, 2, None, None, None, 6, None, 8, None]
    assert [r[MALFORMED] for r in malformed_rows(df).orderBy(SEQ).collect()][0] == "3,a"
    many = sources.read_customers(spark, path, multi_line=True).where(F.col(MALFORMED).isNotNull())
    assert [r[MALFORMED] for r in many.collect()] == ["3,a", "4,a,b,c", "9,a,b,"]


def dates(frame):
    return [r.order_date for r in frame.orderBy(SEQ).collect()]


def test_a_file_settles_the_order_of_day_and_month(spark, tmp_path, caplog):
    head = "order_id,order_date,customer_id"
    folder = tmp_path / "orders"
    folder.mkdir()
    write(folder / "a.csv", head, "1,3/4/2025,1", "2,25/4/2025 7:05,1", "3,2025-01-02,1", '4,"Jan 5, 2025",1', "5,soon,1", "6,,1")
    write(folder / "b.csv", head, "1,3/4/2025,1", "2,4/25/2025,1", "3,10/11/2025,1")
    write(folder / "c.csv", head, "1,3/4/2025,1", "2,31/31/2025,1")
    # A row with a field too many has no say, nor has a text column.
    write(folder / "d.csv", head, "1,3/4/2025,1", "2,25/4/2025,1,1", "3,3/5/2025,25/4/2025")
    write(folder / "e.csv", head, "1,3/4/2025,1", "2,25/4/2025,1", "3,4/25/2025,1")
    month, day = day_of("2025-03-04"), day_of("2025-04-03")
    assert dates(sources.read_orders(spark, str(folder))) == [
        day, day_of("2025-04-25", 7, 5), day_of("2025-01-02"), day_of("2025-01-05"), None, None,
        month, day_of("2025-04-25"), day_of("2025-10-11"), month, None,
        month, None, day_of("2025-03-05"), month, None, day_of("2025-04-25"),
    ]
    assert "e.csv" in caplog.text and "a.csv" not in caplog.text
    found = {r.file[-5:]: tuple(r)[1:] for r in sources.date_orders(spark, str(folder), schemas.ORDERS).collect()}
    assert found == {
        "a.csv": ("order_date", 0, 1, 1, "day"),
        "b.csv": ("order_date", 1, 0, 2, "month"),
        "c.csv": ("order_date", 0, 0, 1, "month"),
        "d.csv": ("order_date", 0, 0, 2, "month"),
        "e.csv": ("order_date", 1, 1, 1, "mixed"),
    }
    many = sources.read_orders(spark, str(folder / "a.csv"), multi_line=True)
    assert dates(many)[:2] == [day, day_of("2025-04-25", 7, 5)]


def test_the_order_of_dates_may_be_told(spark, tmp_path):
    path = write(tmp_path / "orders.csv", "order_id,order_date", "1,3/4/2025", "2,25/4/2025")
    assert dates(sources.read_orders(spark, path, date_order="month")) == [day_of("2025-03-04"), None]
    assert dates(sources.read_orders(spark, path, date_order="day")) == [day_of("2025-04-03"), day_of("2025-04-25")]
    only = sources.read_orders(spark, path, date_formats=("M/d/yyyy",), date_order="month")
    assert dates(only) == [day_of("2025-03-04"), None]
    with pytest.raises(ValueError, match="week"):
        sources.read_orders(spark, path, date_order="week")


def test_reserved_column_names_are_refused(spark, tmp_path):
    path = write(tmp_path / "customers.csv", "customer_id,Malformed_Row", "1,a")
    with pytest.raises(ValueError, match="malformed_row"):
        sources.read_customers(spark, path)


def test_csv_round_trip_keeps_text(spark, tmp_path):
    rows = [(1, ' padded "quoted", text '), (2, None), (3, "two\nlines"), (4, "back\\slash")]
    write_csv(spark.createDataFrame(rows, "customer_id long, email string"), str(tmp_path / "out"))
    back = sources.read_customers(spark, str(tmp_path / "out"), multi_line=True)
    assert sorted(tuple(r) for r in back.drop(*ADDED).collect()) == rows


def test_warehouse_versions(spark, seed, tmp_path):
    first = Warehouse(spark, str(tmp_path / "v1"))
    assert first.table("orders").count() == 0
    first.write("orders", seed.table("orders"))
    first.write("customers", seed.table("customers"))
    second = first.next(str(tmp_path / "v2"))
    second.write("orders", seed.table("orders").where("order_id < 1003"))
    assert second.table("orders").count() == 2
    assert second.table("customers").count() == 4
    assert first.table("orders").count() == 4
    with pytest.raises(Exception, match="already exists"):
        second.write("orders", seed.table("orders"))


def test_sql_runs_by_name_with_parameters(spark, seed, tmp_path):
    store = Warehouse(spark, str(tmp_path / "wh"))
    for name in ("customers", "products", "orders", "order_items", "returns"):
        store.write(name, seed.table(name))
    query = "select return_id, segment from v_high_risk_returns where return_id = :return_id"
    assert [tuple(r) for r in store.sql(query, return_id=9004).collect()] == [(9004, "new")]
    counts = store.sql("select count(*) as n from returns r left join fraud_signals s on s.return_id = r.return_id")
    assert counts.first().n == 4
    assert store.sql("select sum(lifetime_returns) as n from v_customer_return_summary").first().n == 4


def test_month_layout_lets_reports_skip_files(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "wh"))
    orders = spark.range(4000).select(
        F.col("id").alias("order_id"),
        F.lit(1).alias("customer_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 700 as int))").alias("order_date"),
        F.lit("web").alias("channel"),
        F.lit(1).cast("decimal(12,2)").alias("total_amount"),
        F.lit(None).cast("string").alias("shipping_postal_code"),
    )
    store.write("orders", orders)
    stored = store.table("orders")
    assert stored.count() == 4000
    # Every file is sorted by time inside.
    rows = stored.select("order_date", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    by_file: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.i):
        by_file.setdefault(r.f, []).append(r.order_date)
    assert all(dates == sorted(dates) for dates in by_file.values())
