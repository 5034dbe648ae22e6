from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from backhaul import jobs, sources
from backhaul.sources.warehouse import Warehouse, write_csv
from conftest import day

LOADED = day("2026-01-01")


@pytest.fixture
def raw(spark, seed, tmp_path):
    for name in ("customers", "products", "orders", "order_items"):
        write_csv(seed.table(name), f"{tmp_path}/raw/{name}.csv")
    returns = seed.table("returns").drop("fraud_score", "created_at")
    write_csv(returns, f"{tmp_path}/raw/returns.csv")
    return f"{tmp_path}/raw"


def test_load_signal_train_score(spark, seed, raw, tmp_path):
    empty = Warehouse(spark, f"{tmp_path}/v0")
    first = empty.next(f"{tmp_path}/v1")
    loaded = jobs.run_etl(raw, empty, first, LOADED)
    assert loaded == dict.fromkeys(("customers", "products", "orders", "order_items", "returns"), (4, 0))
    assert list(loaded)[0] == "customers" and list(loaded)[-1] == "returns"
    for name in ("customers", "products", "orders", "order_items"):
        assert sorted(first.table(name).collect()) == sorted(seed.table(name).collect())
    got = first.table("returns").drop("condition_received")
    assert sorted(got.collect()) == sorted(seed.table("returns").drop("condition_received").collect())
    # Canonical names are not spellings of themselves.
    assert {r.condition_received for r in first.table("returns").collect()} == {"used", "damaged"}

    jobs.compute_signals(first, LOADED)
    assert first.table("fraud_signals").count() == 5
    assert not jobs.compute_signals(first, LOADED)  # a repeated run logs nothing twice
    assert first.table("fraud_signals").count() == 5
    jobs.compute_signals(first, day("2026-01-02"), since=day("2026-06-01"))
    assert first.table("fraud_signals").count() == 5
    jobs.compute_signals(first, day("2026-01-02"), since=LOADED)
    log = first.table("fraud_signals")
    assert log.count() == log.select("signal_id").distinct().count() == 10

    second = first.next(f"{tmp_path}/v2")
    with pytest.raises(FileNotFoundError):
        jobs.score_returns(first, second, f"{tmp_path}/model")
    path = jobs.train(first, f"{tmp_path}/model")
    assert jobs.score_returns(first, second, path) == 4
    scored = second.table("returns")
    assert scored.where("fraud_score is null").count() == 0
    assert scored.where("fraud_flagged <> (fraud_score >= 0.7)").count() == 0
    third = second.next(f"{tmp_path}/v3")
    assert jobs.score_returns(second, third, path) == 0
    assert third.table("returns").count() == 4

    # A reload resets the flag from the file and keeps score and load time.
    assert jobs.run_etl(raw, second, third, day("2027-01-01"))["returns"].loaded == 4
    again = {r.return_id: r for r in third.table("returns").collect()}
    before = {r.return_id: r for r in scored.collect()}
    assert {i: r.fraud_score for i, r in again.items()} == {i: r.fraud_score for i, r in before.items()}
    assert {i: r.fraud_flagged for i, r in again.items()} == {9001: False, 9002: False, 9003: False, 9004: True}
    assert {r.created_at for r in again.values()} == {LOADED}


def test_batch_larger_than_one_chunk_counts_submitted_rows(spark, tmp_path):
    lines = ["product_id,sku,category,unit_price"] + [f"{i % 900},S{i % 900},home,{i}.5" for i in range(2500)]
    (tmp_path / "products.csv").write_text("\n".join(lines))
    old = Warehouse(spark, f"{tmp_path}/a")
    new = old.next(f"{tmp_path}/b")
    batch = sources.read_products(spark, f"{tmp_path}/products.csv")
    assert jobs.upsert(old, new, "products", batch) == (2500, 0)
    stored = new.table("products")
    assert stored.count() == 900
    # The last row of every key wins.
    assert stored.where(F.col("unit_price") < 1600).count() == 0
    assert {r.return_window_days for r in stored.collect()} == {30}


def test_unknown_table_and_null_keys_are_refused(spark, tmp_path):
    old = Warehouse(spark, f"{tmp_path}/a")
    batch = spark.createDataFrame([(None, "s", "home", 1.0, 0)], "product_id long, sku string, category string, unit_price double, ingest_seq int")
    for name in ("fraud_signals", "nothing"):
        with pytest.raises(ValueError, match=name):
            jobs.upsert(old, old.next(f"{tmp_path}/b"), name, batch)
    assert not (tmp_path / "b").exists()


def test_rows_that_cannot_be_stored_are_set_aside(spark, tmp_path):
    old = Warehouse(spark, f"{tmp_path}/a")
    columns = "product_id long, sku string, category string, unit_price double, ingest_seq int"
    rows = [(1, "a", "home", 1.0, 0), (None, "s", "home", 1.0, 1), (1, None, "home", 9.0, 2), (2, "b", "home", None, 3)]
    new = old.next(f"{tmp_path}/b")
    assert jobs.upsert(old, new, "products", spark.createDataFrame(rows, columns)) == (1, 3)
    assert [(r.product_id, r.sku) for r in new.table("products").collect()] == [(1, "a")]
    aside = spark.read.parquet(f"{tmp_path}/b/rejects/products")
    assert sorted(r.ingest_seq for r in aside.collect()) == [1, 2, 3]


def test_torn_rows_go_to_rejects_with_their_text(spark, tmp_path):
    """A stray comma would shift values into the columns beside theirs, keys and flags included."""
    header = "return_id,order_item_id,customer_id,return_date,return_reason,return_channel,condition_received,refund_amount,fraud_flagged"
    torn = ["1,1,1,2025-01-01,broken, it fell,mail,used,10.00,true", "2,1,1,2025-01-01,broken", "3"]
    good = "4,1,1,2025-01-01,broken,mail,used,10.00,false"
    (tmp_path / "returns.csv").write_text("\n".join([header, torn[0], good, *torn[1:]]))
    old = Warehouse(spark, f"{tmp_path}/a")
    new = old.next(f"{tmp_path}/b")
    batch = jobs.normalize_returns(sources.read_returns(spark, f"{tmp_path}/returns.csv"))
    assert jobs.upsert(old, new, "returns", batch, LOADED, jobs.dedupe_returns) == (1, 3)
    assert [(r.return_id, r.return_channel, r.fraud_flagged) for r in new.table("returns").collect()] == [(4, "mail", False)]
    aside = spark.read.parquet(f"{tmp_path}/b/rejects/returns").collect()
    assert sorted(r.malformed_row for r in aside) == sorted(torn)
    assert {r.return_id for r in aside} == {None}


def test_an_undated_row_does_not_displace_a_good_one(spark, seed, raw, tmp_path):
    returns = seed.table("returns").drop("fraud_score", "created_at")
    text = returns.withColumn("return_date", F.col("return_date").cast("string"))
    late = text.where("return_id = 9001").withColumn("return_date", F.lit("soon"))
    other = text.where("return_id = 9002").withColumn("return_date", F.lit("11/15/2025"))
    write_csv(text.coalesce(1).union(late).union(other).coalesce(1), f"{tmp_path}/raw/returns.csv/x")
    empty = Warehouse(spark, f"{tmp_path}/v0")
    new = empty.next(f"{tmp_path}/v1")
    batch = sources.read_returns(spark, f"{tmp_path}/raw/returns.csv/x")
    assert jobs.upsert(empty, new, "returns", jobs.normalize_returns(batch), LOADED, jobs.dedupe_returns) == (5, 1)
    dates = {r.return_id: str(r.return_date)[:10] for r in new.table("returns").collect()}
    assert dates[9001] == "2025-10-05" and dates[9002] == "2025-11-15" and len(dates) == 4


def test_a_write_that_broke_off_is_not_read(spark, seed, tmp_path):
    first = Warehouse(spark, f"{tmp_path}/v1")
    first.write("products", seed.table("products"))
    second = first.next(f"{tmp_path}/v2")
    (tmp_path / "v2" / "products" / "_temporary").mkdir(parents=True)
    assert second.table("products").count() == 4


def test_training_without_returns_fails(spark, tmp_path):
    with pytest.raises(RuntimeError, match="labelled"):
        jobs.train(Warehouse(spark, f"{tmp_path}/a"), f"{tmp_path}/model")


def test_rows_are_sorted_by_the_rank_of_their_file(spark):
    """Loads carry no path per row, and rank files as their names order them."""
    places = [("file:/b", 0, 1), ("file:/a", 0, 7), ("file:/a", 9, 2), ("file:/b", 0, 0), ("file:/aa", 0, 0)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(places)], "id long, ingest_seq struct<file:string,block:long,row:long>")
    ranked = jobs.ranked_files(rows)
    assert ranked.columns == rows.columns and ranked.schema["ingest_seq"].dataType["file"].dataType.typeName() == "integer"
    order = lambda df: [r.id for r in df.orderBy("ingest_seq").collect()]
    assert order(ranked) == order(rows) == [1, 2, 4, 3, 0]
    plain = spark.createDataFrame([(1, 2)], "id long, ingest_seq long")
    assert jobs.ranked_files(plain) is plain


def test_scoring_takes_rows_of_a_repeated_return_together(spark, seed, tmp_path, monkeypatch):
    """A return with rows with and without a score gets the new one in all of them."""
    store = Warehouse(spark, f"{tmp_path}/v1")
    for name in ("customers", "products", "orders", "order_items"):
        store.write(name, seed.table(name))
    returns = seed.table("returns")
    first = returns.where("return_id = 9001").withColumn("fraud_score", F.lit("0.123").cast("decimal(4,3)"))
    store.write("returns", returns.unionByName(first))
    path = jobs.train(store, f"{tmp_path}/model")
    new = store.next(f"{tmp_path}/v2")
    assert jobs.score_returns(store, new, path) == 4
    rows = new.table("returns").where("return_id = 9001").collect()
    assert len(rows) == 2 and len({r.fraud_score for r in rows}) == 1
    # Others that have a score keep it.
    kept = Warehouse(spark, f"{tmp_path}/w1", *store.paths)
    scored = F.when(F.col("return_id") == 9002, F.lit("0.123").cast("decimal(4,3)"))
    kept.write("returns", returns.withColumn("fraud_score", scored))
    last = kept.next(f"{tmp_path}/w2")
    monkeypatch.setattr(jobs, "update_scores", None)  # all rows need not be shuffled for that
    assert jobs.score_returns(kept, last, path) == 3
    out = {r.return_id: str(r.fraud_score) for r in last.table("returns").collect()}
    assert len(out) == 4 and out[9002] == "0.123" and "None" not in out.values()
