"""Derives the six domain tables from the order-processing test tables.

The SQL runs unchanged in Spark (session zone UTC) and in other engines; `{name}` markers stand
for the source tables.
"""

from __future__ import annotations

from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from backhaul.plans.signals import all_signals, signal_log
from backhaul.session import configure_tables, scratch_path
from backhaul.sources.warehouse import Warehouse, append_lines, write_csv

LOADED_AT = datetime(2002, 1, 1)

CUSTOMERS = """
select c_custkey as customer_id,
 case when c_custkey % 10 = 0 then null else concat('user', cast(c_custkey as varchar(20)), '@example.com') end as email,
 case c_mktsegment when 'AUTOMOBILE' then 'new' when 'FURNITURE' then 'loyal' when 'HOUSEHOLD' then 'vip' else 'casual' end as segment,
 timestamp '1995-01-01 00:00:00' + interval '1' day * cast(c_custkey % 900 as int) as created_at,
 cast(c_acctbal as decimal(12,2)) as lifetime_value,
 cast(cast(c_custkey % 1000 as decimal(10,3)) / 1000 as decimal(4,3)) as risk_score
from {customer}
"""

PRODUCTS = """
select p_partkey as product_id, concat('SKU-', cast(p_partkey as varchar(20))) as sku,
 case p_type when 'PROMO' then 'apparel' when 'SMALL' then 'apparel' when 'MEDIUM' then 'beauty' when 'STANDARD' then 'electronics' else 'home' end as category,
 p_brand as subcategory, cast(p_retailprice as decimal(10,2)) as unit_price,
 case p_size % 3 when 0 then 14 when 1 then 30 else 60 end as return_window_days
from {part}
"""

ORDERS = """
select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as order_date,
 case substr(o_orderpriority,1,1) when '1' then 'web' when '2' then 'mobile' when '3' then 'bopis' when '4' then 'store' else 'web' end as channel,
 cast(o_totalprice as decimal(12,2)) as total_amount, cast(10000 + o_orderkey % 90000 as varchar(10)) as shipping_postal_code
from {orders}
"""

# l_returnflag is carried along to tell which items came back.
ORDER_ITEMS = """
select l_orderkey*1000 + l_linenumber*100 + row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as order_item_id,
 l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as int) as quantity,
 cast(p_retailprice as decimal(10,2)) as unit_price, cast(0 as decimal(10,2)) as discount_amount, l_returnflag
from {lineitem} join {part} on p_partkey = l_partkey
"""

RETURNS = """
select i.order_item_id as return_id, i.order_item_id, o.customer_id,
 case when o.customer_id % 25 = 0 then timestamp '1998-01-01 00:00:00' + interval '1' day * cast(i.order_item_id % 89 as int) else o.order_date + interval '1' day * cast(i.order_item_id * 7 % 46 as int) end + interval '1' hour * cast(i.order_item_id * 5 % 24 as int) as return_date,
 case i.order_item_id % 9 when 0 then 'defective' when 1 then 'wrong_size' when 2 then 'not_as_described' when 3 then 'changed_mind' when 4 then 'late_delivery' when 5 then 'duplicate' when 6 then 'other' when 7 then 'changed_mind' else 'wrong_size' end as return_reason,
 case i.order_item_id % 3 when 0 then 'mail' when 1 then 'in_store' else 'pickup' end as return_channel,
 case i.order_item_id % 7 when 0 then 'new_unopened' when 1 then 'opened_unused' when 2 then 'damaged' when 3 then 'missing_parts' when 4 then null else 'used' end as condition_received,
 case i.order_item_id % 11 when 0 then null when 1 then 'refurbish' when 2 then 'liquidate' when 3 then 'donate' when 4 then 'destroy' else 'restock' end as disposition,
 cast(case when i.order_item_id % 13 = 0 then i.unit_price * 2 when i.order_item_id % 13 < 4 then i.unit_price else i.unit_price - 10 end as decimal(10,2)) as refund_amount,
 cast(i.order_item_id % 19 as decimal(10,2)) as restocking_fee, cast(3 + i.order_item_id % 22 as decimal(10,2)) as processing_cost,
 cast(case i.order_item_id % 11 when 0 then 0 when 4 then 0 when 1 then 400 when 2 then 50 when 3 then 10 else i.unit_price - 20 end as decimal(10,2)) as recovered_value,
 cast(6 + i.order_item_id % 163 as int) as cycle_time_hours, i.order_item_id % 23 < 2 as fraud_flagged,
 cast(case when i.order_item_id % 17 < 4 then null else cast(i.order_item_id % 1000 as decimal(10,3)) / 1000 end as decimal(4,3)) as fraud_score,
 timestamp '2002-01-01 00:00:00' as created_at
from {order_items} i join {d_orders} o on o.order_id = i.order_id where i.l_returnflag = 'R'
"""

# Returns as a dirty source would deliver them: odd spellings, unreadable amounts, and a later
# second row for some returns. `seq` is the ingest order.
RETURNS_RAW = """
with c as (select *, 1 as seq from {returns} union all select *, 2 as seq from {returns} where return_id % 31 = 0)
 select return_id, order_item_id, customer_id,
 case when seq = 1 then return_date when return_id % 7 = 0 then null else return_date + interval '5' day end as return_date,
 case return_id % 12 when 0 then 'Broken' when 1 then ' sizing ' when 2 then 'late delivery' when 3 then null when 4 then 'Buyer Remorse' when 5 then 'NOT AS DESCRIBED' when 6 then 'late' when 7 then 'weird thing' when 8 then 'wrong_size' when 9 then 'Duplicate' when 10 then 'misrepresented' else 'changed mind' end as return_reason,
 return_channel,
 case return_id % 9 when 0 then 'Sealed' when 1 then 'new_unopened' when 2 then null when 3 then 'BROKEN' when 4 then 'lightly used' when 5 then ' opened' when 6 then 'missing_parts' when 7 then 'new' else 'used' end as condition_received,
 disposition,
 case return_id % 29 when 0 then 'oops' when 1 then null when 2 then '10.555' when 3 then '1,000' when 4 then '0.125' else cast(refund_amount as varchar(20)) end as refund_amount,
 cast(restocking_fee as varchar(20)) as restocking_fee, cast(processing_cost as varchar(20)) as processing_cost, cast(recovered_value as varchar(20)) as recovered_value,
 cycle_time_hours,
 case when return_id % 41 = 0 then null else fraud_flagged end as fraud_flagged, seq from c
"""

# Lines that a dirty source would deliver among the returns: a comma too many, or the end missing.
RETURNS_FLAWED = """
select concat(cast(return_id as varchar(20)), ',', cast(order_item_id as varchar(20)), ',', cast(customer_id as varchar(20)),
 ',1998-05-05,broken, it fell,mail,used,restock,10.00,0,0,0,5,true') as line from {returns} where return_id % 97 = 0
union all
select concat(cast(return_id as varchar(20)), ',', cast(order_item_id as varchar(20)), ',"') as line from {returns} where return_id % 97 = 1
"""


# Batches for the keyed loads: every row of a table with changed values, and a later second row
# for part of the keys. The tables they are merged into hold the part named in HISTORY.
CUSTOMERS_BATCH = """
select customer_id, upper(email) as email, segment, created_at + interval '1' day as created_at,
 cast(lifetime_value + 1 as decimal(12,2)) as lifetime_value, risk_score, 1 as seq from {customers}
union all
select customer_id, null as email, 'vip' as segment, created_at + interval '2' day as created_at,
 cast(lifetime_value + 2 as decimal(12,2)) as lifetime_value, null as risk_score, 2 as seq from {customers} where segment = 'new'
"""

PRODUCTS_BATCH = """
select product_id, sku, category, null as subcategory, cast(unit_price + 1 as decimal(10,2)) as unit_price, return_window_days, 1 as seq from {products}
union all
select product_id, concat(sku, '-B') as sku, category, subcategory, cast(unit_price + 2 as decimal(10,2)) as unit_price, 7 as return_window_days, 2 as seq from {products} where category = 'home'
"""

ORDERS_BATCH = """
select order_id, customer_id, order_date + interval '1' hour as order_date, 'store' as channel, total_amount, null as shipping_postal_code, 1 as seq from {orders}
union all
select order_id, customer_id, order_date, channel, cast(total_amount + 2 as decimal(12,2)) as total_amount, shipping_postal_code, 2 as seq from {orders} where channel = 'web'
"""

ORDER_ITEMS_BATCH = """
select order_item_id, order_id, product_id, quantity + 1 as quantity, unit_price, null as discount_amount, 1 as seq from {order_items}
union all
select order_item_id, order_id, product_id, quantity + 2 as quantity, unit_price, cast(1 as decimal(10,2)) as discount_amount, 2 as seq from {order_items} where quantity > 30
"""

# The part of each table that was loaded before.
HISTORY = {
    "customers": "created_at < timestamp '1996-06-01 00:00:00'",
    "products": "return_window_days < 60",
    "orders": "order_date < timestamp '1998-04-01 00:00:00'",
    "order_items": "quantity < 25",
    "returns": "return_date < timestamp '1998-04-01 00:00:00'",
}


DERIVED = {
    "returns_raw": (RETURNS_RAW, "returns"),
    "customers_batch": (CUSTOMERS_BATCH, "customers"),
    "products_batch": (PRODUCTS_BATCH, "products"),
    "orders_batch": (ORDERS_BATCH, "orders"),
    "order_items_batch": (ORDER_ITEMS_BATCH, "order_items"),
}


class SampleWarehouse(Warehouse):
    """The domain tables, written to scratch the first time one is read."""

    def __init__(self, spark: SparkSession, source: str):
        super().__init__(spark, scratch_path(spark, "warehouse"))
        self.source = source
        self.ready: dict[str, DataFrame] = {}
        self.exported: dict[str, str] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.source}/{name}.parquet")

    def csv(self, name: str) -> str:
        """A table as CSV files below one folder, written the first time it is asked for."""
        if name not in self.exported:
            rows = self.table("returns_raw" if name == "returns" else name)
            if name == "returns":
                # Range partitioned, so that the files follow the ingest order.
                rows = rows.orderBy("seq", "return_id").drop("seq")
            path = f"{self.location('csv')}/{name}.csv"
            write_csv(rows, path)
            if name == "returns":
                header = ",".join(rows.columns)
                append_lines(self.spark.sql(RETURNS_FLAWED, returns=self.table("returns")), header, path)
            self.exported[name] = path
        return self.exported[name]

    def history(self, name: str) -> DataFrame:
        return self.table(name).where(HISTORY[name])

    def table(self, name: str) -> DataFrame:
        if name not in self.ready:
            self.ready[name] = self._derive(name)
        return self.ready[name]

    def _derive(self, name: str) -> DataFrame:
        if name in DERIVED:
            sql, base = DERIVED[name]
            return self.spark.sql(sql, **{base: self.table(base)})
        if name == "customers":
            self.write(name, self.spark.sql(CUSTOMERS, customer=self.raw("customer")))
        elif name == "products":
            self.write(name, self.spark.sql(PRODUCTS, part=self.raw("part")))
        elif name == "orders":
            self.write(name, self.spark.sql(ORDERS, orders=self.raw("orders")))
        elif name == "order_items":
            sources = {"lineitem": self.raw("lineitem"), "part": self.raw("part")}
            self.spark.sql(ORDER_ITEMS, **sources).write.parquet(self.location(name))
        elif name == "returns":
            orders = self.table("orders")
            self.table("order_items")
            items = self.spark.read.parquet(self.location("order_items"))
            self.write(name, self.spark.sql(RETURNS, order_items=items, d_orders=orders))
        elif name == "fraud_signals":
            inputs = [self.table(t) for t in ("returns", "order_items", "orders")]
            self.append_signals(signal_log(all_signals(*inputs), LOADED_AT))
        return super().table(name)


@cache
def _open(spark: SparkSession, source: str) -> SampleWarehouse:
    return SampleWarehouse(spark, source)


def open_tables(spark: SparkSession, source: str) -> SampleWarehouse:
    """The derived warehouse of a folder of test tables; one per session and folder."""
    return _open(configure_tables(spark), source.rstrip("/"))
