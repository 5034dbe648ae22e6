"""SQL over the raw test tables with the same results as the registered queries (DuckDB)."""

from __future__ import annotations

from backhaul import adapter
from backhaul.adapter import HISTORY

# Derived tables, each after the ones it reads. `d_orders`: `orders` is a raw table's name.
CTES = {
    "customers": (adapter.CUSTOMERS.format(customer="customer"), ()),
    "products": (adapter.PRODUCTS.format(part="part"), ()),
    "d_orders": (adapter.ORDERS.format(orders="orders"), ()),
    "order_items": (adapter.ORDER_ITEMS.format(lineitem="lineitem", part="part"), ()),
    "returns": (
        adapter.RETURNS.format(order_items="order_items", d_orders="d_orders"),
        ("order_items", "d_orders"),
    ),
    "returns_raw": (adapter.RETURNS_RAW.format(returns="returns"), ("returns",)),
    "returns_flawed": (adapter.RETURNS_FLAWED.format(returns="returns"), ("returns",)),
    "customers_batch": (adapter.CUSTOMERS_BATCH.format(customers="customers"), ("customers",)),
    "products_batch": (adapter.PRODUCTS_BATCH.format(products="products"), ("products",)),
    "orders_batch": (adapter.ORDERS_BATCH.format(orders="d_orders"), ("d_orders",)),
    "order_items_batch": (
        adapter.ORDER_ITEMS_BATCH.format(order_items="order_items"),
        ("order_items",),
    ),
    "categorised": (
        """select r.*, p.category from returns r
           join order_items i on i.order_item_id = r.order_item_id
           join products p on p.product_id = i.product_id""",
        ("returns", "order_items", "products"),
    ),
    "enriched": (
        """select r.*, i.unit_price, (epoch_us(r.return_date) - epoch_us(o.order_date)) / 86400e6 as days_since_purchase
           from returns r left join order_items i on i.order_item_id = r.order_item_id
           left join d_orders o on o.order_id = i.order_id""",
        ("returns", "order_items", "d_orders"),
    ),
    "daily": (
        """select day, sum(returns) as returns, sum(items) as items from (
             select cast(return_date as date) as day, 1 as returns, 0 as items from returns
             union all select cast(o.order_date as date), 0, 1 from order_items i join d_orders o on o.order_id = i.order_id)
           where day is not null group by day""",
        ("returns", "order_items", "d_orders"),
    ),
    "prior_returns": (
        """select return_id, count(*) over (partition by customer_id order by return_date
             range between interval 90 days preceding and interval 1 microsecond preceding) as n
           from returns""",
        ("returns",),
    ),
    "serial_returner": (
        """select return_id, 'serial_returner' as signal_type, case when n > 10 then 'high' else 'medium' end as severity,
             round(least(1.0, cast(n as double) / 15), 6) as score,
             concat('{"returns_in_window":', n, ',"window_days":90}') as evidence
           from prior_returns where n > 5""",
        ("prior_returns",),
    ),
    "wardrobing": (
        """select return_id, 'wardrobing' as signal_type, 'high' as severity, cast(0.85 as double) as score,
             concat('{"days_since_purchase":', cast(trunc(days_since_purchase) as integer), '}') as evidence
           from enriched
           where days_since_purchase >= 1 and days_since_purchase <= 3
             and return_reason in ('changed_mind', 'not_as_described')""",
        ("enriched",),
    ),
    "time_anomaly": (
        """select return_id, 'time_anomaly' as signal_type, 'low' as severity, cast(0.35 as double) as score,
             concat('{"return_date":"', strftime(return_date, '%Y-%m-%d %H:%M:%S'), '"}') as evidence
           from returns where hour(return_date) in (23, 0, 1, 2, 3)""",
        ("returns",),
    ),
    "value_mismatch": (
        """select return_id, 'value_mismatch' as signal_type, 'high' as severity, cast(0.95 as double) as score,
             concat('{"refund_amount":', cast(refund_amount as double), ',"unit_price":', cast(unit_price as double), '}') as evidence
           from enriched where refund_amount > unit_price""",
        ("enriched",),
    ),
    "signals": (
        """select *, 'rules_v1' as model_version from (
             select * from serial_returner union all select * from wardrobing
             union all select * from time_anomaly union all select * from value_mismatch)""",
        ("serial_returner", "wardrobing", "time_anomaly", "value_mismatch"),
    ),
    "event_counts": (
        """select event_id as return_id, count(*) over (partition by user_id order by ts
             range between interval 90 days preceding and interval 1 microsecond preceding) as n
           from events""",
        (),
    ),
    "cleaned": (
        """select return_id, order_item_id, customer_id, return_date,
             case lower(trim(return_reason))
               when 'broken' then 'defective' when 'defective' then 'defective' when 'damaged' then 'defective'
               when 'sizing' then 'wrong_size' when 'wrong size' then 'wrong_size' when 'wrong_size' then 'wrong_size'
               when 'misrepresented' then 'not_as_described' when 'not as described' then 'not_as_described'
               when 'not_as_described' then 'not_as_described'
               when 'buyer remorse' then 'changed_mind' when 'changed mind' then 'changed_mind' when 'changed_mind' then 'changed_mind'
               when 'late' then 'late_delivery' when 'late_delivery' then 'late_delivery'
               when 'duplicate' then 'duplicate' else 'other' end as return_reason,
             return_channel,
             case lower(trim(condition_received))
               when 'new' then 'new_unopened' when 'sealed' then 'new_unopened' when 'unopened' then 'new_unopened'
               when 'opened' then 'opened_unused' when 'broken' then 'damaged' when 'damaged' then 'damaged'
               else 'used' end as condition_received,
             disposition,
             round_even(coalesce(try_cast(refund_amount as double), 0) * 100, 0) / 100 as refund_amount,
             round_even(coalesce(try_cast(restocking_fee as double), 0) * 100, 0) / 100 as restocking_fee,
             round_even(coalesce(try_cast(processing_cost as double), 0) * 100, 0) / 100 as processing_cost,
             round_even(coalesce(try_cast(recovered_value as double), 0) * 100, 0) / 100 as recovered_value,
             cycle_time_hours, coalesce(fraud_flagged, false) as fraud_flagged, seq
           from returns_raw""",
        ("returns_raw",),
    ),
    "cleaned_latest": (
        """select * from cleaned
           qualify row_number() over (partition by return_id order by return_date desc nulls first, seq desc) = 1""",
        ("cleaned",),
    ),
    "storable_latest": (
        """select * from storable
           qualify row_number() over (partition by return_id order by return_date desc nulls first, seq desc) = 1""",
        ("storable",),
    ),
    "storable": (
        """select * from cleaned where return_id is not null and order_item_id is not null and customer_id is not null
           and return_date is not null and return_reason is not null and return_channel is not null and refund_amount is not null""",
        ("cleaned",),
    ),
    "customer_counts": (
        """select c.customer_id, count(r.return_id) as lifetime_returns
           from customers c left join returns r on r.customer_id = c.customer_id group by c.customer_id""",
        ("customers", "returns"),
    ),
    "features": (
        """select r.return_id, r.fraud_flagged, r.fraud_score, r.refund_amount, r.restocking_fee, r.cycle_time_hours,
             r.return_reason, r.return_channel, r.condition_received,
             (epoch_us(r.return_date) - epoch_us(o.order_date)) / 86400e6 as days_since_purchase,
             coalesce(c.lifetime_returns, 0) as customer_lifetime_returns
           from returns r join order_items i on i.order_item_id = r.order_item_id
           join d_orders o on o.order_id = i.order_id
           left join customer_counts c on c.customer_id = r.customer_id""",
        ("returns", "order_items", "d_orders", "customer_counts"),
    ),
    "labelled": ("select * from features where fraud_flagged is not null", ("features",)),
}

def _with(sql: str, *needs: str) -> str:
    """Prefix `sql` with the derived tables it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in CTES[name][1]:
                visit(need)
            order.append(name)

    for need in needs:
        visit(need)
    return f"with {', '.join(f'{name} as ({CTES[name][0].strip()})' for name in order)} {sql}"


def _upsert(target: str, batch: str, key: str, updated: dict[str, str], kept: dict[str, str], new: dict[str, str]) -> str:
    """Merge in SQL: `updated` from the last row of a key; `kept` and `new` only for new keys,
    from its first row or as a constant. Values give the result type."""
    cells = [f"coalesce(t.{key}, l.{key}) as {key}"]
    cells += [
        f"cast(case when l.{key} is not null then l.{c} else t.{c} end as {kind}) as {c}"
        for c, kind in updated.items()
    ]
    cells += [
        f"cast(case when t.{key} is not null then t.{c} else f.{c} end as {kind}) as {c}"
        for c, kind in kept.items()
    ]
    cells += [f"case when t.{key} is not null then t.{c} else {value} end as {c}" for c, value in new.items()]
    return f"""select {', '.join(cells)} from ({target}) t
        full join (select * from {batch} qualify row_number() over (partition by {key} order by seq desc) = 1) l on l.{key} = t.{key}
        left join (select * from {batch} qualify row_number() over (partition by {key} order by seq) = 1) f on f.{key} = l.{key}"""


RETURNS_UPDATED = {
    "condition_received": "varchar",
    "disposition": "varchar",
    "refund_amount": "double",
    "processing_cost": "double",
    "recovered_value": "double",
    "cycle_time_hours": "bigint",
    "fraud_flagged": "boolean",
}
RETURNS_KEPT = {
    "order_item_id": "bigint",
    "customer_id": "bigint",
    "return_date": "timestamp",
    "return_reason": "varchar",
    "return_channel": "varchar",
    "restocking_fee": "double",
}
RETURNS_NEW = {"fraud_score": "null", "created_at": "timestamp '2002-01-01 00:00:00'"}


def _upsert_returns(batch: str) -> str:
    merged = _upsert(
        f"select * from returns where {HISTORY['returns']}",
        batch,
        "return_id",
        RETURNS_UPDATED,
        RETURNS_KEPT,
        RETURNS_NEW,
    )
    return f"select * replace (cast(fraud_score as double) as fraud_score) from ({merged})"


def _astray(source: str, key: str, column: str, every: int) -> str:
    """A table of which some rows refer to negative keys, which no parent has."""
    return f"(select * replace (case when {key} % {every} = 0 then -{column} else {column} end as {column}) from {source})"


def _repeated(name: str, source: str, column: str) -> str:
    return f"""select '{name}' as table_name, '{column}' as column_name, cast({column} as varchar) as value, count(*) as n_rows
        from {source} group by {column} having count(*) > 1 or {column} is null"""


def _orphans(name: str, source: str, column: str, parent: str, key: str) -> str:
    return f"""select '{name}' as table_name, '{column}' as column_name, cast({column} as varchar) as value, count(*) as n_rows
        from {source} c where {column} is not null
        and not exists (select 1 from ({parent}) p where p.{key} = c.{column}) group by {column}"""


def _nulls(name: str, source: str, *columns: str) -> str:
    return " union all ".join(
        f"select '{name}' as table_name, '{c}' as column_name, count(*) filter (where {c} is null) as n_nulls from {source}"
        for c in columns
    )


def _outside(name: str, source: str, column: str, *domain: str) -> str:
    values = ", ".join(f"'{v}'" for v in domain)
    return f"""select '{name}' as table_name, '{column}' as column_name, {column} as value, count(*) as n_rows
        from {source} where {column} not in ({values}) group by {column}"""


def _old(name: str, source: str | None = None) -> str:
    return f"select * from {source or name} where {HISTORY[name]}"


# The log's rows stand in for the log: its ids are unique, its columns never null.
LOG = "(select row_number() over () as signal_id, *, now() as created_at from signals)"

RAW_COLUMNS = """return_id, order_item_id, customer_id, return_date, return_reason, return_channel, condition_received,
    disposition, refund_amount, restocking_fee, processing_cost, recovered_value"""

# Findings of one kind over all tables.
KEYS = " union all ".join(
    [
        _repeated("customers", "customers", "customer_id"),
        _repeated("products", "products", "product_id"),
        _repeated("orders", "d_orders", "order_id"),
        _repeated("order_items", "order_items", "order_item_id"),
        _repeated("returns", "returns_raw", "return_id"),
        _repeated("fraud_signals", LOG, "signal_id"),
    ]
)
REFERENCES = " union all ".join(
    [
        _orphans("orders", _astray("d_orders", "order_id", "customer_id", 97), "customer_id", "select * from customers", "customer_id"),
        _orphans("order_items", _astray("order_items", "order_item_id", "order_id", 89), "order_id", "select * from d_orders", "order_id"),
        _orphans("order_items", _astray("order_items", "order_item_id", "product_id", 83), "product_id", "select * from products", "product_id"),
        _orphans("returns", _astray("returns", "return_id", "order_item_id", 79), "order_item_id", "select * from order_items", "order_item_id"),
        _orphans("returns", _astray("returns", "return_id", "customer_id", 73), "customer_id", "select * from customers", "customer_id"),
        _orphans("fraud_signals", "signals", "return_id", "select * from returns", "return_id"),
    ]
)
REQUIRED = " union all ".join(
    [
        _nulls("customers", "customers", "customer_id", "segment", "created_at"),
        _nulls("products", "products", "product_id", "sku", "category", "unit_price"),
        _nulls("orders", "d_orders", "order_id", "customer_id", "order_date", "channel", "total_amount"),
        _nulls("order_items", "order_items", "order_item_id", "order_id", "product_id", "quantity", "unit_price"),
        _nulls(
            "returns", "returns_raw", "return_id", "order_item_id", "customer_id", "return_date",
            "return_reason", "return_channel", "refund_amount",
        ),
        _nulls("fraud_signals", LOG, "signal_id", "return_id", "signal_type", "severity", "score", "created_at"),
    ]
)
DOMAINS = " union all ".join(
    [
        _outside("customers", "customers", "segment", "new", "casual", "loyal", "vip"),
        _outside("products", "products", "category", "apparel", "electronics", "home", "beauty"),
        _outside("orders", "d_orders", "channel", "web", "mobile", "bopis", "store"),
        _outside(
            "returns", "returns_raw", "return_reason", "defective", "wrong_size", "not_as_described",
            "changed_mind", "late_delivery", "duplicate", "other",
        ),
        _outside("returns", "returns_raw", "return_channel", "mail", "in_store", "pickup"),
        _outside(
            "returns", "returns_raw", "condition_received", "new_unopened", "opened_unused", "used",
            "damaged", "missing_parts",
        ),
        _outside("returns", "returns_raw", "disposition", "restock", "refurbish", "liquidate", "donate", "destroy"),
        _outside(
            "fraud_signals", "signals", "signal_type", "serial_returner", "wardrobing", "bopis_not_returned",
            "time_anomaly", "value_mismatch", "condition_mismatch",
        ),
        _outside("fraud_signals", "signals", "severity", "low", "medium", "high"),
    ]
)
RAW_REFERENCES = " union all ".join(
    [
        _orphans("orders", _astray("d_orders", "order_id", "customer_id", 97), "customer_id", "select * from customers", "customer_id"),
        _orphans("order_items", _astray("order_items", "order_item_id", "order_id", 89), "order_id", "select * from d_orders", "order_id"),
        _orphans("order_items", _astray("order_items", "order_item_id", "product_id", 83), "product_id", "select * from products", "product_id"),
        _orphans("returns", _astray("returns_raw", "return_id", "order_item_id", 79), "order_item_id", "select * from order_items", "order_item_id"),
        _orphans("returns", _astray("returns_raw", "return_id", "customer_id", 73), "customer_id", "select * from customers", "customer_id"),
    ]
)

ORACLES: dict[str, str] = {
    # CSV sources and sinks
    "scan_returns": _with(
        f"select {RAW_COLUMNS}, cast(cycle_time_hours as bigint) as cycle_time_hours, cast(fraud_flagged as varchar) as fraud_flagged from returns_raw",
        "returns_raw",
    ),
    "scan_customers": _with(
        """select * replace (cast(lifetime_value as double) as lifetime_value, cast(risk_score as double) as risk_score) from customers""",
        "customers",
    ),
    "scan_orders": _with("select * replace (cast(total_amount as double) as total_amount) from d_orders", "d_orders"),
    "scan_order_items": _with(
        """select order_item_id, order_id, product_id, cast(quantity as bigint) as quantity, cast(unit_price as double) as unit_price,
           cast(discount_amount as double) as discount_amount from order_items""",
        "order_items",
    ),
    "scan_products": _with(
        """select * replace (cast(unit_price as double) as unit_price, cast(return_window_days as bigint) as return_window_days) from products""",
        "products",
    ),
    "scan_malformed": _with("select line as malformed_row, cast(0 as bigint) as n_cells from returns_flawed", "returns_flawed"),
    # keyed writes
    "upsert_customers": _with(
        _upsert(
            _old("customers"), "customers_batch", "customer_id",
            {"email": "varchar", "segment": "varchar", "lifetime_value": "double", "risk_score": "double"},
            {"created_at": "timestamp"}, {},
        ),
        "customers_batch",
    ),
    "upsert_products": _with(
        _upsert(
            _old("products"), "products_batch", "product_id",
            {"sku": "varchar", "category": "varchar", "subcategory": "varchar", "unit_price": "double", "return_window_days": "bigint"},
            {}, {},
        ),
        "products_batch",
    ),
    "upsert_orders": _with(
        _upsert(
            _old("orders", "d_orders"), "orders_batch", "order_id",
            {"customer_id": "bigint", "order_date": "timestamp", "channel": "varchar", "total_amount": "double", "shipping_postal_code": "varchar"},
            {}, {},
        ),
        "orders_batch",
    ),
    "upsert_order_items": _with(
        _upsert(
            _old("order_items"), "order_items_batch", "order_item_id",
            {"order_id": "bigint", "product_id": "bigint", "quantity": "bigint", "unit_price": "double", "discount_amount": "double"},
            {}, {},
        ),
        "order_items_batch",
    ),
    "upsert_returns": _with(_upsert_returns("storable"), "returns", "storable"),
    "insert_if_absent": _with(
        f"""select customer_id, email, segment, created_at, cast(lifetime_value as double) as lifetime_value, cast(risk_score as double) as risk_score from (
              {_old("customers")}
              union all
              select customer_id, email, segment, created_at, lifetime_value, risk_score from customers_batch
              where seq = 1 and customer_id not in (select customer_id from customers where {HISTORY["customers"]}))""",
        "customers_batch",
    ),
    "score_writeback": _with(
        """select r.return_id,
             cast(case when r.fraud_score is null and s.top is not null then round(s.top, 3) else r.fraud_score end as double) as fraud_score,
             case when r.fraud_score is null and s.top is not null then s.top >= 0.7 else r.fraud_flagged end as fraud_flagged
           from returns r left join (select return_id, max(score) as top from signals group by return_id) s on s.return_id = r.return_id""",
        "returns", "signals",
    ),
    "run_etl": _with(_upsert_returns("storable_latest"), "returns", "storable_latest"),
    "run_etl_rejects": _with(
        """select return_id, customer_id, return_date, return_reason, cast(refund_amount as double) as refund_amount,
             cast(null as varchar) as malformed_row from cleaned
           where (return_id, seq) not in (select (return_id, seq) from storable)
           union all select null, null, null, 'other', 0.0, line from returns_flawed""",
        "cleaned", "storable", "returns_flawed",
    ),
    "run_etl_dimensions": _with(
        """select 'customers' as table_name, count(*) as n_rows, cast(sum(customer_id) as bigint) as keys, cast(sum(lifetime_value) as double) as amount from customers
           union all select 'products', count(*), cast(sum(product_id) as bigint), cast(sum(unit_price) as double) from products
           union all select 'orders', count(*), cast(sum(order_id) as bigint), cast(sum(total_amount) as double) from d_orders
           union all select 'order_items', count(*), cast(sum(order_item_id) as bigint), cast(sum(unit_price) as double) from order_items""",
        "customers", "products", "d_orders", "order_items",
    ),
    "scan_mixed_dates": _with(
        """select order_id, coalesce(try_strptime(written, '%m/%d/%Y'), try_strptime(written, '%b %d, %Y'),
             try_strptime(written, '%Y%m%d'), try_strptime(written, '%Y-%m-%d')) as order_date
           from (select order_id, case order_id % 5 when 0 then strftime(order_date, '%-m/%-d/%Y')
             when 1 then strftime(order_date, '%b %-d, %Y') when 2 then 'soon'
             when 3 then strftime(order_date, '%Y%m%d') else strftime(order_date, '%Y-%m-%d') end as written from d_orders)""",
        "d_orders",
    ),
    "scan_day_first_dates": _with(
        "select order_id, date_trunc('minute', order_date) as order_date from d_orders", "d_orders"
    ),
    "scan_date_orders": _with(
        """select 'order_date' as column_name,
             count(*) filter (where day(order_date) > 12 and order_id % 3 = 0) as n_month_first,
             count(*) filter (where day(order_date) > 12 and order_id % 3 <> 0) as n_day_first,
             count(*) filter (where day(order_date) <= 12) as n_either
           from d_orders where order_date is not null having count(*) > 0""",
        "d_orders",
    ),
    "fraud_signal_log": _with(
        "select return_id, signal_type, severity, round(score, 3) as score, evidence, model_version from signals", "signals"
    ),
    # integrity
    "dq_pk": _with(
        KEYS,
        "customers", "products", "d_orders", "order_items", "returns_raw", "signals",
    ),
    "dq_unique_sku": _with(
        f"""select 'products' as table_name, 'sku' as column_name, sku as value, count(*) as n_rows
            from ({_old("products")} union all select * from products) where sku is not null group by sku having count(*) > 1""",
        "products",
    ),
    "dq_fk": _with(
        REFERENCES,
        "customers", "products", "d_orders", "order_items", "returns", "signals",
    ),
    "dq_not_null": _with(
        REQUIRED,
        "customers", "products", "d_orders", "order_items", "returns_raw", "signals",
    ),
    "dq_domain": _with(
        DOMAINS,
        "customers", "products", "d_orders", "returns_raw", "signals",
    ),
    "dq_all": _with(
        f"""select 'primary_key' as rule, * from ({KEYS})
            union all select 'foreign_key', * from ({RAW_REFERENCES})
            union all select 'not_null', table_name, column_name, null, n_nulls from ({REQUIRED}) where n_nulls > 0
            union all select 'domain', * from ({DOMAINS})""",
        "customers", "products", "d_orders", "order_items", "returns_raw", "signals",
    ),
    # cleaning
    "normalize_reason": _with("select return_id, cast(seq as bigint) as seq, return_reason from cleaned", "cleaned"),
    "normalize_condition": _with("select return_id, cast(seq as bigint) as seq, condition_received from cleaned", "cleaned"),
    "coerce_money": _with("select return_id, cast(seq as bigint) as seq, refund_amount from cleaned", "cleaned"),
    "dedupe_returns": _with(
        """select return_id, return_date, return_reason, refund_amount, cast(seq as bigint) as seq from returns_raw
           qualify row_number() over (partition by return_id order by return_date desc nulls first, seq desc) = 1""",
        "returns_raw",
    ),
    "transform_returns": _with(
        "select * replace (cast(seq as bigint) as seq, cast(cycle_time_hours as bigint) as cycle_time_hours) from cleaned_latest",
        "cleaned_latest",
    ),
    # views, KPIs, reports
    "v_monthly_return_metrics": _with(
        """select date_trunc('month', return_date)::timestamp as month, count(*) as total_returns,
             cast(sum(refund_amount) as double) as total_refunds, round(avg(cycle_time_hours), 6) as avg_cycle_hours,
             round(cast(count(*) filter (where fraud_flagged) as double) / count(*), 6) as fraud_rate,
             cast(sum(recovered_value) as double) as total_recovered, cast(sum(processing_cost) as double) as total_processing_cost
           from returns group by all""",
        "returns",
    ),
    "v_return_reasons_by_category": _with(
        """select category, return_reason, date_trunc('month', return_date)::timestamp as month, count(*) as return_count,
             cast(sum(refund_amount) as double) as refund_amount from categorised group by all""",
        "categorised",
    ),
    "v_disposition_outcomes": _with(
        """select category, disposition, count(*) as disposition_count, cast(sum(recovered_value) as double) as recovered_value,
             cast(sum(processing_cost) as double) as processing_cost,
             cast(sum(recovered_value) - sum(processing_cost) as double) as net_value
           from categorised where disposition is not null group by all""",
        "categorised",
    ),
    "v_customer_return_summary": _with(
        """select c.customer_id, c.segment, count(r.return_id) as lifetime_returns, cast(sum(r.refund_amount) as double) as lifetime_refunds,
             count(*) filter (where r.fraud_flagged) as flagged_returns, max(r.return_date) as last_return_date
           from customers c left join returns r on r.customer_id = c.customer_id group by c.customer_id, c.segment""",
        "customers", "returns",
    ),
    "v_high_risk_returns": _with(
        """select return_id, return_date, r.customer_id, segment, cast(refund_amount as double) as refund_amount, return_reason,
             return_channel, cast(fraud_score as double) as fraud_score, fraud_flagged
           from returns r join customers c on c.customer_id = r.customer_id where fraud_flagged or fraud_score >= 0.7""",
        "customers", "returns",
    ),
    "order_totals": _with(
        "select order_id, cast(sum(quantity * unit_price) as double) as total_amount from order_items group by order_id", "order_items"
    ),
    "kpi_return_rate": _with(
        """select month, coalesce(n_returns, 0) as returns, coalesce(n_items, 0) as items, round(cast(coalesce(n_returns, 0) as double) / nullif(n_items, 0), 6) as return_rate
           from (select date_trunc('month', return_date)::timestamp as month, count(*) as n_returns from returns group by 1)
           full join (select date_trunc('month', o.order_date)::timestamp as month, count(*) as n_items
                      from order_items i join d_orders o on o.order_id = i.order_id group by 1) using (month)""",
        "returns", "order_items", "d_orders",
    ),
    "kpi_return_rate_rolling": _with(
        """select s.day, cast(s.window_days as bigint) as window_days,
             cast(coalesce(sum(d.returns), 0) as bigint) as returns, cast(coalesce(sum(d.items), 0) as bigint) as items,
             round(cast(coalesce(sum(d.returns), 0) as double) / nullif(coalesce(sum(d.items), 0), 0), 6) as return_rate
           from (select cast(unnest(generate_series(low, high, interval 1 day)) as date) as day, window_days
                 from (select min(day)::timestamp as low, max(day)::timestamp as high from daily), (values (30), (90)) v(window_days)) s
           left join daily d on d.day <= s.day and d.day > s.day - cast(s.window_days as integer) group by all""",
        "daily",
    ),
    "kpi_return_rate_between": _with(
        """select first_day, returns, items, round(cast(returns as double) / nullif(items, 0), 6) as return_rate
           from (select first_day,
                   (select count(*) from returns where return_date >= low and return_date < high) as returns,
                   (select count(*) from order_items i join d_orders o on o.order_id = i.order_id where order_date >= low and order_date < high) as items
                 from (values ('1996-04-01', timestamp '1996-04-01 00:00:00', timestamp '1996-07-01 00:00:00'),
                              ('2030-01-01', timestamp '2030-01-01 00:00:00', timestamp '2030-02-01 00:00:00')) v(first_day, low, high))""",
        "returns", "order_items", "d_orders",
    ),
    "kpi_headline": _with(
        """select round(cast(count(*) filter (where fraud_flagged) as double) / count(*), 6) as fraud_rate,
             round(cast(sum(recovered_value) as double) / cast(sum(refund_amount) as double), 6) as recovery_rate,
             cast(sum(refund_amount + processing_cost - recovered_value) as double) as net_return_cost,
             round(avg(cycle_time_hours) filter (where disposition is not null), 6) as cycle_time_hours from returns""",
        "returns",
    ),
    "q_disposition_optimization": _with(
        """select category, disposition, count(*) as units, cast(sum(recovered_value) as double) as recovered_revenue,
             cast(sum(processing_cost) as double) as processing_cost,
             cast(sum(recovered_value) - sum(processing_cost) as double) as net_value, round(avg(cycle_time_hours), 6) as avg_cycle_hours
           from categorised where disposition is not null and return_date >= timestamp '2001-01-01 00:00:00' group by all""",
        "categorised",
    ),
    "q_return_reasons_breakdown": _with(
        """select date_trunc('month', return_date)::timestamp as month, category, return_reason, count(*) as return_count,
             cast(sum(refund_amount) as double) as refund_dollars, round(avg(cycle_time_hours), 6) as avg_cycle_hours
           from categorised where return_date >= timestamp '2000-07-01 00:00:00' group by all""",
        "categorised",
    ),
    "q_fraud_investigation": _with(
        """select r.return_id, return_date, cast(refund_amount as double) as refund_amount, return_reason, return_channel, condition_received,
             cast(fraud_score as double) as fraud_score, signal_type, severity, round(s.score, 3) as signal_score, evidence
           from returns r left join signals s on s.return_id = r.return_id
           where r.return_id = (select return_id from signals group by return_id order by count(*) desc, return_id desc limit 1)""",
        "returns", "signals",
    ),
    "q_disposition_optimization_order": _with(
        """select category, disposition, cast(net_value as double) as net_value,
             row_number() over (order by category nulls last, net_value desc nulls first, disposition) as position
           from (select category, disposition, sum(recovered_value) - sum(processing_cost) as net_value from categorised
                 where disposition is not null and return_date >= timestamp '2001-01-01 00:00:00' group by all)""",
        "categorised",
    ),
    "q_return_reasons_order": _with(
        """select *, row_number() over (order by month desc nulls first, return_count desc nulls first, category, return_reason) as position
           from (select date_trunc('month', return_date)::timestamp as month, category, return_reason, count(*) as return_count
                 from categorised where return_date >= timestamp '2000-07-01 00:00:00' group by all)""",
        "categorised",
    ),
    "q_fraud_investigation_order": _with(
        """select r.return_id, signal_type, row_number() over (order by r.return_id, signal_type nulls last) as position
           from returns r left join signals s on s.return_id = r.return_id
           where customer_id = (select customer_id from returns order by return_id desc limit 1)""",
        "returns", "signals",
    ),
    "returns_by_refund": _with(
        """select return_id, cast(refund_amount as double) as refund_amount,
             row_number() over (order by refund_amount desc nulls last, return_id) as position from returns""",
        "returns",
    ),
    "sql_by_name": _with(
        """select c.segment, count(*) as n_returns, cast(sum(s.refunds) as double) as refunds
           from returns r join customers c on c.customer_id = r.customer_id
           join (select customer_id, sum(refund_amount) as refunds from returns group by customer_id) s on s.customer_id = r.customer_id
           where (r.fraud_flagged or r.fraud_score >= 0.7) and r.refund_amount >= 100 group by c.segment""",
        "returns", "customers",
    ),
    # signals
    "trailing_return_count": _with("select return_id, n as trailing_returns from prior_returns", "prior_returns"),
    "signal_input": _with(
        "select return_id, cast(unit_price as double) as unit_price, round(days_since_purchase, 6) as days_since_purchase from enriched",
        "enriched",
    ),
    "signal_serial_returner": _with("select * from serial_returner", "serial_returner"),
    "signal_wardrobing": _with("select * from wardrobing", "wardrobing"),
    "signal_time_anomaly": _with("select * from time_anomaly", "time_anomaly"),
    "signal_value_mismatch": _with("select * from value_mismatch", "value_mismatch"),
    "all_signals": _with("select * from signals", "signals"),
    "trailing_return_count_events": _with("select return_id, n as trailing_returns from event_counts", "event_counts"),
    "all_signals_events": _with(
        """select return_id, 'serial_returner' as signal_type, case when n > 10 then 'high' else 'medium' end as severity,
             round(least(1.0, cast(n as double) / 15), 6) as score,
             concat('{"returns_in_window":', n, ',"window_days":90}') as evidence, 'rules_v1' as model_version
           from event_counts where n > 5
           union all
           select event_id, 'time_anomaly', 'low', 0.35,
             concat('{"return_date":"', rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), '"}'), 'rules_v1'
           from events where hour(ts) in (23, 0, 1, 2, 3)""",
        "event_counts",
    ),
    "all_signals_since": _with(
        """select s.return_id, s.signal_type, s.severity, round(s.score, 3) as score, s.evidence, s.model_version from signals s join returns r on r.return_id = s.return_id
           where r.return_date >= timestamp '1998-02-01 00:00:00'""",
        "signals", "returns",
    ),
    # model
    "training_frame": _with(
        """select return_id, fraud_flagged as label, cast(refund_amount as double) as refund_amount, cast(restocking_fee as double) as restocking_fee,
             cast(cycle_time_hours as bigint) as cycle_time_hours, return_reason, return_channel, condition_received,
             round(days_since_purchase, 6) as days_since_purchase, customer_lifetime_returns
           from features where fraud_flagged is not null""",
        "features",
    ),
    "scoring_frame": _with(
        """select return_id, cast(refund_amount as double) as refund_amount, cast(restocking_fee as double) as restocking_fee,
             cast(cycle_time_hours as bigint) as cycle_time_hours, return_reason, return_channel, condition_received,
             round(days_since_purchase, 6) as days_since_purchase, customer_lifetime_returns
           from features where fraud_score is null""",
        "features",
    ),
    "standardize_numeric": _with(
        "select return_id, "
        + ", ".join(
            f"round((cast({c} as double) - avg(cast({c} as double)) over ()) / stddev_pop(cast({c} as double)) over (), 6) as {c}_z"
            for c in (
                "refund_amount", "restocking_fee", "cycle_time_hours", "customer_lifetime_returns", "days_since_purchase",
            )
        )
        + " from labelled",
        "labelled",
    ),
    "one_hot_categories": _with(
        "select return_id, "
        + ", ".join(
            f"""concat(repeat('0', {c}_at - 1), '1', repeat('0', max({c}_at) over () - {c}_at)) as {c}_hot"""
            for c in ("return_reason", "return_channel", "condition_received")
        )
        + " from (select return_id, "
        + ", ".join(
            f"dense_rank() over (order by coalesce({c}, '__null__')) as {c}_at"
            for c in ("return_reason", "return_channel", "condition_received")
        )
        + " from labelled)",
        "labelled",
    ),
    "class_weights": _with(
        """select fraud_flagged as label, count(*) as n_rows,
             round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight from labelled group by fraud_flagged""",
        "labelled",
    ),
    "logistic_regression": _with(
        "select coefficient, cast(0 as double) as slope from (values "
        + ", ".join(f"('{c}')" for c in ("refund_amount", "restocking_fee", "cycle_time_hours", "customer_lifetime_returns", "days_since_purchase", "intercept"))
        + ") as t(coefficient) union all "
        + " union all ".join(
            f"select distinct concat('{c}=', coalesce({c}, '__null__')), cast(0 as double) from labelled"
            for c in ("return_reason", "return_channel", "condition_received")
        ),
        "labelled",
    ),
    "score_returns": _with(
        """select r.return_id, cast(r.fraud_score as double) as fraud_score,
             case when r.fraud_score is not null then r.fraud_flagged end as fraud_flagged,
             r.fraud_score is null as newly_scored from returns r""",
        "returns",
    ),
}
