from backhaul.sources.csv import (
    date_orders,
    read_customers,
    read_order_items,
    read_orders,
    read_products,
    read_returns,
)
from backhaul.sources.warehouse import Warehouse, write_csv

__all__ = [
    "Warehouse",
    "date_orders",
    "read_customers",
    "read_order_items",
    "read_orders",
    "read_products",
    "read_returns",
    "write_csv",
]
