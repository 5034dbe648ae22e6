"""Integrity reports over the tables. They report; they never drop rows.

Each report is one frame over any subset of tables, given as a mapping from table name to
frame. Keys are folded per value before any join, so a key that fills a third of a table
reaches the shuffle as a few rows. `integrity_report` checks all rules at once and reads each
table once; the other reports check one kind of rule.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.schemas import TABLES, Table
from backhaul.session import written

Frames = Mapping[str, DataFrame]

KEY, UNIQUE, REFERENCE, REQUIRED, DOMAIN = "primary_key", "unique", "foreign_key", "not_null", "domain"


def _stack(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no given table has a constraint of this kind")
    return reduce(DataFrame.unionByName, parts)


def _repeated(name: str, df: DataFrame, column: str, null_allowed: bool) -> DataFrame:
    """Values of `column` that break uniqueness, with their row counts."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n_rows"))
    null = F.col("value").isNull()
    broken = ~null & (F.col("n_rows") > 1) if null_allowed else null | (F.col("n_rows") > 1)
    return counts.where(broken).select(
        F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "value", "n_rows"
    )


def primary_key_violations(frames: Frames) -> DataFrame:
    """Key values that are null or repeated: `table_name, column_name, value, n_rows`."""
    return _stack([_repeated(n, df, TABLES[n].key, null_allowed=False) for n, df in frames.items()])


def unique_violations(frames: Frames) -> DataFrame:
    """Repeated non-null values of columns declared unique; columns as for keys."""
    return _stack(
        [
            _repeated(n, df, column, null_allowed=True)
            for n, df in frames.items()
            for column in TABLES[n].unique
        ]
    )


def foreign_key_violations(frames: Frames) -> DataFrame:
    """Non-null references to keys the parent lacks; columns as for keys.

    Checks every reference whose child and parent are both given.
    """
    parts = []
    for name, df in frames.items():
        for column, parent in TABLES[name].references.items():
            if parent not in frames:
                continue
            used = (
                df.where(F.col(column).isNotNull())
                .groupBy(F.col(column).alias("key"))
                .agg(F.count("*").alias("n_rows"))
            )
            known = frames[parent].select(F.col(TABLES[parent].key).alias("key")).distinct()
            parts.append(
                used.join(known, "key", "left_anti").select(
                    F.lit(name).alias("table_name"),
                    F.lit(column).alias("column_name"),
                    F.col("key").cast("string").alias("value"),
                    "n_rows",
                )
            )
    return _stack(parts)


def not_null_violations(frames: Frames) -> DataFrame:
    """Null count of every required column, zeros included: `table_name, column_name, n_nulls`."""
    parts = []
    for name, df in frames.items():
        columns = [c for c in TABLES[name].required if c in df.columns]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_nulls")) for c in columns])
        parts.append(counts.select(F.lit(name).alias("table_name"), F.inline(rows)))
    return _stack(parts)


def domain_violations(frames: Frames) -> DataFrame:
    """Non-null values outside a column's domain: `table_name, column_name, value, n_rows`."""
    parts = []
    for name, df in frames.items():
        domains = {c: d for c, d in TABLES[name].domains.items() if c in df.columns}
        if not domains:
            continue
        outside = [
            F.when(
                ~F.col(c).isin(*domain),
                F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")),
            )
            for c, domain in domains.items()
        ]
        parts.append(
            df.select(F.inline(F.array_compact(F.array(*outside))))
            .groupBy(F.lit(name).alias("table_name"), "column_name", "value")
            .agg(F.count("*").alias("n_rows"))
        )
    return _stack(parts)


def _marks(table: Table, df: DataFrame, scopes: list[tuple[str, str, str]], children: Mapping[str, list]) -> DataFrame:
    """scope, slot and value of everything in a row that a rule looks at or finds at fault. The scope is
    a rule of a column; references lie in the scope of the key they refer to, in a slot of their own."""

    def mark(scope: tuple[str, str, str], slot: int, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(scopes.index(scope)).alias("scope"), F.lit(slot).alias("slot"), value.alias("value")))

    def text(column: str) -> Column:
        return F.col(column).cast("string")

    name, known = table.name, [c for c in table.columns if c in df.columns]
    marks = [mark((KEY, name, table.key), 0, F.lit(True), text(table.key))] if table.key in known else []
    marks += [mark((UNIQUE, name, c), 0, F.col(c).isNotNull(), text(c)) for c in table.unique if c in known]
    for parent, columns in children.items():
        own = [(slot, c) for slot, (child, c) in enumerate(columns, 1) if child == name and c in known]
        marks += [mark((KEY, parent, TABLES[parent].key), slot, F.col(c).isNotNull(), text(c)) for slot, c in own]
    marks += [mark((REQUIRED, name, c), 0, F.col(c).isNull(), F.lit(None).cast("string")) for c in table.required if c in known]
    marks += [mark((DOMAIN, name, c), 0, ~F.col(c).isin(*d), text(c)) for c, d in table.domains.items() if c in known]
    return df.select(F.inline(F.array_compact(F.array(*marks))))


def integrity_report(frames: Frames) -> DataFrame:
    """Every violation of every rule of the given tables: `rule, table_name, column_name, value,
    n_rows`; rows without findings are not listed.

    Each table is read once: its rows give what all rules look at, counted per rule and value before
    and after one shuffle; what breaks a rule is written down. References are counted beside the keys they
    refer to, so that none is joined with its parent; references to tables that are not given are not
    checked.
    """
    if not frames:
        raise ValueError("no table given")
    children: dict[str, list[tuple[str, str]]] = {n: [] for n in frames}
    scopes: list[tuple[str, str, str]] = []
    for n in frames:
        t = TABLES[n]
        scopes += [(KEY, n, t.key), *[(UNIQUE, n, c) for c in t.unique]]
        scopes += [*[(REQUIRED, n, c) for c in t.required], *[(DOMAIN, n, c) for c in t.domains]]
        for column, parent in t.references.items():
            if parent in frames:
                children[parent].append((n, column))
    slots = range(max(map(len, children.values())) + 1)
    marks = _stack([_marks(TABLES[n], df, scopes, children) for n, df in frames.items()])
    seen = marks.groupBy("scope", "value").agg(*[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in slots])

    def at(part: int) -> Column:
        return F.get(F.array(*[F.lit(s[part]) for s in scopes]), F.col("scope"))

    def finding(when: Column, rule: Column, table: Column, column: Column, n: Column) -> Column:
        named = {"rule": rule, "table_name": table, "column_name": column, "value": F.col("value"), "n_rows": n}
        return F.when(when, F.struct(*[c.alias(k) for k, c in named.items()]))

    null, several = F.col("value").isNull(), F.col("n0") > 1
    broken = at(0).isin(REQUIRED, DOMAIN) | ((at(0) == KEY) & (null | several)) | ((at(0) == UNIQUE) & several)
    found = [finding(broken & (F.col("n0") > 0), at(0), at(1), at(2), F.col("n0"))]
    for parent, columns in children.items():
        here = F.col("scope") == scopes.index((KEY, parent, TABLES[parent].key))
        for slot, (child, column) in enumerate(columns, 1):
            n = F.col(f"n{slot}")
            lost = here & (F.col("n0") == 0) & (n > 0)
            found.append(finding(lost, F.lit(REFERENCE), F.lit(child), F.lit(column), n))
    return written(seen.select(F.inline(F.array_compact(F.array(*found)))), "integrity")
