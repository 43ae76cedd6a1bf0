"""Integrity rules and audits as set-based queries. Each rule yields the rows that break it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.functions.derive import KEY_WIDTH
from partgraph.model import KEYS, TABLES, enum_of, length_of


@dataclass(frozen=True)
class Rule:
    """``broken`` is true on rows that violate the rule; null and false both pass."""

    name: str
    column: str
    broken: Column


def allowed(column: str, values: Sequence[str]) -> Rule:
    return Rule("enum", column, ~F.col(column).isin(*values))


def non_negative(column: str) -> Rule:
    return Rule("non_negative", column, F.col(column) < 0)


def not_null(column: str) -> Rule:
    return Rule("not_null", column, F.col(column).isNull())


def max_length(column: str, limit: int) -> Rule:
    return Rule("length", column, F.char_length(F.col(column)) > limit)


def smallint(column: str) -> Rule:
    return Rule("smallint", column, ~F.col(column).between(-32768, 32767))


def int_range(column: str) -> Rule:
    return Rule("int", column, ~F.col(column).between(-(2**31), 2**31 - 1))


def decimal_range(column: str, kind: str = "decimal(5,2)") -> Rule:
    return Rule("decimal", column, F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull())


def unreadable(column: str, cell: Column) -> Rule:
    """A filled raw cell whose typed value is empty."""
    return Rule("unreadable", column, cell.isNotNull() & F.col(column).isNull())


def table_rules(table: str, width: int = KEY_WIDTH) -> list[Rule]:
    """All row rules a table's declaration implies. Key columns get the length of the key width in use."""
    declared = TABLES[table]
    rules = [not_null(c) for c in (*declared.key, *declared.not_null)]
    rules += [non_negative(c) for c in declared.non_negative]
    for column, kind in declared.columns.items():
        if (values := enum_of(kind)) is not None:
            rules.append(allowed(column, values))
        if (limit := length_of(kind)) is not None:
            rules.append(max_length(column, len(KEYS[column][0]) + width if column in KEYS else limit))
        if kind == "smallint":
            rules.append(smallint(column))
        if kind == "int":
            rules.append(int_range(column))
        if kind.startswith("decimal"):
            rules.append(decimal_range(column, kind))
    return rules


def broken_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules a row breaks, as an array."""
    return F.array_compact(F.array(*[F.when(r.broken, F.lit(f"{r.name}:{r.column}")) for r in rules]))


def row_key(key: Sequence[str]) -> Column:
    """Key columns as one text; an open part shows as ``null``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key]
    return F.concat_ws("|", *parts)


def violations(df: DataFrame, name: str, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(table_name, rule, column_name, row_key) per broken rule; one scan for all rules."""
    hits = [
        F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column_name"))) for r in rules
    ]
    found = df.select(row_key(key).alias("row_key"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.select(F.lit(name).alias("table_name"), "hit.rule", "hit.column_name", "row_key")


def check_tables(
    tables: Mapping[str, DataFrame], rule: str | None = None, width: int = KEY_WIDTH
) -> DataFrame:
    """Violations of the declared rules over several tables, optionally of one rule only."""
    found = []
    for name, df in tables.items():
        rules = [r for r in table_rules(name, width) if rule in (None, r.name) and r.column in df.columns]
        if rules:
            found.append(violations(df, name, TABLES[name].key, rules))
    return reduce(DataFrame.unionByName, found)


def duplicate_keys(df: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return counted.select(
        F.lit(name).alias("table_name"), F.lit("unique").alias("rule"), row_key(key).alias("row_key"), "rows"
    )


def changed_values(old: DataFrame, new: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Rows whose ``column`` differs between two versions of a table, e.g. a corrected part number."""
    before = old.select(*key, F.col(column).alias("old_value"))
    after = new.select(*key, F.col(column).alias("new_value"))
    return before.join(after, list(key)).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def orphan_values(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Values of ``column`` that ``parent`` lacks: (table_name, column_name, missing_key, rows).

    The child is reduced to its distinct values before the join, so a parent that a third of the
    child rows point to is one row on each side.
    """
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    lost = used.join(parent.select(F.col(key).alias(column)), column, "left_anti")
    return lost.select(
        F.lit(name).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.col(column).cast("string").alias("missing_key"),
        "rows",
    )


def orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Foreign key audit over the tables given."""
    found = [
        orphan_values(child, column, tables[parent], TABLES[parent].key[0], name)
        for name, child in tables.items()
        for column, parent in TABLES[name].references.items()
        if parent in tables
    ]
    return reduce(DataFrame.unionByName, found)


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, null_rows, total_rows) for every column, in one scan."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    totals = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows"), F.col("_rows").alias("total_rows"))
        for c in df.columns
    ]
    return totals.select(F.inline(F.array(*rows)))


def null_key_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with an open key column; a load refuses a table where this is not zero."""
    open_key = reduce(Column.__or__, [F.col(c).isNull() for c in key])
    return df.agg(F.count_if(open_key).alias("null_keys"))


def count_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows) per table; tables without rows count 0."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def load_total(counts: DataFrame) -> DataFrame:
    """Total rows over all tables; a load succeeded if there are any."""
    total = F.coalesce(F.sum("rows"), F.lit(0))
    return counts.agg(total.alias("total_rows"), (total > 0).alias("success"))
