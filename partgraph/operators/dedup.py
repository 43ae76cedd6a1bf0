"""Distinct rows and keep-first, without ever bringing one key's rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.model import ORDER


def first_per_key(
    df: DataFrame, key: Sequence[str], payload: Sequence[str], order: str = ORDER, extra: Sequence[Column] = (),
    keep_order: str | None = None,
) -> DataFrame:
    """One row per key: the first by ``order``, ties settled by the payload values in turn, nulls lowest.

    ``extra`` are aggregates over the key's rows, e.g. a check that they agree; ``keep_order`` names a column that
    returns the first row's place. The buffer is a whole
    row, so this sorts its input; give it distinct rows. The key is returned from that buffer, not as
    a grouping column: a later filter or semi join on the key would otherwise be pushed below the
    aggregation, to rows by the million where here there is one per key.
    """
    row = F.struct(F.col(order).alias("_order"), *payload, *key)
    first = df.groupBy(*key).agg(F.min(row).alias("_first"), *extra)
    added = [c for c in first.columns if c not in key and c != "_first"]
    place = [F.col("_first._order").alias(keep_order)] if keep_order else []
    return first.select(*[F.col(f"_first.{c}").alias(c) for c in (*key, *payload)], *added, *place)


def first_rows(df: DataFrame, key: Sequence[str], rest: Sequence[str], order: str = ORDER) -> DataFrame:
    """As ``first_per_key``, place included, with nothing twice in the buffer: the key is the grouping column, for keys that no later
    filter is on."""
    first = df.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return first.select(*key, "_first.*")


def with_first_place(df: DataFrame, columns: Sequence[str], order: str = ORDER) -> DataFrame:
    """Distinct rows of ``columns`` with the smallest place of each.

    The only buffer is one number, so this is a hash aggregation with map-side combine: a value that
    fills a third of the rows leaves each task as one row.
    """
    return df.groupBy(*columns).agg(F.min(order).alias(order))


def keep_first(
    df: DataFrame, key: Sequence[str], payload: Sequence[str], order: str = ORDER, extra: Sequence[Column] = (), placed: bool = False
) -> DataFrame:
    """One row per key, the first by ``order``: distinct rows first, then the first of each key.

    An open place counts only if no equal row has one, so the distinct rows must be known first. Where all rows are
    ``placed`` and few are equal, the second step alone gives the same and shuffles once.
    """
    distinct = df if placed else with_first_place(df, [*key, *payload], order)
    return first_per_key(distinct, key, payload, order, extra)


def all_placed(df: DataFrame, order: str = ORDER) -> bool:
    """Whether every row has a place. Of a written table this reads one column, and of Parquet with place statistics not even that."""
    return order in df.columns and df.where(F.col(order).isNull()).isEmpty()


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def drop_null_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key columns are all filled."""
    return df.dropna("any", subset=list(key))


def drop_bad_keys(df: DataFrame, key: Sequence[str], pattern: str = r"^[A-Z]{3}_[A-Za-z0-9]+$") -> DataFrame:
    """Rows whose keys have the form of a surrogate key; null keys go too."""
    for column in key:
        df = df.where(F.col(column).rlike(pattern))
    return df
