"""Edits of loaded tables: new rows, corrections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.model import CLASH, ORDER


def new_rows(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the table does not have yet; both sides hold a key once."""
    return incoming.join(existing.select(*key), list(key), "left_anti")


def new_entities(existing: DataFrame, incoming: DataFrame, key: Sequence[str], parts: Sequence[str], clash: str) -> DataFrame:
    """Incoming rows with new keys, and those whose key the table has for another natural key.

    The latter are marked in column ``clash``, beside what it marks already, so a load can refuse them
    instead of taking two entities for one.
    """
    mark = F.xxhash64(*[F.col(p).cast("string") for p in parts])
    known = existing.select(*key, mark.alias("_STORED"))
    other = F.col("_STORED").isNotNull() & (F.col("_STORED") != mark)
    before = F.col(clash) if clash in incoming.columns else F.lit(False)
    marked = incoming.join(known, list(key), "left").withColumn(clash, F.coalesce(before, F.lit(False)) | other)
    return marked.where(F.col("_STORED").isNull() | other).drop("_STORED")


def merge_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str], parts: Sequence[str] = (), clash: str = CLASH) -> DataFrame:
    """Both sides in one keyed aggregation: the table's row of a key stays, a key it lacks comes from ``incoming``.

    Each side is read once and shuffled once. Both hold a key once; an open key equals no other, so its rows all stay. With
    ``parts``, the natural key, column ``clash`` marks keys that stand for several natural keys.
    """
    both = existing.withColumn("_NEW", F.lit(False)).unionByName(incoming.withColumn("_NEW", F.lit(True)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in key and c != "_NEW"]
    open_key = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    apart = both.withColumn("_OPEN", F.when(open_key, F.monotonically_increasing_id()))
    mark = F.xxhash64(*[F.col(p).cast("string") for p in parts]) if parts else F.lit(0).cast("bigint")
    kept = apart.groupBy(*key, "_OPEN").agg(
        F.min(F.struct("_NEW", *others)).alias("_ROW"), (F.min(mark) != F.max(mark)).alias("_SEVERAL")
    )
    marked = [F.col("_SEVERAL").alias(clash)] if parts else []
    return kept.select(*[F.col(c) if c in key else F.col(f"_ROW.{c}") for c in both.columns if c != "_NEW"], *marked)


def insert_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table with the new rows added; rows already there stay as they are."""
    return merge_new(existing, incoming, key)


def key_clashes(existing: DataFrame, incoming: DataFrame, key: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Keys that both sides hold for different natural keys, with the table's natural key."""
    return merge_new(existing, incoming, key, parts).where(CLASH).select(*key, *parts)


def correct_rows(existing: DataFrame, corrections: DataFrame, key: Sequence[str]) -> DataFrame:
    """Corrected table: a filled correction replaces the value, an open one keeps it.

    The key picks the row and never changes, nor does any surrogate key column: identity is given
    at first insert. Corrections for unknown keys change nothing. Of several corrections of a key the first
    counts, by the order column if there is one, then by their values.
    """
    fields = [
        c for c in corrections.columns if c in existing.columns and c not in key and not c.endswith("_ID")
    ]
    order = [ORDER] if ORDER in corrections.columns else []
    once = corrections.groupBy(*key).agg(F.min(F.struct(*order, *fields)).alias("_first"))
    new = once.select(*key, *[F.col(f"_first.{c}").alias(f"_NEW_{c}") for c in fields])
    values = {c: F.coalesce(F.col(f"_NEW_{c}").try_cast(existing.schema[c].dataType), F.col(c)) for c in fields}
    return existing.join(new, list(key), "left").withColumns(values).select(*existing.columns)
