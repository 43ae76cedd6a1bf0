"""Numbering and look-ahead over a total order, spread over range partitions.

A window without partitions, or one partitioned by a key that holds most rows, would run in one
task. Here the rows are range-partitioned by the full order, so a large key spans many partitions,
and only one summary row per partition is brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partgraph.session import stage

_ROW_BITS = 33


def in_order(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows with their range (``_RANGE``) and place in it (``_PLACE``), written down so that later
    passes and retried tasks see the same ranges."""
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("_PLACE", F.monotonically_increasing_id()), "ordered")
    return placed.withColumns(
        {
            "_RANGE": F.shiftright("_PLACE", _ROW_BITS),
            "_PLACE": F.col("_PLACE").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )


def number_rows(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Dense numbers 1..n in ``order``: place in the range plus the sizes of the ranges before it."""
    placed = in_order(df, order, partitions)
    before = Window.orderBy("_RANGE").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_RANGE").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("_RANGE", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    # one row per range, so the broadcast is bounded by the partition count
    numbered = placed.join(F.broadcast(starts), "_RANGE")
    return numbered.select(*df.columns, (F.col("start") + F.col("_PLACE") + 1).alias(name))


def next_value(
    df: DataFrame, key: str, order: Sequence[str], value: str, name: str, partitions: int | None = None
) -> DataFrame:
    """``value`` of the key's following row in ``order``; null on its last row."""
    placed = in_order(df, [key, *order], partitions)
    within = Window.partitionBy("_RANGE", key).orderBy("_PLACE")
    ahead = placed.withColumn("_AHEAD", F.lead(F.struct(value)).over(within))
    # where a key runs on into the next range, its next row is the first one there
    ends = placed.groupBy("_RANGE").agg(
        F.min(F.struct("_PLACE", key, value)).alias("head"), F.max(F.struct("_PLACE", key)).alias("tail")
    )
    follow = F.lead("head").over(Window.orderBy("_RANGE"))
    runs_on = ends.select("_RANGE", F.col(f"tail.{key}").alias("_TAIL"), follow.alias("_HEAD"))
    joined = ahead.join(F.broadcast(runs_on.where(F.col("_TAIL") == F.col(f"_HEAD.{key}"))), "_RANGE", "left")
    over = F.when(F.col(key) == F.col("_TAIL"), F.col(f"_HEAD.{value}"))
    found = F.when(F.col("_AHEAD").isNotNull(), F.col(f"_AHEAD.{value}")).otherwise(over)
    return joined.select(*df.columns, found.alias(name))
