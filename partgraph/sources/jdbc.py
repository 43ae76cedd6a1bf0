"""External database tables, read and written in parallel by Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from partgraph.session import delete, scratch


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table; with a partition column and its bounds, ``partitions`` queries run side by side.

    Bounds only shape the ranges: rows outside them are read too.
    """
    options = {**(properties or {}), "url": url, "dbtable": table}
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": bounds[0],
            "upperBound": bounds[1],
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def write_table(
    df: DataFrame,
    url: str,
    table: str,
    truncate: bool = True,
    connections: int = 8,
    batch_rows: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> None:
    """Bulk insert in batches. ``truncate`` empties the table and keeps its definition, else rows are added.

    At most ``connections`` tasks write at once. The rows are written to the working folder first: the source lowers the number of
    partitions without a shuffle, which would run the whole plan behind ``df`` in so few tasks.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "jdbc")
    options = {
        **(properties or {}),
        "url": url,
        "dbtable": table,
        "batchsize": str(batch_rows),
        "numPartitions": str(connections),
        "truncate": str(truncate).lower(),
    }
    try:
        df.write.parquet(path)
        staged = spark.read.schema(df.schema).parquet(path)
        staged.write.format("jdbc").options(**options).mode("overwrite" if truncate else "append").save()
    finally:
        delete(spark, path)


def count_rows(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None) -> int:
    """Row count, computed by the database."""
    query = f"SELECT COUNT(*) AS ROW_COUNT FROM {table}"
    options = {**(properties or {}), "url": url, "query": query}
    return int(spark.read.format("jdbc").options(**options).load().first()[0])
