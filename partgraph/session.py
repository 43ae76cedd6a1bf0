"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime settings the plans rely on. Partition counts are left to the cluster: AQE coalesces
#: small ones and splits skewed ones, also where the split costs one more shuffle. A sheet row has 37
#: expressions; generated methods past 8000 bytes are never compiled by the JVM, so such stages use
#: generated projections, which are split into small methods.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
#: Most bytes of a scan's split and of a shuffled partition; a session that has less keeps its own. Sheet rows pack to some 20 bytes
#: and unpack to 300: a split of Spark's 128 MB is seven million rows, more than a task can sort or hash in memory.
BOUNDS = {
    "spark.sql.files.maxPartitionBytes": 16 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 32 << 20,
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in BOUNDS.items():
        if as_bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, f"{most}b")
    return spark


def workspace(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    A cluster must name it. Only a local session without one gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="partgraph-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the working folder."""
    return f"{workspace(spark)}/partgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_staged(df: DataFrame, path: str) -> None:
    """Write Parquet that is read back by this job only: packed well, in row groups that a split of ``BOUNDS`` can hold.

    A row group is read by one task, whatever the size of a split.
    """
    df.write.options(**_STAGED).parquet(path)


#: How staged tables are written.
_STAGED = {"compression": "zstd", "parquet.block.size": str(BOUNDS["spark.sql.files.maxPartitionBytes"])}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the working folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    write_staged(df, path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table of one row per file or split, broadcast if a count proves that it is small; else Spark chooses the join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a plain scan, dealt out over the cores if the scan has fewer splits than those.

    One small file is one task, however heavy the work on its rows; a large table is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
