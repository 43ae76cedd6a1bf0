"""Tables, working folder and small column helpers shared by the operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: long texts must not add up to more than a worker's memory.
BATCH_ROWS = 500
#: Rows of a few numbers up to which a table is broadcast; beyond, Spark chooses the join.
BROADCAST_ROWS = 500_000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a single-process session may lack one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


class Scratch:
    """Written tables of one run below the shared folder: lineage is cut and lost executors do no harm."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that a later step has replaced."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(rows: DataFrame, more: Column | None = None) -> DataFrame:
    """A written table of a few numbers a row, broadcast only if a count proves that it is small.

    ``more``: size of a row's array or text; rows and sizes together count against the bound.
    """
    if more is None:
        return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
    total = rows.agg(F.count(F.lit(1)) + F.coalesce(F.sum(more), F.lit(0))).first()[0]
    return F.broadcast(rows) if total <= BROADCAST_ROWS else rows


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` under a name of its own: one place to see where rows go through Python."""
    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, whatever task runs in it."""
    return sys.modules.setdefault("_worker_cache_" + name, types.ModuleType(name)).__dict__.setdefault("values", {})
