"""Shape guards and the split of the wide sheet into entity frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from partgraph.model import ENTITY_COLUMNS, ORDER


def upper_headers(df: DataFrame) -> DataFrame:
    """Trimmed upper-case column names (sheets spell e.g. ``PART_per_BOX``)."""
    return df.toDF(*[c if c == ORDER else c.strip().upper() for c in df.columns])


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "sheet") -> None:
    """Raise if columns are missing. Looks at the schema only; runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}; available columns {df.columns}")


def empty_entity(spark: SparkSession, entity: str) -> DataFrame:
    """The frame an entity has when there is no input: its columns, all text, no rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ENTITY_COLUMNS[entity]])
    return spark.createDataFrame([], schema)


def project_entity(sheet: DataFrame, entity: str, keep: Iterable[str] = ()) -> DataFrame:
    """One entity's columns of the sheet, one row per sheet row."""
    columns = ENTITY_COLUMNS[entity]
    require_columns(sheet, columns, entity)
    return sheet.select(*columns, *keep)


def split_sheet(sheet: DataFrame) -> dict[str, DataFrame]:
    """The sheet and its seven entity projections: eight plans over one input."""
    return {"main": sheet, **{entity: project_entity(sheet, entity) for entity in ENTITY_COLUMNS}}


#: Frames that may not be empty in a complete set.
CRITICAL = ("main", "part")


def is_complete(frames: dict[str, DataFrame]) -> bool:
    """All eight frames are there, and the sheet and the parts have rows."""
    if any(name not in frames for name in ("main", *ENTITY_COLUMNS)):
        return False
    return not any(frames[name].isEmpty() for name in CRITICAL)
