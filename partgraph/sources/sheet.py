"""Sheet sources in splittable formats, and the staged text forms of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from partgraph.model import ORDER, SHEET_SCHEMA
from partgraph.operators.project import upper_headers
from partgraph.session import if_small, stage


#: Fixed values of the bulk text form: null, and escapes with the backslash first.
_NULL = "\\N"
_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))

#: How staged text is written: rows repeat names and values, so it packs to a third or less, at no cost in time. A packed file
#: is read by one task, so none holds more than so many rows.
_PACKED = {"compression": "lz4", "maxRecordsPerFile": 500_000}
#: Types whose text holds nothing to escape.
_BARE = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def read_sheet(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """All-text sheet from CSV, JSON or Parquet, with the order column.

    CSV columns go by their header, and a file with another header is refused; JSON takes the sheet
    schema unless given one. The order is total and comes from the files alone, however Spark packs them into tasks: by
    modification time, path, start of the split, and place in it.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.options(header="true", enforceSchema="false")
        schema = schema or reader.load(path).schema
    if fmt == "json":
        schema = schema or SHEET_SCHEMA
    return with_file_order(from_files((reader.schema(schema) if schema else reader).load(path)))


#: Where a row's split comes from, as Spark's file sources tell it.
_SPLIT = "_SPLIT"
#: Bits of a row's place in its task.
_PLACE_BITS = 33


def from_files(df: DataFrame) -> DataFrame:
    """A frame straight from a file source, in batch or stream, with the split that each row comes from."""
    of = F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    return df.select("*", of.alias(_SPLIT))


def with_file_order(rows: DataFrame) -> DataFrame:
    """The order column of rows from ``from_files``: a struct, compared field by field.

    Rows of a split are read one after the other by one task, so its row counter puts them in order.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    named = upper_headers(rows.drop(_SPLIT)).columns
    return rows.toDF(*named, _SPLIT).select(*named, F.struct(f"{_SPLIT}.*", place.alias("place")).alias(ORDER))


def number_order(staged: DataFrame) -> DataFrame:
    """A written sheet with its file order as one number, which aggregations hold without sorting.

    Splits are numbered in their order: one row each, as many as the tasks that read the source. Any other order column stays.
    """
    kind = staged.schema[ORDER].dataType if ORDER in staged.columns else None
    if not isinstance(kind, T.StructType) or "start" not in kind.fieldNames():
        return staged
    split = [F.col(f"{ORDER}.{c}") for c in ("time", "path", "start")]
    key = F.xxhash64(*split)
    splits = staged.select(*(c.alias(n) for c, n in zip(split, ("time", "path", "start"))), key.alias(_SPLIT)).distinct()
    numbered = splits.select(_SPLIT, F.row_number().over(Window.orderBy("time", "path", "start")).cast("bigint").alias("number"))
    joined = staged.withColumn(_SPLIT, key).join(if_small(stage(numbered, "splits")), _SPLIT)
    order = F.shiftleft("number", _PLACE_BITS) + F.col(f"{ORDER}.place")
    return joined.select(*[c for c in staged.columns if c != ORDER], order.alias(ORDER))


def arrived_in_order(spark: SparkSession, folder: str, glob: str = "*") -> None:
    """Date the files of a folder a second apart, by name, as if they had come one after the other."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(fs.globStatus(path), key=lambda s: s.getPath().getName())
    latest = max((s.getModificationTime() for s in found), default=0) // 1000 * 1000
    for i, status in enumerate(found):
        fs.setTimes(status.getPath(), latest - 1000 * (len(found) - i), -1)


def write_tsv(df: DataFrame, path: str, packed: bool = False) -> None:
    """Delimited bulk export in the text form database bulk loaders read: tab-separated, no header,
    null as ``\\N``; backslash, tab and line ends inside a value are escaped. ``packed``: compressed, for a stage of our own."""

    def field(kept: T.StructField) -> Column:
        value = F.col(kept.name).cast("string")
        if not isinstance(kept.dataType, _BARE):
            for plain, escaped in _ESCAPES:
                value = F.replace(value, F.lit(plain), F.lit(escaped))
        return F.coalesce(value, F.lit(_NULL))

    lines = df.select(F.concat_ws("\t", *[field(f) for f in df.schema.fields]).alias("value"))
    lines.write.options(**_PACKED if packed else {}).text(path, lineSep="\n")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = F.split("value", "\t")

    def column(index: int, field: T.StructField) -> Column:
        value = F.get(fields, F.lit(index))
        text = F.replace(value, F.lit("\\\\"), F.lit("\0"))
        for plain, escaped in _ESCAPES[1:]:
            text = F.replace(text, F.lit(escaped), F.lit(plain))
        text = F.replace(text, F.lit("\0"), F.lit("\\"))
        read = F.when(~F.contains(value, F.lit("\\")), value).when(value != _NULL, text)  # few values hold an escape
        return read.cast(field.dataType).alias(field.name)

    lines = spark.read.text(path, lineSep="\n")
    return lines.select(*[column(i, f) for i, f in enumerate(schema.fields)])


def write_json(df: DataFrame, path: str) -> None:
    """Staged JSON of cleaned data, one object per line."""
    df.write.options(**_PACKED).json(path)


def write_csv(df: DataFrame, path: str, compression: str = _PACKED["compression"]) -> None:
    """Staged CSV with a header, as ``read_sheet`` reads it."""
    df.write.options(**{"header": True, **_PACKED, "compression": compression}).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
