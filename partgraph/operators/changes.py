"""Change history: breakpoints at which a part, its supplier, line or localization changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.functions.derive import KEY_WIDTH, change_label, key_for, surrogate_key
from partgraph.model import CELLS, CHANGE_COLUMNS, CLASH, KEYS, ORDER
from partgraph.operators.dedup import keep_first
from partgraph.operators.ordered import next_value, number_rows
from partgraph.operators.project import require_columns
from partgraph.session import write_staged

#: Short change sheet: date, part before, part after (ids).
PAIR_COLUMNS = ("breakpoint_date", "old_part_id", "new_part_id")
#: The date as the change sheet has it.
RAW_DATE = "_RAW_DATE"


def pair_changes(sheet: DataFrame) -> DataFrame:
    """Distinct, complete (date, old part, new part) rows; no rows if the sheet lacks the columns."""
    if any(c not in sheet.columns for c in PAIR_COLUMNS):
        return sheet.sparkSession.createDataFrame([], "breakpoint_date timestamp, old_part_id string, new_part_id string")
    return sheet.select(*PAIR_COLUMNS).dropna("any").distinct()


def pair_breakpoints(pairs: DataFrame, width: int = KEY_WIDTH) -> DataFrame:
    """Breakpoint per pair: its id and its description."""
    parts = [F.date_format("breakpoint_date", "yyyy-MM-dd HH:mm:ss"), F.col("old_part_id"), F.col("new_part_id")]
    return pairs.withColumns(
        {
            "breakpoint_id": surrogate_key(KEYS["BREAKPOINT_ID"][0], parts, width),
            "description": change_label(F.col("old_part_id"), F.col("new_part_id")),
        }
    )


def number_breakpoints(pairs: DataFrame) -> DataFrame:
    """Breakpoints numbered 1..n by date, old part, new part."""
    return number_rows(pairs, list(PAIR_COLUMNS), "breakpoint_seq")


def _sides(old: Column, new: Column) -> Column:
    """Old and new part of a change with their activity; one row if the part stays the same."""

    def side(part: Column, before: Column, after: Column) -> Column:
        return F.struct(part.alias("part"), before.alias("before"), after.alias("after"))

    yes, no = F.lit(True), F.lit(False)
    both = F.array(side(old, yes, no), side(new, no, yes))
    return F.when(old == new, F.array(side(old, yes, yes))).otherwise(both)


def fan_out(breakpoints: DataFrame) -> DataFrame:
    """(part_id, breakpoint_id, is_active_before_breakpoint, is_active_after_breakpoint)."""
    sides = breakpoints.select(
        "breakpoint_id", F.explode(_sides(F.col("old_part_id"), F.col("new_part_id"))).alias("s")
    )
    return sides.select(
        F.col("s.part").alias("part_id"),
        "breakpoint_id",
        F.col("s.before").alias("is_active_before_breakpoint"),
        F.col("s.after").alias("is_active_after_breakpoint"),
    )


def type_changes(sheet: DataFrame) -> DataFrame:
    """Raw change sheet with its date as a timestamp, and the raw date beside it; columns it lacks are null."""
    require_columns(sheet, ["BREAKPOINT_NUMBER", "PART_NUMBER"], "changes")
    columns = [F.col(c) if c in sheet.columns else F.lit(None).cast("string").alias(c) for c in CHANGE_COLUMNS]
    order = F.col(ORDER) if ORDER in sheet.columns else F.lit(0).cast("bigint").alias(ORDER)
    rows = sheet.select(*columns, order).withColumn(RAW_DATE, F.col("BREAKPOINT_DATE").cast("string"))
    return rows.withColumn("BREAKPOINT_DATE", F.col("BREAKPOINT_DATE").try_cast("timestamp"))


def write_changes(typed: DataFrame, path: str) -> DataFrame:
    """Typed changes written down once and read back the same, dates as microseconds: both change tables and all their look-ups read these."""
    spark = typed.sparkSession
    held = typed.withColumns({c: F.col(c).cast("string") for c, kind in typed.dtypes if kind == "void"})
    held = held.withColumn("BREAKPOINT_DATE", F.unix_micros("BREAKPOINT_DATE"))
    write_staged(held, path)
    return spark.read.schema(held.schema).parquet(path).withColumn("BREAKPOINT_DATE", F.timestamp_micros("BREAKPOINT_DATE"))


def is_pair_sheet(sheet: DataFrame) -> bool:
    return all(c in sheet.columns for c in PAIR_COLUMNS)


def pair_sheet(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The long change sheet of a short one: part keys become the numbers that ``parts`` has for them.

    A short sheet names no breakpoints, so each pair is one, numbered by date, old and new part. A key that
    no part has gives an open number, for the load to refuse. Parts are looked up once per key, so a
    part with a third of the changes is one row of the lookup.
    """
    numbered = number_breakpoints(pair_changes(pairs))
    wanted = numbered.select(F.explode(F.array("old_part_id", "new_part_id")).alias("PART_ID")).distinct()
    known = parts.select("PART_ID", "PART_NUMBER").join(wanted, "PART_ID", "left_semi")
    side = lambda c, name: known.select(F.col("PART_ID").alias(c), F.col("PART_NUMBER").alias(name))
    named = numbered.join(side("old_part_id", "PART_NUMBER_BEFORE_CHANGE"), "old_part_id", "left")
    named = named.join(side("new_part_id", "PART_NUMBER"), "new_part_id", "left")
    return named.select(
        F.col("breakpoint_seq").cast("string").alias("BREAKPOINT_NUMBER"),
        F.date_format("breakpoint_date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("BREAKPOINT_DATE"),
        "PART_NUMBER", "PART_NUMBER_BEFORE_CHANGE", F.col("breakpoint_seq").alias(ORDER),
    )


def before_change(changes: DataFrame, tables: Mapping[str, DataFrame], width: int = KEY_WIDTH) -> DataFrame:
    """Changes with what the old part's supplier, localization and line are now, where not given.

    A part on several lines shows the one with the smallest code. Only parts that occur in the
    changes are looked up; each is one row on the lookup side.
    """
    number = F.coalesce("PART_NUMBER_BEFORE_CHANGE", "PART_NUMBER")  # left blank, the part itself changes
    old = key_for("PART_ID", width, PART_NUMBER="_OLD_NUMBER").alias("OLD_PART_ID")
    keyed = changes.withColumn("_OLD_NUMBER", number).select(*changes.columns, old)
    wanted = keyed.select(F.col("OLD_PART_ID").alias("PART_ID")).dropna().distinct()
    parts = tables["part_data"].join(wanted, "PART_ID", "left_semi").select("PART_ID", "SUPPLIER_ID")
    suppliers = tables["supplier_data"].select("SUPPLIER_ID", "SUPPLIER_NAME", "LOCALIZATION")
    lines = (
        tables["part_to_line"]
        .join(wanted, "PART_ID", "left_semi")
        .join(tables["line_data"].select("LINE_ID", "LINE_CODE", "LINE_NAME"), "LINE_ID")
        .groupBy("PART_ID")
        .agg(F.min(F.struct("LINE_CODE", "LINE_NAME")).alias("line"))
    )
    now = (
        parts.join(suppliers, "SUPPLIER_ID", "left")
        .join(lines, "PART_ID", "left")
        .select(F.col("PART_ID").alias("OLD_PART_ID"), "SUPPLIER_NAME", "LOCALIZATION", F.col("line.LINE_NAME"))
    )
    filled = {
        f"{c}_BEFORE_CHANGE": F.coalesce(F.col(f"{c}_BEFORE_CHANGE"), F.col(c))
        for c in ("SUPPLIER_NAME", "LOCALIZATION", "LINE_NAME")
    }
    return keyed.join(now, "OLD_PART_ID", "left").withColumns(filled).select(*changes.columns, "OLD_PART_ID")


def breakpoint_tables(
    changes: DataFrame, tables: Mapping[str, DataFrame], width: int = KEY_WIDTH, stamp: str | None = None, placed: bool = False
) -> dict[str, DataFrame]:
    """breakpoint_data and part_to_breakpoint of a typed change sheet.

    ``stamp`` is the input date; the time of the query unless given, so that reruns can agree. A
    change without a number keeps an open key, for the load to refuse or report. ``placed``: no change
    lacks its place.
    """
    entered = F.lit(stamp).cast("timestamp") if stamp else F.current_timestamp()
    snapshot = before_change(changes, tables, width).withColumns(
        {"BREAKPOINT_ID": key_for("BREAKPOINT_ID", width), "NEW_PART_ID": key_for("PART_ID", width)}
    )
    label = change_label(F.col("PART_NUMBER_BEFORE_CHANGE"), F.col("PART_NUMBER"))
    numbered = changes.withColumns({"BREAKPOINT_ID": key_for("BREAKPOINT_ID", width), "DESCRIPTION": label})
    if RAW_DATE not in numbered.columns:
        numbered = numbered.withColumn(RAW_DATE, F.col("BREAKPOINT_DATE").cast("string"))
    mark = F.xxhash64("BREAKPOINT_NUMBER")
    breakpoints = keep_first(
        numbered,
        ["BREAKPOINT_ID"],
        ["BREAKPOINT_NUMBER", "BREAKPOINT_DATE", "DESCRIPTION", RAW_DATE],
        extra=[(F.min(mark) != F.max(mark)).alias(CLASH)],
        placed=placed,
    ).withColumn("INPUT_DATE", entered)
    cells = F.struct("BREAKPOINT_NUMBER", F.col(RAW_DATE).alias("BREAKPOINT_DATE"))
    breakpoints = breakpoints.withColumn(CELLS, cells).drop(RAW_DATE)
    given = [c for c in CHANGE_COLUMNS if c.endswith("_BEFORE_CHANGE")]
    old = F.coalesce(F.col("OLD_PART_ID"), F.col("NEW_PART_ID"))
    sides = snapshot.select("BREAKPOINT_ID", *given, ORDER, F.explode(_sides(old, F.col("NEW_PART_ID"))).alias("s"))
    links = sides.select(
        F.col("s.part").alias("PART_ID"),
        "BREAKPOINT_ID",
        *given,
        F.col("s.before").alias("IS_ACTIVE_BEFORE"),
        F.col("s.after").alias("IS_ACTIVE_AFTER"),
        ORDER,
    )
    payload = [*given, "IS_ACTIVE_BEFORE", "IS_ACTIVE_AFTER"]
    return {
        "breakpoint_data": breakpoints,
        "part_to_breakpoint": keep_first(links, ["PART_ID", "BREAKPOINT_ID"], payload, placed=placed),
    }


def part_history(tables: Mapping[str, DataFrame], partitions: int | None = None) -> DataFrame:
    """All changes of every part in date order: (PART_ID, BREAKPOINT_ID, VALID_FROM, VALID_TO).

    A change holds until the part's next one; the last has no end.
    """
    dates = tables["breakpoint_data"].select("BREAKPOINT_ID", F.col("BREAKPOINT_DATE").alias("VALID_FROM"))
    changes = tables["part_to_breakpoint"].select("PART_ID", "BREAKPOINT_ID").join(dates, "BREAKPOINT_ID")
    changes = changes.select("PART_ID", "BREAKPOINT_ID", "VALID_FROM")
    return next_value(changes, "PART_ID", ["VALID_FROM", "BREAKPOINT_ID"], "VALID_FROM", "VALID_TO", partitions)
