"""The wide part sheet, derived from order tables (lineitem, orders, part, supplier, nation, region).

Each column is one SQL expression; a sheet row is one line item. Dimension tables are joined on their
primary keys with left joins, so a join none of the asked columns needs can be left out without
changing the result: asking for model columns scans two lineitem columns and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.model import CHANGE_COLUMNS, ENUMS, ORDER, SHEET_COLUMNS
from partgraph.session import spread

#: Places a line item in its source as one number.
PLACE = "l_orderkey * 10 + l_linenumber"

#: Dimension table -> (join condition, table it needs first).
JOINS = {
    "orders": ("l_orderkey = o_orderkey", "lineitem"),
    "part": ("l_partkey = p_partkey", "lineitem"),
    "supplier": ("l_suppkey = s_suppkey", "lineitem"),
    "nation": ("s_nationkey = n_nationkey", "supplier"),
    "region": ("n_regionkey = r_regionkey", "nation"),
}
_OWNER = {"o_": "orders", "p_": "part", "s_": "supplier", "n_": "nation", "r_": "region"}


def _text(expression: str) -> str:
    return f"cast({expression} as string)"


def _pick(index: str, enum: str) -> str:
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(ENUMS[enum]))
    return f"case {index} {cases} end"


_BOX = ("(200 + 20 * p_size)", "(150 + 10 * (p_size % 7))", "(100 + 10 * (l_suppkey % 5))")
_PALLET = ("(1000 + 100 * (s_nationkey % 5))", "800", "(900 + 50 * (s_nationkey % 3))")


def _number(returnable: str, sizes: tuple[str, str, str]) -> str:
    shape = " || '-' || ".join(_text(s) for s in sizes)
    return f"case when l_orderkey % 10 = 0 then null when {returnable} then 'B ' || {shape} else 'A ' || {shape} end"


def _type(returnable: str) -> str:
    return f"case when {returnable} then 'returnable' else 'non-returnable' end"


EXPRESSIONS: dict[str, str] = {
    "PART_NUMBER": "'P-' || cast(l_partkey as string)",
    "PART_NAME": "replace(p_name, ' ', '-') || 'M' || cast(p_size as string) || '/' || p_brand",
    "PART_WEIGHT_KG": "cast(p_size as string) || '.' || lpad(cast(l_partkey % 1000 as string), 3, '0')",
    "PART_PER_VEHICLE": "case when l_orderkey % 50 = 0 then 'n/a' else cast(cast(l_quantity as bigint) as string) end",
    "CONFIGURATION": "o_orderpriority",
    "MODEL_CODE": _pick("l_orderkey % 6", "model_codes"),
    "MODEL_NAME": _pick("l_orderkey % 6", "model_names"),
    "LINE_CODE": "'L' || cast(l_linenumber as string)",
    "LINE_NAME": "'Line ' || cast(l_linenumber as string)",
    "WORKSHOP_CODE": _pick("(l_linenumber - 1) % 6", "workshop_codes"),
    "WORKSHOP_NAME": _pick("(l_linenumber - 1) % 6", "workshop_names"),
    "PART_PER_BOX": _text("10 + l_partkey % 90"),
    "BOX_NUMBER": _number("l_returnflag = 'R'", _BOX),
    "BOX_TYPE": _type("l_returnflag = 'R'"),
    "BOX_WEIGHT_KG": "cast(p_size % 9 as string) || '.5'",
    "BOX_LENGTH_MM": _text(_BOX[0]),
    "BOX_WIDTH_MM": _text(_BOX[1]),
    "BOX_HEIGHT_MM": _text(_BOX[2]),
    "BOX_VOL_M3": "cast(null as string)",
    "BOX_AREA_M2": "cast(null as string)",
    "BOX_STACKING": _text("1 + p_size % 4"),
    "BOX_PER_PALLET": _text("4 + p_size % 8"),
    "PALLET_NUMBER": _number("l_linestatus = 'F'", _PALLET),
    "PALLET_TYPE": _type("l_linestatus = 'F'"),
    "PALLET_WEIGHT_KG": "'20.0'",
    "PALLET_LENGTH_MM": _text(_PALLET[0]),
    "PALLET_WIDTH_MM": _text(_PALLET[1]),
    "PALLET_HEIGHT_MM": _text(_PALLET[2]),
    "PALLET_VOL_M3": "cast(null as string)",
    "PALLET_AREA_M2": "cast(null as string)",
    "PALLET_STACKING": "'2'",
    "SUPPLIER_NAME": "s_name",
    "LOCATION": "n_name",
    "CITY": "'City ' || cast(l_suppkey % 10 as string)",
    "STREET": "'Street ' || cast(l_suppkey % 17 as string)",
    "BUILDING": _text("l_suppkey % 100"),
    "LOCALIZATION": "case when r_name = 'EUROPE' then 'yes' else 'no' end",
}


def needed_tables(columns: Iterable[str]) -> list[str]:
    """Dimension tables the sheet columns draw on, parents first."""
    needed: set[str] = set()
    for column in columns:
        for prefix in re.findall(r"\b([opsnr]_)[a-z]", EXPRESSIONS[column]):
            table = _OWNER[prefix]
            while table != "lineitem":
                needed.add(table)
                table = JOINS[table][1]
    return [t for t in JOINS if t in needed]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_sheet(spark: SparkSession, folder: str, columns: Iterable[str] = SHEET_COLUMNS, ordered: bool = False) -> DataFrame:
    """Raw sheet: the asked columns as text, and the order column.

    ``ordered``: rows in their order over all partitions. The values that the sheet is made from are sorted, not its text, which is five times as wide.
    """
    columns = list(columns)
    rows = spread(read_table(spark, folder, "lineitem"))
    for table in needed_tables(columns):
        rows = rows.join(read_table(spark, folder, table), F.expr(JOINS[table][0]), "left")
    rows = rows.orderBy(F.expr(PLACE)) if ordered else rows
    picked = [F.expr(EXPRESSIONS[c]).alias(c) for c in columns]
    return rows.select(*picked, F.expr(PLACE).alias(ORDER))


def change_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Raw change sheet: per order, its first part is replaced by its last part where they differ.

    First and last go by line number, then part key. Supplier, localization and line before the
    change are left open, to be looked up.
    """
    lines = read_table(spark, folder, "lineitem").where("l_linenumber is not null")
    low = F.min(F.expr("struct(l_linenumber, l_partkey is null, l_partkey)"))  # an open part comes last of its line
    high = F.max(F.struct("l_linenumber", "l_partkey"))
    ends = lines.groupBy("l_orderkey").agg(low["l_partkey"].alias("old"), high["l_partkey"].alias("new")).where("old != new")
    changes = ends.join(read_table(spark, folder, "orders"), F.expr("l_orderkey = o_orderkey"))
    return changes.select(
        F.expr("'BP' || cast(o_orderkey as string)").alias("BREAKPOINT_NUMBER"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("BREAKPOINT_DATE"),
        F.expr("'P-' || cast(new as string)").alias("PART_NUMBER"),
        F.expr("'P-' || cast(old as string)").alias("PART_NUMBER_BEFORE_CHANGE"),
        *[F.lit(None).cast("string").alias(c) for c in CHANGE_COLUMNS[4:]],
        F.col("o_orderkey").alias(ORDER),
    )
