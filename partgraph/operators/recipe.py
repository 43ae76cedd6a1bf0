"""Column recipes: which conversion each sheet column gets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.functions.casts import to_float2, to_int64, to_string
from partgraph.functions.text import clean_text
from partgraph.model import ENTITY_COLUMNS, INTEGER_COLUMNS, SHEET_COLUMNS

Recipe = Mapping[str, Callable[[Column], Column]]

_DECIMALS = {"PART_WEIGHT_KG"} | {f"{p}_{c}" for p in ("BOX", "PALLET") for c in ("WEIGHT_KG", "VOL_M3", "AREA_M2")}
_TEXTS = ("PART_NAME", "SUPPLIER_NAME")


def sheet_recipe(readings: Column | None = None) -> dict[str, Callable[[Column], Column]]:
    """Recipe of the 37 sheet columns; ``readings`` (a reading table) turns transliteration on."""

    def pick(column: str) -> Callable[[Column], Column]:
        if column in _TEXTS:
            return lambda c: clean_text(c, readings)
        if column in INTEGER_COLUMNS:
            return to_int64
        return to_float2 if column in _DECIMALS else to_string

    return {column: pick(column) for column in SHEET_COLUMNS}


def entity_recipe(entity: str, readings: Column | None = None) -> dict[str, Callable[[Column], Column]]:
    """The part of the sheet recipe that covers one entity."""
    recipe = sheet_recipe(readings)
    return {c: recipe[c] for c in ENTITY_COLUMNS[entity]}


def apply_recipe(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Convert the recipe's columns in one projection; columns the frame lacks are skipped."""
    return df.withColumns({c: convert(F.col(c)) for c, convert in recipe.items() if c in df.columns})


def recipe_stats(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Per recipe column: applied or skipped, values converted, values lost (text in, null out).

    One aggregation over one scan, whatever the number of columns.
    """
    present = {c: f for c, f in recipe.items() if c in df.columns}
    before = [F.col(c).alias(f"{c}_before") for c in present]
    after = [f(F.col(c)).alias(f"{c}_after") for c, f in present.items()]
    counts = []
    for c in present:
        lost = F.col(f"{c}_before").isNotNull() & F.col(f"{c}_after").isNull()
        counts += [F.count(f"{c}_after").alias(f"{c}_ok"), F.count_if(lost).alias(f"{c}_failed")]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit("applied" if c in present else "skipped").alias("status"),
            (F.col(f"{c}_ok") if c in present else F.lit(0).cast("bigint")).alias("ok_rows"),
            (F.col(f"{c}_failed") if c in present else F.lit(0).cast("bigint")).alias("failed_rows"),
        )
        for c in recipe
    ]
    totals = df.select(*before, *after).agg(*(counts or [F.count(F.lit(1)).alias("rows")]))
    return totals.select(F.inline(F.array(*rows)))
