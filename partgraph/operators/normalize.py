"""From the raw sheet to entity and link tables.

Every table is a plan over the columns it needs. Parents need no join: a parent's key is computed
from the same sheet row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.functions.derive import KEY_WIDTH, area_m2, default_to, key_for, packaging_number, volume_m3
from partgraph.model import CELLS, CLASH, ENTITY_COLUMNS, KEYS, ORDER, TABLES
from partgraph.operators.dedup import first_per_key, first_rows, with_first_place
from partgraph.operators.project import require_columns
from partgraph.operators.recipe import apply_recipe, sheet_recipe

#: Entity table -> (entity, parent keys it carries).
_ENTITIES = {
    "supplier_data": ("supplier", ()),
    "part_data": ("part", ("SUPPLIER_ID",)),
    "box_data": ("box", ()),
    "pallet_data": ("pallet", ()),
    "model_data": ("model", ()),
    "workshop_data": ("workshop", ()),
    "line_data": ("line", ("WORKSHOP_ID",)),
}
#: Place and raw values of the row an entity comes from.
RANK = "_RANK"
#: Tables whose columns come in nearly as many combinations as the sheet has rows, while far fewer rows are left of them:
#: looking for distinct rows first would shuffle the whole sheet.
_VARIED = ("part_data", "part_to_model")


def fill_packaging(sheet: DataFrame) -> DataFrame:
    """Packaging numbers, volumes and areas the sheet leaves open, from type and dimensions."""
    for p in ("BOX", "PALLET"):
        kind, number = f"{p}_TYPE", f"{p}_NUMBER"
        sizes = [f"{p}_{c}_MM" for c in ("LENGTH", "WIDTH", "HEIGHT")]
        if any(c not in sheet.columns for c in sizes):
            continue
        length, width, height = (F.col(c) for c in sizes)
        filled = {
            number: packaging_number(F.col(kind), length, width, height) if kind in sheet.columns else None,
            f"{p}_VOL_M3": volume_m3(length, width, height),
            f"{p}_AREA_M2": area_m2(length, width),
        }
        sheet = sheet.withColumns(
            {c: default_to(F.col(c), v) for c, v in filled.items() if v is not None and c in sheet.columns}
        )
    return sheet


def add_keys(sheet: DataFrame, width: int = KEY_WIDTH) -> DataFrame:
    """Surrogate keys of all entities whose natural key columns the sheet has."""
    keys = {k: key_for(k, width) for k, (_, parts) in KEYS.items() if all(p in sheet.columns for p in parts)}
    return sheet.withColumns(keys)


def table_columns(table: str) -> list[str]:
    """Sheet columns and keys that make up a table."""
    if table in _ENTITIES:
        entity, parents = _ENTITIES[table]
        return [*TABLES[table].key, *ENTITY_COLUMNS[entity], *parents]
    return list(TABLES[table].columns)


def _with_defaults(columns: Sequence[str]) -> list[str]:
    """Sheet columns and those their packaging defaults are made from, each once."""
    filled = list(columns)
    for p in ("BOX", "PALLET"):
        if f"{p}_NUMBER" in columns or f"{p}_VOL_M3" in columns:
            filled += [f"{p}_TYPE", f"{p}_LENGTH_MM", f"{p}_WIDTH_MM", f"{p}_HEIGHT_MM"]
    return list(dict.fromkeys(filled))


def sheet_columns_for(table: str) -> list[str]:
    """Raw sheet columns a table draws on, its natural keys and defaults included."""
    return _with_defaults([s for c in table_columns(table) for s in (KEYS[c][1] if c in KEYS else (c,))])


def identifying_columns(table: str) -> list[str]:
    """Raw sheet columns that settle a table's primary key."""
    return _with_defaults([part for k in TABLES[table].key for part in KEYS[k][1]])


def clash_check(parts: Sequence[str]) -> Column:
    """Whether a key's rows disagree on the natural key, by a second, independent hash."""
    mark = F.xxhash64(*parts)
    return (F.min(mark) != F.max(mark)).alias(CLASH)


def _cleaned(rows: DataFrame, readings: Column | None) -> DataFrame:
    return fill_packaging(apply_recipe(rows, sheet_recipe(readings)))


def table_rows(
    sheet: DataFrame, table: str, readings: Column | None = None, width: int = KEY_WIDTH, placed: bool = False
) -> DataFrame:
    """First raw row per raw identity of a table, then cleaned, completed and keyed, with its rank.

    A sheet repeats its parts, boxes and lines many times over. Cleaning and hashing come last, so
    they run once per entity spelling, not once per sheet row. That is also why open keys are
    filtered by their raw parts: a filter on the finished key would be pushed back below the
    aggregations, and the cleaning with it. ``placed``: every row has its place, so the first row of an
    identity can be told without the distinct rows.
    """
    columns, identity = sheet_columns_for(table), identifying_columns(table)
    require_columns(sheet, [*columns, ORDER], table)
    named = sheet
    for key in TABLES[table].key:
        parts = KEYS[key][1]
        if f"{parts[0].split('_')[0]}_LENGTH_MM" not in columns:
            named = named.where(F.coalesce(*parts).isNotNull())
    rest = [c for c in columns if c not in identity]
    if placed and table in _VARIED:
        distinct = first_rows(named, identity, rest)
    else:
        distinct = with_first_place(named, columns)
        if table in _ENTITIES:  # a link's distinct rows are as good as its links
            distinct = first_per_key(distinct, identity, [ORDER, *rest])
    rank = F.struct(ORDER, *columns).alias(RANK)
    clean = _cleaned(distinct.select(*columns, ORDER, rank), readings)
    for p in ("BOX", "PALLET"):
        if f"{p}_ID" in TABLES[table].key:
            clean = clean.where(F.col(f"{p}_NUMBER").isNotNull())
    return add_keys(clean, width)


def build_table(
    sheet: DataFrame,
    table: str,
    check: bool = False,
    readings: Column | None = None,
    width: int = KEY_WIDTH,
    placed: bool = False,
) -> DataFrame:
    """An entity or link table of the raw sheet; of rows with one key the first sheet row wins,
    ties settled by the raw values.

    Rows without a key are no entity, and links with an open end no link. ``check`` adds the clash
    column to entities and to all tables the raw cells of the row that won. ``placed`` tells that no sheet row
    lacks its place.
    """
    key = TABLES[table].key
    rows = table_rows(sheet, table, readings, width, placed)
    payload = [c for c in table_columns(table) if c not in key]
    extra = [clash_check(KEYS[key[0]][1])] if check and table in _ENTITIES else []
    # typed values and parent keys follow from the raw row that won, so only that and the key are shuffled
    won = rows.groupBy(*key).agg(F.min(RANK).alias(RANK), *extra)
    typed = _cleaned(won.select(*key, f"{RANK}.*", *[c for c in won.columns if c not in key]), readings)
    parents = {c: key_for(c, width) for c in payload if c in KEYS}
    cells = [F.col(RANK).alias(CELLS)] if check else []
    return typed.withColumns(parents).select(*key, *payload, *[c for c in won.columns if c not in (*key, RANK)], *cells)
