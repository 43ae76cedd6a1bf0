"""The relational model: sheet columns, tables, keys and column rules.

Everything that needs to know a column list, a type, a key or a rule reads it from here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# --------------------------------------------------------------------------------------
# Names, types and allowed values of the part-logistics data model.

ENUMS: dict[str, tuple[str, ...]] = {
    "localization": ("yes", "no"),
    "packaging_type": ("returnable", "non-returnable"),
    "model_codes": ("A01", "A08", "B02", "B04", "B06", "B16"),
    "model_names": ("Jolion", "H3", "F7", "F7x", "Dargo", "H7"),
    "workshop_codes": ("AS", "COMP", "PAINT", "WELD", "STAMP", "EN"),
    "workshop_names": ("Assembly", "Component", "Painting", "Welding", "Stamping", "Engine"),
}

SHEET_COLUMNS: tuple[str, ...] = (
    "PART_NUMBER", "PART_NAME", "PART_WEIGHT_KG", "PART_PER_VEHICLE", "CONFIGURATION",
    "MODEL_CODE", "MODEL_NAME", "LINE_CODE", "LINE_NAME", "WORKSHOP_CODE", "WORKSHOP_NAME",
    "PART_PER_BOX", "BOX_NUMBER", "BOX_TYPE", "BOX_WEIGHT_KG", "BOX_LENGTH_MM", "BOX_WIDTH_MM",
    "BOX_HEIGHT_MM", "BOX_VOL_M3", "BOX_AREA_M2", "BOX_STACKING",
    "BOX_PER_PALLET", "PALLET_NUMBER", "PALLET_TYPE", "PALLET_WEIGHT_KG", "PALLET_LENGTH_MM",
    "PALLET_WIDTH_MM", "PALLET_HEIGHT_MM", "PALLET_VOL_M3", "PALLET_AREA_M2", "PALLET_STACKING",
    "SUPPLIER_NAME", "LOCATION", "CITY", "STREET", "BUILDING", "LOCALIZATION",
)

#: Sheet columns of whole numbers.
INTEGER_COLUMNS: frozenset[str] = frozenset(
    ("PART_PER_VEHICLE", "PART_PER_BOX", "BOX_PER_PALLET")
    + tuple(f"{p}_{c}" for p in ("BOX", "PALLET") for c in ("LENGTH_MM", "WIDTH_MM", "HEIGHT_MM", "STACKING"))
)

CHANGE_COLUMNS: tuple[str, ...] = (
    "BREAKPOINT_NUMBER", "BREAKPOINT_DATE", "PART_NUMBER", "PART_NUMBER_BEFORE_CHANGE",
    "SUPPLIER_NAME_BEFORE_CHANGE", "LOCALIZATION_BEFORE_CHANGE", "LINE_NAME_BEFORE_CHANGE",
)

# Columns each entity takes from the sheet.
ENTITY_COLUMNS: dict[str, tuple[str, ...]] = {
    "supplier": ("SUPPLIER_NAME", "LOCATION", "CITY", "STREET", "BUILDING", "LOCALIZATION"),
    "part": ("PART_NUMBER", "PART_NAME", "PART_WEIGHT_KG"),
    "box": ("BOX_NUMBER", "BOX_TYPE", "BOX_WEIGHT_KG", "BOX_LENGTH_MM", "BOX_WIDTH_MM",
            "BOX_HEIGHT_MM", "BOX_VOL_M3", "BOX_AREA_M2", "BOX_STACKING"),
    "pallet": ("PALLET_NUMBER", "PALLET_TYPE", "PALLET_WEIGHT_KG", "PALLET_LENGTH_MM",
               "PALLET_WIDTH_MM", "PALLET_HEIGHT_MM", "PALLET_VOL_M3", "PALLET_AREA_M2",
               "PALLET_STACKING"),
    "model": ("MODEL_CODE", "MODEL_NAME"),
    "workshop": ("WORKSHOP_CODE", "WORKSHOP_NAME"),
    "line": ("LINE_CODE", "LINE_NAME"),
}
# --------------------------------------------------------------------------------------

#: Bigint column with a row's place in its source; "first row" always means smallest value.
ORDER = "_ORD"
#: The raw cells a loaded row comes from, beside its typed values.
CELLS = "_CELLS"
#: Observed beside each entity: keys that stand for two different natural keys.
CLASH = "_CLASH"

#: Surrogate key column -> (prefix, natural key columns on the sheet).
KEYS: dict[str, tuple[str, tuple[str, ...]]] = {
    "SUPPLIER_ID": ("SUP_", ("SUPPLIER_NAME", "LOCATION", "CITY", "STREET", "BUILDING")),
    "PART_ID": ("PRT_", ("PART_NUMBER",)),
    "BOX_ID": ("BOX_", ("BOX_NUMBER",)),
    "PALLET_ID": ("PLT_", ("PALLET_NUMBER",)),
    "MODEL_ID": ("MDL_", ("MODEL_CODE", "MODEL_NAME")),
    "WORKSHOP_ID": ("WSP_", ("WORKSHOP_CODE",)),
    "LINE_ID": ("LNE_", ("LINE_CODE",)),
    "BREAKPOINT_ID": ("BPT_", ("BREAKPOINT_NUMBER",)),
}


@dataclass(frozen=True)
class Table:
    """One target table: ordered columns with declared types, primary key and references."""

    name: str
    key: tuple[str, ...]
    columns: dict[str, str]
    references: dict[str, str] = field(default_factory=dict)
    not_null: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c, T.DataType.fromDDL(spark_type(kind))) for c, kind in self.columns.items()]
        )


def spark_type(kind: str) -> str:
    """Storage type of a declared type: text kinds are strings, the others keep their name."""
    return "string" if kind.startswith(("varchar", "enum")) else kind


def length_of(kind: str) -> int | None:
    """Maximum length of a ``varchar(n)`` kind, else None."""
    found = re.fullmatch(r"varchar\((\d+)\)", kind)
    return int(found.group(1)) if found else None


def enum_of(kind: str) -> tuple[str, ...] | None:
    """Allowed values of an ``enum:name`` kind, else None."""
    return ENUMS[kind.removeprefix("enum:")] if kind.startswith("enum:") else None


def _packaging(prefix: str) -> Table:
    name = prefix.lower()
    return Table(
        f"{name}_data",
        (f"{prefix}_ID",),
        {
            f"{prefix}_ID": "varchar(12)",
            f"{prefix}_NUMBER": "varchar(50)",
            f"{prefix}_TYPE": "enum:packaging_type",
            f"{prefix}_WEIGHT_KG": "decimal(5,2)",
            f"{prefix}_LENGTH_MM": "smallint",
            f"{prefix}_WIDTH_MM": "smallint",
            f"{prefix}_HEIGHT_MM": "smallint",
            f"{prefix}_VOL_M3": "decimal(5,2)",
            f"{prefix}_AREA_M2": "decimal(5,2)",
            f"{prefix}_STACKING": "smallint",
        },
        non_negative=(f"{prefix}_WEIGHT_KG", f"{prefix}_VOL_M3", f"{prefix}_AREA_M2"),
    )


_ALL = (
    Table(
        "supplier_data",
        ("SUPPLIER_ID",),
        {
            "SUPPLIER_ID": "varchar(12)",
            "SUPPLIER_NAME": "varchar(200)",
            "LOCATION": "varchar(50)",
            "CITY": "varchar(50)",
            "STREET": "varchar(100)",
            "BUILDING": "varchar(10)",
            "LOCALIZATION": "enum:localization",
        },
    ),
    Table(
        "part_data",
        ("PART_ID",),
        {
            "PART_ID": "varchar(12)",
            "PART_NUMBER": "varchar(50)",
            "PART_NAME": "varchar(100)",
            "PART_WEIGHT_KG": "decimal(5,2)",
            "SUPPLIER_ID": "varchar(12)",
        },
        references={"SUPPLIER_ID": "supplier_data"},
        non_negative=("PART_WEIGHT_KG",),
    ),
    _packaging("BOX"),
    _packaging("PALLET"),
    Table(
        "model_data",
        ("MODEL_ID",),
        {"MODEL_ID": "varchar(12)", "MODEL_CODE": "enum:model_codes", "MODEL_NAME": "enum:model_names"},
    ),
    Table(
        "workshop_data",
        ("WORKSHOP_ID",),
        {
            "WORKSHOP_ID": "varchar(12)",
            "WORKSHOP_CODE": "enum:workshop_codes",
            "WORKSHOP_NAME": "enum:workshop_names",
        },
    ),
    Table(
        "line_data",
        ("LINE_ID",),
        {
            "LINE_ID": "varchar(12)",
            "LINE_CODE": "varchar(10)",
            "LINE_NAME": "varchar(50)",
            "WORKSHOP_ID": "varchar(12)",
        },
        references={"WORKSHOP_ID": "workshop_data"},
    ),
    Table(
        "breakpoint_data",
        ("BREAKPOINT_ID",),
        {
            "BREAKPOINT_ID": "varchar(12)",
            "INPUT_DATE": "timestamp",
            "BREAKPOINT_NUMBER": "varchar(10)",
            "BREAKPOINT_DATE": "timestamp",
            "DESCRIPTION": "string",
        },
        not_null=("BREAKPOINT_NUMBER",),
    ),
    Table(
        "part_to_box",
        ("PART_ID", "BOX_ID"),
        {"PART_ID": "varchar(12)", "BOX_ID": "varchar(12)", "PART_PER_BOX": "int"},
        references={"PART_ID": "part_data", "BOX_ID": "box_data"},
    ),
    Table(
        "box_to_pallet",
        ("BOX_ID", "PALLET_ID"),
        {"BOX_ID": "varchar(12)", "PALLET_ID": "varchar(12)", "BOX_PER_PALLET": "smallint"},
        references={"BOX_ID": "box_data", "PALLET_ID": "pallet_data"},
    ),
    Table(
        "part_to_model",
        ("PART_ID", "MODEL_ID"),
        {
            "PART_ID": "varchar(12)",
            "MODEL_ID": "varchar(12)",
            "CONFIGURATION": "varchar(20)",
            "PART_PER_VEHICLE": "smallint",
        },
        references={"PART_ID": "part_data", "MODEL_ID": "model_data"},
    ),
    Table(
        "part_to_line",
        ("PART_ID", "LINE_ID"),
        {"PART_ID": "varchar(12)", "LINE_ID": "varchar(12)"},
        references={"PART_ID": "part_data", "LINE_ID": "line_data"},
    ),
    Table(
        "part_to_breakpoint",
        ("PART_ID", "BREAKPOINT_ID"),
        {
            "PART_ID": "varchar(12)",
            "BREAKPOINT_ID": "varchar(12)",
            "PART_NUMBER_BEFORE_CHANGE": "varchar(50)",
            "SUPPLIER_NAME_BEFORE_CHANGE": "varchar(200)",
            "LOCALIZATION_BEFORE_CHANGE": "enum:localization",
            "LINE_NAME_BEFORE_CHANGE": "varchar(50)",
            "IS_ACTIVE_BEFORE": "boolean",
            "IS_ACTIVE_AFTER": "boolean",
        },
        references={"PART_ID": "part_data", "BREAKPOINT_ID": "breakpoint_data"},
    ),
)

TABLES: dict[str, Table] = {t.name: t for t in _ALL}

#: Load order: parents before the tables that reference them.
ENTITY_TABLES = ("supplier_data", "part_data", "box_data", "pallet_data", "model_data", "workshop_data", "line_data")
LINK_TABLES = ("part_to_box", "box_to_pallet", "part_to_model", "part_to_line")
CHANGE_TABLES = ("breakpoint_data", "part_to_breakpoint")

SHEET_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SHEET_COLUMNS])
CHANGE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CHANGE_COLUMNS])


def dependants(table: str) -> list[str]:
    """Tables that reference ``table``, directly or through other tables."""
    found: list[str] = []
    for other in TABLES.values():
        if other.name != table and table in other.references.values() and other.name not in found:
            found.append(other.name)
            found.extend(t for t in dependants(other.name) if t not in found)
    return found
