"""The part overview: everything known about the parts a set of filters selects.

A part has many models, lines and boxes, and a box that many parts share has many pallets. Joined
side by side these branches would return every combination. The overview returns them one under
another instead: one row per fact, with a SECTION column that names its branch. So its size is the
sum of the facts, not their product. Filters pick parts before any branch is joined; the chosen parts and their boxes
are written down once, and all sections read those.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.session import stage

#: Filter column -> branch it selects on.
FILTERS = {
    "PART_NUMBER": "part",
    "MODEL_CODE": "model",
    "MODEL_NAME": "model",
    "LINE_CODE": "line",
    "LINE_NAME": "line",
    "SUPPLIER_NAME": "supplier",
    "LOCATION": "supplier",
    "CITY": "supplier",
    "LOCALIZATION": "supplier",
}
#: Branches reached through a link table: branch -> (link table, entity table, key).
_LINKED = {
    "model": ("part_to_model", "model_data", "MODEL_ID"),
    "line": ("part_to_line", "line_data", "LINE_ID"),
}


def select_parts(tables: Mapping[str, DataFrame], **filters: str | None) -> DataFrame:
    """Parts that pass all filters. Filters on one branch must hold for the same linked row."""
    unknown = [f for f in filters if f not in FILTERS]
    if unknown:
        raise ValueError(f"no such filters: {unknown}; available {list(FILTERS)}")
    asked: dict[str, list] = {}
    for column, value in filters.items():
        if value is not None:
            asked.setdefault(FILTERS[column], []).append(F.col(column) == value)

    def chosen(branch: str, table: str) -> DataFrame:
        return tables[table].where(reduce(lambda a, b: a & b, asked[branch]))

    parts = chosen("part", "part_data") if "part" in asked else tables["part_data"]
    if "supplier" in asked:
        parts = parts.join(chosen("supplier", "supplier_data"), "SUPPLIER_ID", "left_semi")
    for branch, (link, table, key) in _LINKED.items():
        if branch in asked:
            linked = tables[link].join(chosen(branch, table), key, "left_semi")
            parts = parts.join(linked, "PART_ID", "left_semi")
    return parts


def part_overview(tables: Mapping[str, DataFrame], **filters: str | None) -> DataFrame:
    """Rows of the sections part, model, line, box, pallet and change for the selected parts.

    Columns of other sections are null. Pallet rows tell how a box is stacked; they go with their
    box number, not with a part. Filter values are compared as stored, i.e. after cleaning.
    """
    filtered = any(v is not None for v in filters.values())
    once = stage if filtered else (lambda df, _: df)
    parts = once(select_parts(tables, **filters), "chosen-parts")
    chosen = parts.select("PART_ID", "PART_NUMBER")

    def branch(section: str, df: DataFrame) -> DataFrame:
        shown = [c for c in df.columns if not c.endswith("_ID")]
        part = F.col("PART_ID") if "PART_ID" in df.columns else F.lit(None).cast("string").alias("PART_ID")
        return df.select(F.lit(section).alias("SECTION"), part, *shown)

    def linked(link: str, entity: DataFrame, key: str) -> DataFrame:
        return tables[link].join(chosen, "PART_ID").join(entity, key)

    workshops = tables["line_data"].join(tables["workshop_data"], "WORKSHOP_ID", "left")
    boxed = once(linked("part_to_box", tables["box_data"], "BOX_ID"), "chosen-boxes")
    numbers = (boxed if filtered else tables["box_data"]).select("BOX_ID", "BOX_NUMBER")
    boxes = numbers.distinct() if filtered else numbers
    stacked = tables["box_to_pallet"].join(boxes, "BOX_ID").join(tables["pallet_data"], "PALLET_ID")
    sections = [
        branch("part", parts.join(tables["supplier_data"], "SUPPLIER_ID", "left")),
        branch("model", linked("part_to_model", tables["model_data"], "MODEL_ID")),
        branch("line", linked("part_to_line", workshops, "LINE_ID")),
        branch("box", boxed),
        branch("pallet", stacked),
        branch("change", linked("part_to_breakpoint", tables["breakpoint_data"], "BREAKPOINT_ID")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sections)
