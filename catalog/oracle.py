"""DuckDB SQL per query, put together from named building blocks.

Each block is one common table expression; a check names the blocks it starts from and their
inputs are added. Only the sheet column expressions are shared with the Spark side.
"""

from __future__ import annotations

from catalog.queries import CHARACTERS, LETTERS, LOOKUPS, STAMP
from partgraph.model import (
    ENTITY_COLUMNS,
    ENTITY_TABLES,

    KEYS,
    LINK_TABLES,
    SHEET_COLUMNS,
    TABLES,
    enum_of,
    length_of,
)
from partgraph.operators.normalize import sheet_columns_for
from partgraph.sources.trade import EXPRESSIONS, JOINS, PLACE

# -- expressions -------------------------------------------------------------------------


def to_int64(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+') THEN try_cast(trim({x}) AS BIGINT) END"


def round2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def to_float2(x: str) -> str:
    number = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"CASE WHEN regexp_full_match(trim({x}), '{number}') THEN {round2(f'try_cast({x} AS DOUBLE)')} END"


def _replace(x: str, pattern: str, by: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def split_lower_camel(x: str) -> str:
    return _replace(x, "([a-z])([A-Z])", r"\1 \2")


def split_capitals(x: str) -> str:
    return _replace(x, "([A-ZА-ЯЁ][^A-ZА-ЯЁ]*)", r" \1")


def pad_numbers(x: str) -> str:
    return _replace(x, r"([0-9]+(?:\.[0-9]+)?)", r" \1 ")


def strip_specials(x: str) -> str:
    return _replace(x, r"""[-)(\]\[.,;:_/\\|+*&^%$#@!~`"'<>?{}\n\t]""", " ")


def squeeze_ws(x: str) -> str:
    return _replace(x, r"\s+", " ")


def title_case(x: str) -> str:
    """A leading ß becomes SS, as Unicode's full case mapping has it; DuckDB's upper() gives ẞ."""
    words = rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+')"
    return f"array_to_string(list_transform({words}, lambda w: replace(upper(w[1]), 'ẞ', 'SS') || lower(w[2:])), '')"


def clean_text_basic(x: str) -> str:
    return title_case(f"trim({squeeze_ws(x)})")


def clean_text(x: str) -> str:
    return clean_text_basic(strip_specials(pad_numbers(split_capitals(split_lower_camel(x)))))


def chinese(x: str) -> str:
    return f"translate({x}, '{LETTERS}', '{CHARACTERS}')"


def transliterate(x: str) -> str:
    for char, reading in zip(CHARACTERS, ("zhong", "guo", "qi", "che"), strict=True):
        x = f"replace({x}, '{char}', '{reading}')"
    return x


def key(prefix: str, parts: list[str]) -> str:
    text = " || ".join(f"coalesce(length({p})::VARCHAR || ':' || {p}, '-')" for p in parts)
    hashed = f"translate(to_base64(unhex(sha256({text}))), '+/', 'Aa')"
    return f"CASE WHEN coalesce({', '.join(parts)}) IS NOT NULL THEN '{prefix}' || substr({hashed}, 1, 8) END"


def key_for(column: str, **source: str) -> str:
    prefix, parts = KEYS[column]
    return key(prefix, [source.get(p, p) for p in parts])


def packaging_number(kind: str, length: str, width: str, height: str) -> str:
    sizes = " || '-' || ".join(f"{c}::VARCHAR" for c in (length, width, height))
    return f"(CASE WHEN {kind} = 'non-returnable' THEN 'A ' ELSE 'B ' END) || {sizes}"


def meters(*columns: str) -> str:
    return round2(" * ".join(f"({c} / 1000.0::DOUBLE)" for c in columns))


def text_date(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


# -- blocks ------------------------------------------------------------------------------

_INTEGERS = [c for c in SHEET_COLUMNS if "_PER_" in c or c.endswith(("LENGTH_MM", "WIDTH_MM", "HEIGHT_MM", "STACKING"))]
_DECIMALS = [c for c in SHEET_COLUMNS if c.endswith(("_KG", "_M3", "_M2"))]


def cleaned(column: str) -> str:
    if column in ("PART_NAME", "SUPPLIER_NAME"):
        return clean_text(column)
    if column in _INTEGERS:
        return to_int64(column)
    return to_float2(column) if column in _DECIMALS else column


def _filled(column: str) -> str:
    p = column.split("_")[0]
    sizes = [f"{p}_LENGTH_MM", f"{p}_WIDTH_MM", f"{p}_HEIGHT_MM"]
    values = {
        f"{p}_NUMBER": lambda: packaging_number(f"{p}_TYPE", *sizes),
        f"{p}_VOL_M3": lambda: meters(*sizes),
        f"{p}_AREA_M2": lambda: meters(*sizes[:2]),
    }
    return f"coalesce({column}, {values[column]()})" if p in ("BOX", "PALLET") and column in values else column


_joins = " ".join(f"LEFT JOIN {t} ON {on}" for t, (on, _) in JOINS.items())
_sheet = ", ".join(f"{e} AS {c}" for c, e in EXPRESSIONS.items())
_raw = ", ".join(f"{c} AS RAW_{c}" for c in SHEET_COLUMNS)
_sheet_keys = [k for k in KEYS if k != "BREAKPOINT_ID"]
#: Place of a row and every value it could differ in, so that "first" is one row's values.
BLOCKS: dict[str, tuple[str, tuple[str, ...]]] = {
    "sheet": (f"SELECT {_sheet}, {PLACE} AS _ORD FROM lineitem {_joins}", ()),
    "clean": (
        f"SELECT {', '.join(f'{cleaned(c)} AS {c}' for c in SHEET_COLUMNS)}, {_raw}, _ORD FROM sheet",
        ("sheet",),
    ),
    "filled": (
        f"SELECT {', '.join(f'{_filled(c)} AS {c}' for c in SHEET_COLUMNS)}, COLUMNS('RAW_.*'), _ORD FROM clean",
        ("clean",),
    ),
    "keyed": (f"SELECT *, {', '.join(f'{key_for(k)} AS {k}' for k in _sheet_keys)} FROM filled", ("filled",)),
    "change_ends": (
        "SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY l_orderkey",
        (),
    ),
    "change_parts": (
        "SELECT l_orderkey, min(l_partkey) FILTER (l_linenumber = lo) AS old_part,"
        " max(l_partkey) FILTER (l_linenumber = hi) AS new_part"
        " FROM lineitem JOIN change_ends USING (l_orderkey) GROUP BY l_orderkey",
        ("change_ends",),
    ),
    "changes": (
        "SELECT 'BP' || o_orderkey AS BREAKPOINT_NUMBER, o_orderdate AS BREAKPOINT_DATE,"
        " 'P-' || new_part AS PART_NUMBER, 'P-' || old_part AS PART_NUMBER_BEFORE_CHANGE"
        " FROM change_parts JOIN orders ON l_orderkey = o_orderkey WHERE old_part <> new_part",
        ("change_parts",),
    ),
    "pairs": (
        "SELECT DISTINCT BREAKPOINT_DATE AS breakpoint_date,"
        f" {key_for('PART_ID', PART_NUMBER='PART_NUMBER_BEFORE_CHANGE')} AS old_part_id,"
        f" {key_for('PART_ID')} AS new_part_id FROM changes",
        ("changes",),
    ),
}


def _first(source: str, table: str, columns: list[str]) -> str:
    """Keep-first by place, ties by the raw values in column order, nulls lowest."""
    keys = TABLES[table].key
    place = ", ".join(f"{c} NULLS FIRST" for c in ["_ORD", *[f"RAW_{c}" for c in sheet_columns_for(table)]])
    filled = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (
        f"SELECT {', '.join(columns)} FROM {source} WHERE {filled}"
        f" QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {place}) = 1"
    )


_PARENTS = {"part_data": ["SUPPLIER_ID"], "line_data": ["WORKSHOP_ID"]}


def _columns(table: str) -> list[str]:
    if table in LINK_TABLES:
        return list(TABLES[table].columns)
    entity = table.removesuffix("_data")
    return [*TABLES[table].key, *ENTITY_COLUMNS[entity], *_PARENTS.get(table, [])]


for _table in (*ENTITY_TABLES, *LINK_TABLES):
    BLOCKS[_table] = (_first("keyed", _table, _columns(_table)), ("keyed",))

BLOCKS["first_lines"] = (
    "SELECT PART_ID, arg_min(LINE_NAME, LINE_CODE) AS LINE_NAME"
    " FROM part_to_line JOIN line_data USING (LINE_ID) GROUP BY PART_ID",
    ("part_to_line", "line_data"),
)
BLOCKS["snapshot"] = (
    "SELECT c.*, s.SUPPLIER_NAME AS SUPPLIER_NAME_BEFORE_CHANGE, s.LOCALIZATION AS LOCALIZATION_BEFORE_CHANGE,"
    " f.LINE_NAME AS LINE_NAME_BEFORE_CHANGE, c.OLD_ID AS OLD_PART_ID FROM (SELECT *,"
    f" {key_for('PART_ID', PART_NUMBER='PART_NUMBER_BEFORE_CHANGE')} AS OLD_ID FROM changes) c"
    " LEFT JOIN part_data p ON p.PART_ID = c.OLD_ID LEFT JOIN supplier_data s ON s.SUPPLIER_ID = p.SUPPLIER_ID"
    " LEFT JOIN first_lines f ON f.PART_ID = c.OLD_ID",
    ("changes", "part_data", "supplier_data", "first_lines"),
)
BLOCKS["breakpoint_data"] = (
    f"SELECT {key_for('BREAKPOINT_ID')} AS BREAKPOINT_ID, '{STAMP}' AS INPUT_DATE, BREAKPOINT_NUMBER,"
    f" {text_date('BREAKPOINT_DATE')} AS BREAKPOINT_DATE,"
    " 'Change: ' || PART_NUMBER_BEFORE_CHANGE || ' → ' || PART_NUMBER AS DESCRIPTION FROM changes",
    ("changes",),
)
_GIVEN = (
    "PART_NUMBER_BEFORE_CHANGE, SUPPLIER_NAME_BEFORE_CHANGE, LOCALIZATION_BEFORE_CHANGE, LINE_NAME_BEFORE_CHANGE"
)
BLOCKS["breakpoint_links"] = (
    f"SELECT OLD_PART_ID AS PART_ID, {key_for('BREAKPOINT_ID')} AS BREAKPOINT_ID, {_GIVEN},"
    " true AS IS_ACTIVE_BEFORE, false AS IS_ACTIVE_AFTER FROM snapshot UNION ALL"
    f" SELECT {key_for('PART_ID')}, {key_for('BREAKPOINT_ID')}, {_GIVEN}, false, true FROM snapshot",
    ("snapshot",),
)


def sql(select: str, *blocks: str) -> str:
    """``select`` over the named blocks and all blocks they draw on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in BLOCKS[name][1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for block in blocks:
        add(block)
    if not ordered:
        return select
    return "WITH " + ", ".join(f"{b} AS MATERIALIZED ({BLOCKS[b][0]})" for b in ordered) + " " + select


# -- checks ------------------------------------------------------------------------------

ORACLES: dict[str, str] = {}
_sheet_list = ", ".join(SHEET_COLUMNS)
_tables = (*ENTITY_TABLES, *LINK_TABLES, "breakpoint_data", "part_to_breakpoint")
_block = {t: t for t in _tables} | {"part_to_breakpoint": "breakpoint_links"}
_all_blocks = tuple(_block.values())

ORACLES["scan_sheet"] = sql(f"SELECT {_sheet_list} FROM sheet", "sheet")
ORACLES["empty_entity"] = sql(
    " UNION ALL ".join(
        f"SELECT '{e}' AS entity, {len(c)}::BIGINT AS columns, count(*) AS rows FROM sheet WHERE PART_NUMBER IS NULL"
        for e, c in ENTITY_COLUMNS.items()
    ),
    "sheet",
)
_streamed = (*ENTITY_TABLES, *LINK_TABLES)
ORACLES["stream_ingest"] = sql(
    " UNION ALL BY NAME ".join(
        [f"SELECT *, '{t}' AS table_name FROM {t}" for t in _streamed]
        + [f"SELECT *, '{t}' AS table_name FROM {_block[t]} WHERE false" for t in ("breakpoint_data", "part_to_breakpoint")]
    ),
    *_all_blocks,
)
ORACLES["append_table"] = sql("SELECT *, (SELECT count(*) FROM line_data) AS appended FROM line_data", "line_data")
ORACLES["tsv_roundtrip"] = ORACLES["json_stage"] = ORACLES["clean_sheet"] = sql(
    f"SELECT {_sheet_list} FROM clean", "clean"
)
_emptied = ("part_data", "part_to_box", "part_to_model", "part_to_line", "part_to_breakpoint")
ORACLES["truncate_load"] = sql(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {'0::BIGINT' if t in _emptied else 'count(*)'} AS rows"
        + ("" if t in _emptied else f" FROM {_block[t]}")
        for t in _tables
    ),
    *_all_blocks,
)
for _e, _c in ENTITY_COLUMNS.items():
    ORACLES[f"proj_{_e}"] = sql(f"SELECT {', '.join(_c)} FROM sheet", "sheet")
ORACLES["split_row_counts"] = sql(
    " UNION ALL ".join(
        f"SELECT '{e}' AS frame, {len(c)}::BIGINT AS columns, count(*) AS rows FROM sheet"
        for e, c in {"main": SHEET_COLUMNS, **ENTITY_COLUMNS}.items()
    ),
    "sheet",
)
ORACLES["header_upper"] = sql("SELECT PART_PER_VEHICLE, PART_PER_BOX, BOX_PER_PALLET FROM sheet", "sheet")

ORACLES["to_int64"] = sql(
    "SELECT trunc(l_extendedprice)::BIGINT AS value FROM lineitem UNION ALL "
    + " UNION ALL ".join(
        f"SELECT {to_int64(c)} FROM sheet" for c in ("PART_PER_VEHICLE", "BOX_WEIGHT_KG", "PART_NUMBER")
    ),
    "sheet",
)
ORACLES["to_string"] = (
    "SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_returnflag FROM lineitem"
)
ORACLES["to_float2"] = sql(
    f"SELECT {round2('l_extendedprice / 7')} AS value FROM lineitem UNION ALL "
    + " UNION ALL ".join(f"SELECT {to_float2(c)} FROM sheet" for c in ("PART_WEIGHT_KG", "PART_PER_VEHICLE")),
    "sheet",
)
ORACLES["has_chinese"] = (
    f"SELECT doc_id, regexp_matches({chinese('text')}, '[一-鿿㐀-䶿豈-﫿]') AS has_chinese FROM documents"
)
for _name, _expression in {
    "split_lower_camel": split_lower_camel("text"),
    "split_capitals": split_capitals("text"),
    "pad_numbers": pad_numbers("text"),
    "strip_specials": strip_specials("text"),
    "squeeze_ws": squeeze_ws("text"),
    "trim_text": f"trim({strip_specials('text')})",
    "title_case": title_case("text"),
    "clean_text_basic": clean_text_basic("text"),
    "transliterate": transliterate(chinese("text")),
    "clean_text": clean_text(transliterate(chinese("text"))),
}.items():
    ORACLES[_name] = f"SELECT doc_id, {_expression} AS text FROM documents"
ORACLES["apply_recipe"] = sql(
    f"SELECT PART_NUMBER, {to_int64('PART_PER_VEHICLE')} AS PART_PER_VEHICLE,"
    " lower(CONFIGURATION) AS CONFIGURATION FROM sheet",
    "sheet",
)
ORACLES["recipe_stats"] = sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 'applied' AS status, count({cleaned(c)}) AS ok_rows,"
        f" count({c}) - count({cleaned(c)}) AS failed_rows FROM sheet"
        for c in SHEET_COLUMNS
    )
    + " UNION ALL SELECT 'NO_SUCH_COLUMN', 'skipped', 0::BIGINT, 0::BIGINT",
    "sheet",
)

for _p in ("BOX", "PALLET"):
    _sizes = [f"{_p}_LENGTH_MM", f"{_p}_WIDTH_MM", f"{_p}_HEIGHT_MM"]
    _low, _all = _p.lower(), ", ".join(_sizes)
    ORACLES[f"{_low}_number"] = sql(
        f"SELECT {_p}_TYPE, {_all}, {packaging_number(f'{_p}_TYPE', *_sizes)} AS {_p}_NUMBER FROM clean", "clean"
    )
    ORACLES[f"{_low}_volume"] = sql(f"SELECT {_all}, {meters(*_sizes)} AS {_p}_VOL_M3 FROM clean", "clean")
    ORACLES[f"{_low}_area"] = sql(
        f"SELECT {', '.join(_sizes[:2])}, {meters(*_sizes[:2])} AS {_p}_AREA_M2 FROM clean", "clean"
    )
_natural = list(dict.fromkeys(p for k in _sheet_keys for p in KEYS[k][1]))
ORACLES["surrogate_key"] = sql(
    f"SELECT {', '.join(_natural)}, {', '.join(f'{key_for(k)} AS {k}' for k in _sheet_keys)} FROM clean", "clean"
)
_packaging = [
    f"{p}_{c}" for p in ("BOX", "PALLET") for c in ("NUMBER", "TYPE", "LENGTH_MM", "WIDTH_MM", "HEIGHT_MM")
]
ORACLES["default_number"] = sql(f"SELECT {', '.join(_packaging)} FROM filled", "filled")
ORACLES["change_label"] = sql(
    "SELECT BREAKPOINT_NUMBER, 'Change: ' || PART_NUMBER_BEFORE_CHANGE || ' → ' || PART_NUMBER AS label FROM changes",
    "changes",
)

_open = f"SELECT {key_for('PART_ID')} AS PART_ID, {key_for('BOX_ID')} AS BOX_ID FROM clean"
ORACLES["drop_null_keys"] = sql(
    f"SELECT * FROM ({_open}) WHERE PART_ID IS NOT NULL AND BOX_ID IS NOT NULL", "clean"
)
ORACLES["null_pk_count"] = sql(f"SELECT count(*) AS null_keys FROM ({_open}) WHERE BOX_ID IS NULL", "clean")
ORACLES["drop_bad_keys"] = sql(
    "SELECT PART_NUMBER, PART_PER_VEHICLE FROM sheet WHERE regexp_full_match(PART_PER_VEHICLE, '[0-9]+')", "sheet"
)
ORACLES["distinct_rows"] = sql(
    "SELECT DISTINCT PART_NUMBER, MODEL_CODE, LINE_CODE, CONFIGURATION FROM sheet", "sheet"
)
_counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {_block[t]}" for t in _tables)
ORACLES["table_counts"] = sql(_counts, *_all_blocks)
ORACLES["load_total"] = sql(
    f"SELECT sum(rows)::BIGINT AS total_rows, sum(rows) > 0 AS success FROM ({_counts})", *_all_blocks
)
ORACLES["null_profile"] = sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_rows, count(*) AS total_rows FROM sheet"
        for c in SHEET_COLUMNS
    ),
    "sheet",
)

for _name, _table in {
    "dedup_first": "box_data",
    "part_with_supplier": "part_data",
    "line_with_workshop": "line_data",
    "load_entity": "pallet_data",
    **{t: t for t in LINK_TABLES},
}.items():
    ORACLES[_name] = sql(f"SELECT * FROM {_table}", _table)


# Overview: rows of all sections, columns of other sections null.
_SECTIONS = {
    "part": (["PART_NUMBER", "PART_NAME", "PART_WEIGHT_KG", *ENTITY_COLUMNS["supplier"]],
             "parts p LEFT JOIN supplier_data s ON s.SUPPLIER_ID = p.SUPPLIER_ID"),
    "model": (["PART_NUMBER", "CONFIGURATION", "PART_PER_VEHICLE", "MODEL_CODE", "MODEL_NAME"],
              "parts JOIN part_to_model USING (PART_ID) JOIN model_data USING (MODEL_ID)"),
    "line": (["PART_NUMBER", "LINE_CODE", "LINE_NAME", "WORKSHOP_CODE", "WORKSHOP_NAME"],
             "parts JOIN part_to_line USING (PART_ID) JOIN line_data USING (LINE_ID)"
             " LEFT JOIN workshop_data USING (WORKSHOP_ID)"),
    "box": (["PART_NUMBER", "PART_PER_BOX", *ENTITY_COLUMNS["box"]],
            "parts JOIN part_to_box USING (PART_ID) JOIN box_data USING (BOX_ID)"),
    "pallet": (["BOX_NUMBER", "BOX_PER_PALLET", *ENTITY_COLUMNS["pallet"]],
               "box_to_pallet JOIN box_data USING (BOX_ID) JOIN pallet_data USING (PALLET_ID)"
               " WHERE BOX_ID IN (SELECT BOX_ID FROM part_to_box SEMI JOIN parts USING (PART_ID))"),
    "change": (["PART_NUMBER", *_GIVEN.split(", "), "IS_ACTIVE_BEFORE", "IS_ACTIVE_AFTER", "INPUT_DATE",
                "BREAKPOINT_NUMBER", "BREAKPOINT_DATE", "DESCRIPTION"],
               "parts JOIN breakpoint_links USING (PART_ID) JOIN breakpoint_data USING (BREAKPOINT_ID)"),
}
_SELECTED = {
    "PART_NUMBER": "PART_NUMBER = '{v}'",
    **dict.fromkeys(
        ("MODEL_CODE", "MODEL_NAME"),
        "PART_ID IN (SELECT PART_ID FROM part_to_model JOIN model_data USING (MODEL_ID) WHERE {c} = '{v}')",
    ),
    **dict.fromkeys(
        ("LINE_CODE", "LINE_NAME"),
        "PART_ID IN (SELECT PART_ID FROM part_to_line JOIN line_data USING (LINE_ID) WHERE {c} = '{v}')",
    ),
    **dict.fromkeys(
        ("SUPPLIER_NAME", "LOCATION", "CITY", "LOCALIZATION"),
        "SUPPLIER_ID IN (SELECT SUPPLIER_ID FROM supplier_data WHERE {c} = '{v}')",
    ),
}


def overview(condition: str) -> str:
    shown = list(dict.fromkeys(c for columns, _ in _SECTIONS.values() for c in columns))
    part = {"part": "p.PART_ID", "pallet": "NULL"}
    rows = " UNION ALL ".join(
        f"SELECT '{section}' AS SECTION, {part.get(section, 'PART_ID')} AS PART_ID, "
        + ", ".join(f"{c if c in columns else 'NULL'} AS {c}" for c in shown)
        + f" FROM {source}"
        for section, (columns, source) in _SECTIONS.items()
    )
    base = sql("", *_all_blocks).rstrip()
    return f"{base}, parts AS (SELECT * FROM part_data WHERE {condition}) {rows}"


ORACLES["part_overview"] = overview("true")
for _name, (_column, _value) in LOOKUPS.items():
    ORACLES[_name] = overview(_SELECTED[_column].format(c=_column, v=_value))


def _orphans(table: str, column: str, parent: str, parent_key: str, name: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, {column}::VARCHAR AS missing_key,"
        f" count(*) AS rows FROM {table} c WHERE {column} IS NOT NULL"
        f" AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{column}) GROUP BY {column}"
    )


ORACLES["fk_orphans"] = sql(
    " UNION ALL ".join(
        [
            _orphans(_block[t], c, _block[parent], TABLES[parent].key[0], t)
            for t in _tables
            for c, parent in TABLES[t].references.items()
        ]
        + [_orphans("documents", "doc_id", "labels", "doc_id", "documents")]
    ),
    *_all_blocks,
)

ORACLES["breakpoints"] = sql(
    f"SELECT {text_date('breakpoint_date')} AS breakpoint_date, old_part_id, new_part_id FROM pairs", "pairs"
)
ORACLES["breakpoint_seq"] = sql(
    f"SELECT {text_date('breakpoint_date')} AS breakpoint_date, old_part_id, new_part_id,"
    " row_number() OVER (ORDER BY pairs.breakpoint_date, old_part_id, new_part_id) AS breakpoint_seq FROM pairs",
    "pairs",
)
_pair_key = key("BPT_", [text_date("breakpoint_date"), "old_part_id", "new_part_id"])
ORACLES["part_to_breakpoint"] = sql(
    f"SELECT old_part_id AS part_id, {_pair_key} AS breakpoint_id, true AS is_active_before_breakpoint,"
    f" false AS is_active_after_breakpoint FROM pairs UNION ALL SELECT new_part_id, {_pair_key}, false, true FROM pairs",
    "pairs",
)
ORACLES["before_change"] = sql(
    f"SELECT BREAKPOINT_NUMBER, {text_date('BREAKPOINT_DATE')} AS BREAKPOINT_DATE, PART_NUMBER, {_GIVEN},"
    " OLD_PART_ID FROM snapshot",
    "snapshot",
)
ORACLES["part_history"] = sql(
    "SELECT PART_ID, BREAKPOINT_ID, BREAKPOINT_DATE AS VALID_FROM, lead(BREAKPOINT_DATE) OVER"
    " (PARTITION BY PART_ID ORDER BY BREAKPOINT_DATE, BREAKPOINT_ID) AS VALID_TO"
    " FROM breakpoint_links JOIN breakpoint_data USING (BREAKPOINT_ID)",
    "breakpoint_links", "breakpoint_data",
)
ORACLES["load_changes"] = sql(
    "SELECT * FROM breakpoint_links JOIN breakpoint_data USING (BREAKPOINT_ID)", "breakpoint_links", "breakpoint_data"
)
ORACLES["load_breakpoints"] = sql(
    "SELECT 'breakpoint_data' AS table_name, count(*) AS rows FROM breakpoint_data UNION ALL"
    " SELECT 'part_to_breakpoint', count(*) FROM breakpoint_links",
    "breakpoint_data", "breakpoint_links",
)


#: The sheet has a text in place of a number in this column only, and no other cell of a typed one is open.
_lost = dict.fromkeys(_tables, "''") | {
    "part_to_model": "CASE WHEN count(*) > count(PART_PER_VEHICLE) THEN 'PART_PER_VEHICLE=' || (count(*) - count(PART_PER_VEHICLE)) ELSE '' END"
}


def _report(names: tuple[str, ...], stage: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{stage}' AS stage, count(*) AS rows, count(*) AS stored, 'loaded' AS status, {_lost[t]} AS lost_cells FROM {_block[t]}"
        for t in names
    )


_changed = ("breakpoint_data", "part_to_breakpoint")
ORACLES["load_entities"] = sql(_report(ENTITY_TABLES, "entity"), *ENTITY_TABLES)
ORACLES["load_links"] = sql(_report(LINK_TABLES, "link"), *LINK_TABLES)
ORACLES["load_report"] = sql(
    " UNION ALL ".join([_report(ENTITY_TABLES, "entity"), _report(LINK_TABLES, "link"), _report(_changed, "change")]),
    *_all_blocks,
)
_counted = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, NULL AS error FROM {_block[t]}" for t in _tables)
ORACLES["load_summary"] = sql(
    "SELECT 13::BIGINT AS tables, sum(rows)::BIGINT AS rows, sum(rows)::BIGINT AS stored,"
    " (SELECT count(*) - count(PART_PER_VEHICLE) FROM part_to_model) AS lost_cells, true AS success"
    f" FROM ({_counted})",
    *_all_blocks,
)
ORACLES["reload_keeps_history"] = sql(
    f"{_counted} UNION ALL SELECT 'part_to_breakpoint', 0, count(*) || ' kept rows refer to parts that are gone'"
    " FROM breakpoint_links JOIN part_data USING (PART_ID) WHERE CAST(PART_NUMBER[3:] AS BIGINT) % 2 = 1",
    *_all_blocks,
)
BLOCKS["numbered_pairs"] = (
    "SELECT row_number() OVER (ORDER BY p.breakpoint_date, old_part_id, new_part_id)::VARCHAR AS BREAKPOINT_NUMBER,"
    " p.breakpoint_date AS BREAKPOINT_DATE, new.PART_NUMBER, old.PART_NUMBER AS PART_NUMBER_BEFORE_CHANGE, old_part_id, new_part_id"
    " FROM pairs p JOIN part_data old ON old.PART_ID = old_part_id JOIN part_data new ON new.PART_ID = new_part_id",
    ("pairs", "part_data"),
)
_pair_side = (
    f"SELECT {{0}}_part_id AS PART_ID, {key_for('BREAKPOINT_ID')} AS BREAKPOINT_ID, PART_NUMBER_BEFORE_CHANGE,"
    " s.SUPPLIER_NAME AS SUPPLIER_NAME_BEFORE_CHANGE, s.LOCALIZATION AS LOCALIZATION_BEFORE_CHANGE,"
    " f.LINE_NAME AS LINE_NAME_BEFORE_CHANGE, {1} AS IS_ACTIVE_BEFORE, NOT {1} AS IS_ACTIVE_AFTER,"
    f" '{STAMP}' AS INPUT_DATE, BREAKPOINT_NUMBER, {text_date('BREAKPOINT_DATE')} AS BREAKPOINT_DATE,"
    " 'Change: ' || PART_NUMBER_BEFORE_CHANGE || ' → ' || n.PART_NUMBER AS DESCRIPTION FROM numbered_pairs n"
    " JOIN part_data p ON p.PART_ID = old_part_id LEFT JOIN supplier_data s ON s.SUPPLIER_ID = p.SUPPLIER_ID"
    " LEFT JOIN first_lines f ON f.PART_ID = old_part_id"
)
ORACLES["load_pairs"] = sql(
    f"{_pair_side.format('old', 'true')} UNION ALL {_pair_side.format('new', 'false')}",
    "numbered_pairs", "supplier_data", "first_lines",
)
ORACLES["check_dates"] = sql(
    "SELECT 'breakpoint_data' AS table_name, 'unreadable' AS rule, 'BREAKPOINT_DATE' AS column_name, BREAKPOINT_NUMBER AS row_key"
    " FROM changes WHERE CAST(BREAKPOINT_NUMBER[3:] AS BIGINT) % 7 = 0",
    "changes",
)
_first_parts = _first("(SELECT * FROM keyed WHERE BOX_TYPE = 'returnable')", "part_data", _columns("part_data"))
ORACLES["insert_new"] = sql(
    f", old AS ({_first_parts}) SELECT * FROM old UNION ALL"
    " SELECT * FROM part_data WHERE PART_ID NOT IN (SELECT PART_ID FROM old)",
    "part_data",
).replace(" , old AS", ", old AS")
ORACLES["append_clash"] = sql(f", old AS ({_first_parts}) SELECT PART_ID, PART_NUMBER FROM old WHERE PART_NUMBER LIKE '%7'", "part_data").replace(
    " , old AS", ", old AS"
)
ORACLES["merge_folders"] = sql(
    "SELECT 'line_data' AS table_name, LINE_ID AS row_key, true AS merged FROM line_data"
    " UNION ALL SELECT 'box_data', BOX_ID, true FROM box_data",
    "line_data", "box_data",
)
ORACLES["correct_parts"] = sql(
    "SELECT PART_ID, PART_NUMBER, CASE WHEN p_size > 25 THEN 'Large ' || p_name ELSE PART_NAME END AS PART_NAME,"
    " CASE WHEN p_size < 10 THEN 1.25::DOUBLE ELSE PART_WEIGHT_KG END AS PART_WEIGHT_KG, SUPPLIER_ID"
    " FROM part_data LEFT JOIN part ON PART_NUMBER = 'P-' || p_partkey",
    "part_data",
)


def _violations(table: str, rule: str, column: str, condition: str, name: str, keys: list[str]) -> str:
    row_key = " || '|' || ".join(f"coalesce({k}::VARCHAR, 'null')" for k in keys)
    return (
        f"SELECT '{name}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, {row_key} AS row_key"
        f" FROM {table} WHERE {condition}"
    )


def _declared(rule: str) -> list[str]:
    """The declared rule on every table it applies to."""
    found = []
    for t in _tables:
        spec = TABLES[t]
        conditions: dict[str, str] = {}
        for c, kind in spec.columns.items():
            limit, values = length_of(kind), enum_of(kind)
            if rule == "enum" and values:
                conditions[c] = f"{c} NOT IN ({', '.join(repr(v) for v in values)})"
            if rule == "length" and limit:
                conditions[c] = f"length({c}) > {limit}"
            if rule == "smallint" and kind == "smallint":
                conditions[c] = f"{c} NOT BETWEEN -32768 AND 32767"
            if rule == "decimal" and kind.startswith("decimal"):
                conditions[c] = f"{c} IS NOT NULL AND try_cast({c} AS DECIMAL(5,2)) IS NULL"
        if rule == "non_negative":
            conditions = {c: f"{c} < 0" for c in spec.non_negative}
        if rule == "not_null":
            conditions = {c: f"{c} IS NULL" for c in (*spec.key, *spec.not_null)}
        found += [_violations(_block[t], rule, c, cond, t, list(spec.key)) for c, cond in conditions.items()]
    return found


def check(rule: str, table: str, keys: str, column: str, condition: str) -> str:
    extra = _violations(table, rule, column, condition, table, keys.split(","))
    return sql(" UNION ALL ".join([*_declared(rule), extra]), *_all_blocks)


ORACLES["check_enums"] = check("enum", "orders", "o_orderkey", "status", "o_orderstatus NOT IN ('F', 'O')")
ORACLES["check_non_negative"] = check("non_negative", "customer", "c_custkey", "balance", "c_acctbal < 0")
ORACLES["check_not_null"] = check(
    "not_null", "lineitem", "l_orderkey,l_linenumber", "flag", "l_returnflag IS NULL OR l_returnflag = 'R'"
)
ORACLES["check_length"] = check("length", "documents", "doc_id", "text", "length(text) > 200")
ORACLES["check_smallint"] = check("smallint", "orders", "o_orderkey", "total", "floor(o_totalprice) > 32767")
ORACLES["check_decimal"] = check(
    "decimal", "customer", "c_custkey", "balance", "try_cast(c_acctbal AS DECIMAL(5,2)) IS NULL"
)
_duplicates = [
    f"SELECT '{name}' AS table_name, 'unique' AS rule, {' || {} || '.format(repr('|')).join(f'{k}::VARCHAR' for k in ks)}"
    f" AS row_key, count(*) AS rows FROM {source} GROUP BY {', '.join(ks)} HAVING count(*) > 1"
    for name, source, ks in [
        *[(t, _block[t], TABLES[t].key) for t in _tables],
        ("lineitem", "lineitem", ("l_orderkey", "l_linenumber")),
    ]
]
ORACLES["check_pk_unique"] = sql(" UNION ALL ".join(_duplicates), *_all_blocks)
ORACLES["check_immutable"] = sql(
    "SELECT PART_ID, PART_NUMBER AS old_value, replace(PART_NUMBER, 'P-1', 'Q-1') AS new_value FROM part_data"
    " WHERE PART_NUMBER <> replace(PART_NUMBER, 'P-1', 'Q-1')",
    "part_data",
)
