"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame.

Queries on the sheet, its cleaning and its tables are single lazy plans that read only the columns
and tables they need. Queries on loaded tables share one full load per session and folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partgraph.functions import casts, derive, text
from partgraph.model import (
    CHANGE_SCHEMA,
    ENTITY_COLUMNS,
    ENTITY_TABLES,
    KEYS,
    LINK_TABLES,
    ORDER,
    SHEET_COLUMNS,
    TABLES,
)
from partgraph.operators import changes, dedup, edits, normalize, overview, project, quality, recipe
from partgraph.plans import load
from partgraph.plans.store import TableStore
from partgraph.session import delete, scratch, spread, tune
from partgraph.sources import sheet as files
from partgraph.sources.trade import change_sheet, part_sheet, read_table
from partgraph.streaming.ingest import file_drop

Query = Callable[[SparkSession, str], DataFrame]

#: Input date of loaded breakpoints, fixed so that runs agree.
STAMP = "2026-01-01 00:00:00"
#: Letters exchanged for Chinese characters, to have text the transliteration works on.
LETTERS, CHARACTERS = "kqxz", "中国汽车"

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, folder: run(tune(spark), folder)
        return run

    return register


# -- shared inputs -----------------------------------------------------------------------


def clean_columns(spark: SparkSession, folder: str, columns: Iterable[str] = SHEET_COLUMNS) -> DataFrame:
    return recipe.apply_recipe(part_sheet(spark, folder, columns), recipe.sheet_recipe())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An entity or link table, from just the sheet columns it draws on."""
    return normalize.build_table(part_sheet(spark, folder, normalize.sheet_columns_for(name)), name)


def typed_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changes.type_changes(change_sheet(spark, folder))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Short change sheet: the same changes by part key."""
    typed = typed_changes(spark, folder)
    return changes.pair_changes(
        typed.select(
            F.col("BREAKPOINT_DATE").alias("breakpoint_date"),
            derive.key_for("PART_ID", PART_NUMBER="PART_NUMBER_BEFORE_CHANGE").alias("old_part_id"),
            derive.key_for("PART_ID").alias("new_part_id"),
        )
    )


def new_store(spark: SparkSession, name: str) -> TableStore:
    return TableStore(spark, scratch(spark, name))


_LOADED: dict[tuple[str, str], tuple[TableStore, DataFrame]] = {}


def loaded(spark: SparkSession, folder: str, prepared: tuple[DataFrame, bool] | None = None) -> tuple[TableStore, DataFrame]:
    """Store with everything loaded from ``folder``, and the report of that load, which names tables that were refused.

    ``prepared`` is the sheet where a query has written it already.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LOADED:
        store = new_store(spark, "store")
        sheet, placed = prepared or (part_sheet(spark, folder), None)
        report = load.load_sheet(store, sheet, change_sheet(spark, folder), stamp=STAMP, placed=placed)
        _LOADED[key] = (store, report)
    return _LOADED[key]


def full(spark: SparkSession, folder: str, prepared: tuple[DataFrame, bool] | None = None) -> TableStore:
    """The store of ``loaded``, for queries over its rows: they fail with a load that was refused, as its tables have none."""
    store, report = loaded(spark, folder, prepared)
    load.require_loaded(report)
    return store


def plain(df: DataFrame) -> DataFrame:
    """Widest plain types, for comparison: bigint, double, text dates."""

    def widen(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.ShortType, T.IntegerType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        return F.col(f.name)

    return df.select(*[widen(f) for f in df.schema.fields])


# -- sources and sinks -------------------------------------------------------------------


@query("scan_sheet")
def scan_sheet(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "sheet-csv")
    files.write_csv(part_sheet(spark, folder).drop(ORDER), path)
    return files.read_sheet(spark, path).drop(ORDER)


@query("empty_entity")
def empty_entity(spark: SparkSession, folder: str) -> DataFrame:
    """Each entity's frame over the sheet rows without a part number, of which there are none."""
    rows = part_sheet(spark, folder).where("PART_NUMBER is null")
    counts = [
        project.project_entity(rows, e).agg(
            F.lit(e).alias("entity"),
            F.lit(len(project.empty_entity(spark, e).columns)).cast("bigint").alias("columns"),
            F.count(F.lit(1)).alias("rows"),
        )
        for e in ENTITY_COLUMNS
    ]
    return reduce(DataFrame.unionByName, counts)


@query("stream_ingest")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The sheet dropped as packed CSV files one after the other, streamed into an empty store; all rows of the tables it then holds."""
    drop, store = scratch(spark, "drop"), new_store(spark, "streamed")
    files.write_csv(part_sheet(spark, folder, ordered=True).drop(ORDER), drop, "gzip")
    files.arrived_in_order(spark, drop, "*.csv.gz")
    file_drop(store, drop, scratch(spark, "drop-checkpoint"), glob="*.csv.gz").awaitTermination()
    held = [plain(df).withColumn("table_name", F.lit(name)) for name, df in store.read_all().items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held)


@query("merge_folders")
def merge_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and boxes appended in three parts each, merged, older versions deleted: all rows, with the folders before and after."""
    store = new_store(spark, "merged")
    names = ("line_data", "box_data")
    for name in names:
        rows = table(spark, folder, name)
        for part in range(3):
            store.append(rows.where(F.pmod(F.xxhash64(*TABLES[name].key), F.lit(3)) == part), name)
    before = {name: len(folders) for name, folders in store.current().items()}
    store.merge_small(at_least=2)
    store.remove_old(1)
    after = {name: len(folders) for name, folders in store.current().items()}
    held = [
        plain(store.read(n).select(F.lit(n).alias("table_name"), F.col(TABLES[n].key[0]).alias("row_key"), (F.lit(before[n]) - F.lit(after[n]) > 0).alias("merged")))
        for n in names
    ]
    return reduce(DataFrame.unionByName, held)


@query("append_table")
def append_table(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "append")
    rows = store.append(table(spark, folder, "line_data"), "line_data")
    return plain(store.read("line_data").withColumn("appended", F.lit(rows).cast("bigint")))


@query("tsv_roundtrip")
def tsv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "sheet-tsv")
    rows = clean_columns(spark, folder).drop(ORDER)
    files.write_tsv(rows, path, packed=True)
    return files.read_tsv(spark, path, rows.schema)


@query("truncate_load")
def truncate_load(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers loaded anew over a full set: parts and their links are emptied with the old ones."""
    store = new_store(spark, "truncate")
    store.publish(full(spark, folder).current())
    load.load_table(store, table(spark, folder, "supplier_data"), "supplier_data")
    return load.table_counts(store)


@query("json_stage")
def json_stage(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "sheet-json")
    rows = clean_columns(spark, folder).drop(ORDER)
    files.write_json(rows, path)
    return files.read_json(spark, path, rows.schema)


# -- projections -------------------------------------------------------------------------


def _projection(entity: str) -> Query:
    return lambda spark, folder: project.project_entity(part_sheet(spark, folder, ENTITY_COLUMNS[entity]), entity)


for _entity in ENTITY_COLUMNS:
    query(f"proj_{_entity}")(_projection(_entity))


@query("split_row_counts")
def split_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    frames = project.split_sheet(part_sheet(spark, folder).drop(ORDER))
    counts = [
        df.agg(
            F.lit(name).alias("frame"),
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            F.count(F.lit(1)).alias("rows"),
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query("header_upper")
def header_upper(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("PART_PER_VEHICLE", "PART_PER_BOX", "BOX_PER_PALLET")
    mixed = part_sheet(spark, folder, columns).drop(ORDER).toDF(*[f" {c.replace('PER', 'per')} " for c in columns])
    return project.upper_headers(mixed)


# -- scalar functions --------------------------------------------------------------------


@query("to_int64")
def to_int64(spark: SparkSession, folder: str) -> DataFrame:
    rows = part_sheet(spark, folder, ("PART_PER_VEHICLE", "BOX_WEIGHT_KG", "PART_NUMBER"))
    prices = read_table(spark, folder, "lineitem").select(casts.to_int64(F.col("l_extendedprice")).alias("value"))
    texts = [rows.select(casts.to_int64(F.col(c)).alias("value")) for c in rows.columns if c != ORDER]
    return reduce(DataFrame.unionByName, texts, prices)


@query("to_string")
def to_string(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "lineitem")
    names = ("l_orderkey", "l_linenumber", "l_returnflag")
    return rows.select(*[casts.to_string(F.col(c)).alias(c) for c in names])


@query("to_float2")
def to_float2(spark: SparkSession, folder: str) -> DataFrame:
    rows = part_sheet(spark, folder, ("PART_WEIGHT_KG", "PART_PER_VEHICLE"))
    numbers = read_table(spark, folder, "lineitem").select(
        casts.to_float2(F.expr("l_extendedprice / 7")).alias("value")
    )
    texts = [rows.select(casts.to_float2(F.col(c)).alias("value")) for c in rows.columns if c != ORDER]
    return reduce(DataFrame.unionByName, texts, numbers)


def _document_query(function: Callable[[Column], Column], name: str = "text") -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spread(read_table(spark, folder, "documents")).select("doc_id", function(F.col("text")).alias(name))

    return run


def chinese(col: Column) -> Column:
    return F.translate(col, LETTERS, CHARACTERS)


query("has_chinese")(_document_query(lambda c: text.has_chinese(chinese(c)), "has_chinese"))
query("split_lower_camel")(_document_query(text.split_lower_camel))
query("split_capitals")(_document_query(text.split_capitals))
query("pad_numbers")(_document_query(text.pad_numbers))
query("strip_specials")(_document_query(text.strip_specials))
query("squeeze_ws")(_document_query(text.squeeze_ws))
query("trim_text")(_document_query(lambda c: text.trim_text(text.strip_specials(c))))
query("title_case")(_document_query(text.title_case))
query("clean_text_basic")(_document_query(text.clean_text_basic))


@query("transliterate")
def transliterate(spark: SparkSession, folder: str) -> DataFrame:
    readings = text.reading_table(text.pinyin_readings(spark))
    return _document_query(lambda c: text.transliterate(chinese(c), readings))(spark, folder)


@query("clean_text")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """The full chain, transliteration included, over whole documents."""
    readings = text.reading_table(text.pinyin_readings(spark))
    return _document_query(lambda c: text.clean_text(chinese(c), readings))(spark, folder)


@query("apply_recipe")
def apply_recipe(spark: SparkSession, folder: str) -> DataFrame:
    """A caller's own recipe, with one column the frame lacks."""
    rows = part_sheet(spark, folder, ("PART_NUMBER", "PART_PER_VEHICLE", "CONFIGURATION")).drop(ORDER)
    own = {"PART_PER_VEHICLE": casts.to_int64, "CONFIGURATION": F.lower, "NO_SUCH_COLUMN": F.upper}
    return recipe.apply_recipe(rows, own)


@query("recipe_stats")
def recipe_stats(spark: SparkSession, folder: str) -> DataFrame:
    own = {**recipe.sheet_recipe(), "NO_SUCH_COLUMN": casts.to_string}
    return recipe.recipe_stats(part_sheet(spark, folder), own)


@query("clean_sheet")
def clean_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return clean_columns(spark, folder).drop(ORDER)


# -- derived values ----------------------------------------------------------------------


def _sizes(p: str) -> list[str]:
    return [f"{p}_LENGTH_MM", f"{p}_WIDTH_MM", f"{p}_HEIGHT_MM"]


def _packaging(p: str, name: str, formula: Callable[..., Column], inputs: Callable[[str], list[str]]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        columns = inputs(p)
        rows = clean_columns(spark, folder, columns)
        return rows.select(*columns, formula(*[F.col(c) for c in columns]).alias(name))

    return run


for _p in ("BOX", "PALLET"):
    _low = _p.lower()
    query(f"{_low}_number")(
        _packaging(_p, f"{_p}_NUMBER", derive.packaging_number, lambda p: [f"{p}_TYPE", *_sizes(p)])
    )
    query(f"{_low}_volume")(_packaging(_p, f"{_p}_VOL_M3", derive.volume_m3, _sizes))
    query(f"{_low}_area")(_packaging(_p, f"{_p}_AREA_M2", derive.area_m2, lambda p: _sizes(p)[:2]))

_NATURAL = tuple(dict.fromkeys(c for k, (_, parts) in KEYS.items() if k != "BREAKPOINT_ID" for c in parts))


@query("surrogate_key")
def surrogate_key(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.add_keys(clean_columns(spark, folder, _NATURAL)).drop(ORDER)


@query("default_number")
def default_number(spark: SparkSession, folder: str) -> DataFrame:
    columns = [c for p in ("BOX", "PALLET") for c in (f"{p}_NUMBER", f"{p}_TYPE", *_sizes(p))]
    return normalize.fill_packaging(clean_columns(spark, folder, columns)).drop(ORDER)


@query("change_label")
def change_label(spark: SparkSession, folder: str) -> DataFrame:
    label = derive.change_label(F.col("PART_NUMBER_BEFORE_CHANGE"), F.col("PART_NUMBER"))
    return change_sheet(spark, folder).select("BREAKPOINT_NUMBER", label.alias("label"))


# -- filters and counts ------------------------------------------------------------------


def _open_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of part and box without the default number, so some boxes have none."""
    return normalize.add_keys(clean_columns(spark, folder, ("PART_NUMBER", "BOX_NUMBER")))


@query("drop_null_keys")
def drop_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.drop_null_keys(_open_boxes(spark, folder).select("PART_ID", "BOX_ID"), ["PART_ID", "BOX_ID"])


@query("null_pk_count")
def null_pk_count(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_key_count(_open_boxes(spark, folder), ["BOX_ID"])


@query("drop_bad_keys")
def drop_bad_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts that are numbers; the others have no valid form and go."""
    rows = part_sheet(spark, folder, ("PART_NUMBER", "PART_PER_VEHICLE")).drop(ORDER)
    return dedup.drop_bad_keys(rows, ["PART_PER_VEHICLE"], "^[0-9]+$")


@query("dedup_first")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "box_data")


@query("distinct_rows")
def distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("PART_NUMBER", "MODEL_CODE", "LINE_CODE", "CONFIGURATION")
    return dedup.distinct_rows(part_sheet(spark, folder, columns), columns)


@query("table_counts")
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return load.table_counts(full(spark, folder))


@query("load_total")
def load_total(spark: SparkSession, folder: str) -> DataFrame:
    return quality.load_total(table_counts(spark, folder))


@query("null_profile")
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_profile(part_sheet(spark, folder).drop(ORDER))


# -- tables ------------------------------------------------------------------------------

query("part_with_supplier")(lambda spark, folder: table(spark, folder, "part_data"))
query("line_with_workshop")(lambda spark, folder: table(spark, folder, "line_data"))


def _link(name: str) -> Query:
    return lambda spark, folder: table(spark, folder, name)


for _name in LINK_TABLES:
    query(_name)(_link(_name))

#: Filter of each lookup query.
LOOKUPS = {
    "find_by_part": ("PART_NUMBER", "P-7"),
    "find_by_model_code": ("MODEL_CODE", "B02"),
    "find_by_model_name": ("MODEL_NAME", "Dargo"),
    "find_by_line_code": ("LINE_CODE", "L3"),
    "find_by_line_name": ("LINE_NAME", "Line 5"),
    "find_by_supplier": ("SUPPLIER_NAME", "Supplier 000000005"),
    "find_by_location": ("LOCATION", "NATION_3"),
    "find_by_city": ("CITY", "City 4"),
    "find_by_localization": ("LOCALIZATION", "yes"),
}


def _lookup(column: str, value: str) -> Query:
    return lambda spark, folder: plain(
        overview.part_overview(full(spark, folder).read_all(), **{column: value})
    )


for _name, (_column, _value) in LOOKUPS.items():
    query(_name)(_lookup(_column, _value))


@query("part_overview")
def part_overview(spark: SparkSession, folder: str) -> DataFrame:
    return plain(overview.part_overview(full(spark, folder).read_all()))


@query("fk_orphans")
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of the loaded tables, and of documents against the labels they should have."""
    audit = quality.orphans(full(spark, folder).read_all())
    documents, labels = (read_table(spark, folder, t) for t in ("documents", "labels"))
    return audit.unionByName(quality.orphan_values(documents, "doc_id", labels, "doc_id", "documents"))


# -- change history ----------------------------------------------------------------------


@query("breakpoints")
def breakpoints(spark: SparkSession, folder: str) -> DataFrame:
    return plain(pairs(spark, folder))


@query("breakpoint_seq")
def breakpoint_seq(spark: SparkSession, folder: str) -> DataFrame:
    return plain(changes.number_breakpoints(pairs(spark, folder)))


@query("part_to_breakpoint")
def part_to_breakpoint(spark: SparkSession, folder: str) -> DataFrame:
    return changes.fan_out(changes.pair_breakpoints(pairs(spark, folder)))


@query("before_change")
def before_change(spark: SparkSession, folder: str) -> DataFrame:
    tables = full(spark, folder).read_all()
    return plain(changes.before_change(typed_changes(spark, folder), tables).drop(ORDER, changes.RAW_DATE))


@query("part_history")
def part_history(spark: SparkSession, folder: str) -> DataFrame:
    return plain(changes.part_history(full(spark, folder).read_all()))


@query("load_breakpoints")
def load_breakpoints(spark: SparkSession, folder: str) -> DataFrame:
    report = loaded(spark, folder)[1]
    return report.where("stage = 'change'").select("table_name", "rows")


# -- loads and edits ---------------------------------------------------------------------


@query("load_entity")
def load_entity(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "entity")
    load.load_table(store, table(spark, folder, "pallet_data"), "pallet_data")
    return plain(store.read("pallet_data"))


def _reported(names: tuple[str, ...]) -> Query:
    return lambda spark, folder: loaded(spark, folder)[1].where(F.col("table_name").isin(*names)).drop("error")


@query("load_summary")
def load_summary(spark: SparkSession, folder: str) -> DataFrame:
    return load.load_summary(loaded(spark, folder)[1])


@query("reload_keeps_history")
def reload_keeps_history(spark: SparkSession, folder: str) -> DataFrame:
    """Reloads without a change sheet: all parts keep the change tables; without the odd parts the load is refused.

    The report's failures of the second, and the rows of all tables after both. The sheet is written once for all its loads.
    """
    store, path = new_store(spark, "reload"), scratch(spark, "sheet")
    rows, placed = load.prepare_sheet(part_sheet(spark, folder), path)
    try:
        store.publish(full(spark, folder, (rows, placed)).current())
        load.require_loaded(load.load_sheet(store, rows, placed=placed))
        even = rows.where("cast(substring(PART_NUMBER, 3) as bigint) % 2 = 0")
        report = load.load_sheet(store, even, placed=placed).where("status = 'failed'")
    finally:
        delete(spark, path)
    report = report.select("table_name", F.lit(0).cast("bigint").alias("rows"), "error")
    return report.unionByName(load.table_counts(store).withColumn("error", F.lit(None).cast("string")))


query("load_entities")(_reported(ENTITY_TABLES))
query("load_links")(_reported(LINK_TABLES))
query("load_report")(_reported(tuple(TABLES)))


@query("insert_new")
def insert_new(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of returnable boxes come first, then all parts: only new ones are added."""
    rows = part_sheet(spark, folder, [*normalize.sheet_columns_for("part_data"), "BOX_TYPE"])
    first = normalize.build_table(rows.where("BOX_TYPE = 'returnable'"), "part_data")
    return edits.insert_new(first, normalize.build_table(rows, "part_data"), TABLES["part_data"].key)


@query("append_clash")
def append_clash(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of returnable boxes' parts that an append would give to another part number."""
    rows = part_sheet(spark, folder, [*normalize.sheet_columns_for("part_data"), "BOX_TYPE"])
    first = normalize.build_table(rows.where("BOX_TYPE = 'returnable'"), "part_data")
    renamed = F.when(F.col("PART_NUMBER").endswith("7"), F.concat(F.lit("R-"), "PART_NUMBER")).otherwise(F.col("PART_NUMBER"))
    incoming = normalize.build_table(rows, "part_data").withColumn("PART_NUMBER", renamed)
    return edits.key_clashes(first, incoming, TABLES["part_data"].key, ["PART_NUMBER"])


def _corrections(spark: SparkSession, folder: str) -> DataFrame:
    """A name for large parts and a weight for small ones."""
    return read_table(spark, folder, "part").select(
        F.expr("'P-' || cast(p_partkey as string)").alias("PART_NUMBER"),
        F.expr("case when p_size > 25 then 'Large ' || p_name end").alias("PART_NAME"),
        F.expr("case when p_size < 10 then '1.25' end").alias("PART_WEIGHT_KG"),
    )


@query("correct_parts")
def correct_parts(spark: SparkSession, folder: str) -> DataFrame:
    return edits.correct_rows(table(spark, folder, "part_data"), _corrections(spark, folder), ["PART_NUMBER"])


@query("load_changes")
def load_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Change sheet written and read as a file, then bulk loaded beside the parts."""
    path = scratch(spark, "changes-csv")
    change_sheet(spark, folder).drop(ORDER).write.option("header", True).csv(path)
    return _bulk_changes(spark, folder, files.read_sheet(spark, path, schema=CHANGE_SCHEMA))


def _bulk_changes(spark: SparkSession, folder: str, sheet: DataFrame) -> DataFrame:
    """What a store of all parts holds of changes after a bulk load of ``sheet``."""
    store = new_store(spark, "changes")
    store.publish({**full(spark, folder).current(), "breakpoint_data": [], "part_to_breakpoint": []})
    load.require_loaded(load.load_changes(store, sheet, stamp=STAMP))
    return plain(store.read("part_to_breakpoint").join(store.read("breakpoint_data"), "BREAKPOINT_ID"))


@query("load_pairs")
def load_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The short change sheet, bulk loaded: part keys lead back to part numbers."""
    return _bulk_changes(spark, folder, pairs(spark, folder))


@query("check_dates")
def check_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Breakpoints whose date can't be read, of a change sheet that spells some dates out."""
    spelt = F.when(F.col(ORDER) % 7 == 0, F.concat(F.lit("day "), "BREAKPOINT_DATE")).otherwise(F.col("BREAKPOINT_DATE"))
    typed = changes.type_changes(change_sheet(spark, folder).withColumn("BREAKPOINT_DATE", spelt))
    rule = quality.unreadable("BREAKPOINT_DATE", F.col(changes.RAW_DATE))
    return quality.violations(typed, "breakpoint_data", ["BREAKPOINT_NUMBER"], [rule])


# -- integrity rules ---------------------------------------------------------------------


def _check(rule: str, name: str, key: str, source: str, broken: Callable[[], quality.Rule]) -> Query:
    """A declared rule over all loaded tables, and one like it over a given table that breaks it."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        declared = quality.check_tables(full(spark, folder).read_all(), rule)
        own = broken()
        rows = read_table(spark, folder, name).withColumn(own.column, F.expr(source))
        return declared.unionByName(quality.violations(rows, name, key.split(","), [own]))

    query(f"check_{_CHECKS[rule]}")(run)
    return run


#: Rule -> name of its query.
_CHECKS = {
    "enum": "enums",
    "non_negative": "non_negative",
    "not_null": "not_null",
    "length": "length",
    "smallint": "smallint",
    "decimal": "decimal",
}
_check("enum", "orders", "o_orderkey", "o_orderstatus", lambda: quality.allowed("status", ("F", "O")))
_check("non_negative", "customer", "c_custkey", "c_acctbal", lambda: quality.non_negative("balance"))
_check(
    "not_null", "lineitem", "l_orderkey,l_linenumber", "nullif(l_returnflag, 'R')", lambda: quality.not_null("flag")
)
_check("length", "documents", "doc_id", "text", lambda: quality.max_length("text", 200))
_check(
    "smallint", "orders", "o_orderkey", "cast(floor(o_totalprice) as bigint)", lambda: quality.smallint("total")
)
_check("decimal", "customer", "c_custkey", "c_acctbal", lambda: quality.decimal_range("balance"))


@query("check_pk_unique")
def check_pk_unique(spark: SparkSession, folder: str) -> DataFrame:
    tables = full(spark, folder).read_all()
    found = [quality.duplicate_keys(df, name, TABLES[name].key) for name, df in tables.items()]
    lines = quality.duplicate_keys(read_table(spark, folder, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])
    return reduce(DataFrame.unionByName, found, lines)


@query("check_immutable")
def check_immutable(spark: SparkSession, folder: str) -> DataFrame:
    """Part numbers that an edit of the part table changed."""
    old = table(spark, folder, "part_data")
    new = old.withColumn("PART_NUMBER", F.expr("replace(PART_NUMBER, 'P-1', 'Q-1')"))
    return quality.changed_values(old, new, ["PART_ID"], "PART_NUMBER")
