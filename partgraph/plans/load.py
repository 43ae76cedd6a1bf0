"""Loads: single tables, all tables, and the report over a full load."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.functions.derive import KEY_WIDTH
from partgraph.model import CELLS, CHANGE_TABLES, CLASH, ENTITY_TABLES, KEYS, LINK_TABLES, ORDER, TABLES, dependants
from partgraph.operators.changes import breakpoint_tables, is_pair_sheet, pair_sheet, type_changes, write_changes
from partgraph.operators.dedup import all_placed
from partgraph.operators.edits import correct_rows, new_entities, new_rows
from partgraph.operators.normalize import build_table
from partgraph.operators.project import is_complete, require_columns, split_sheet, upper_headers
from partgraph.operators.quality import Rule, broken_rules, count_rows, null_key_count, orphan_values, row_key, table_rules, unreadable
from partgraph.plans.store import TableStore, to_declared
from partgraph.session import delete, scratch, write_staged
from partgraph.sources.sheet import number_order

REPORT_SCHEMA = "table_name string, stage string, rows bigint, stored bigint, status string, lost_cells string, error string"


class LoadError(ValueError):
    """A table was refused; nothing of it became visible."""


@dataclass
class TableLoad:
    """Outcome of one table: folders to publish, rows loaded, rows found in the folders afterwards, and by
    column the filled raw cells of loaded rows whose typed value is empty."""

    table: str
    rows: int = 0
    stored: int = 0
    folders: tuple[str, ...] = ()
    rejected: int = 0
    error: str | None = None
    published: bool = True
    lost: dict[str, int] = field(default_factory=dict)

    @property
    def status(self) -> str:
        if self.error:
            return "failed"
        return ("loaded" if self.rows else "empty") if self.published else "not published"


def write_table(
    store: TableStore, df: DataFrame, table: str, quarantine: bool = False, width: int = KEY_WIDTH,
    parents: Mapping[str, DataFrame] = MappingProxyType({}), strict_dates: bool = False,
) -> TableLoad:
    """Check and write one table in a single pass; the result is not visible yet.

    Row count, open keys, broken rules and key clashes are counted while the rows are written. A
    table with an open key or a clash is refused, one with broken rules too, unless ``quarantine``
    is set: then those rows go to a folder of their own, with the rules they break, their raw cells
    (their typed values where there are no cells) and their typed values, and the rest is loaded. Cells lost to a typed column are counted, too.
    With ``strict_dates`` a breakpoint date that can't be read breaks rule ``unreadable``; else it is a lost cell. ``parents`` are tables by the column that refers to them: a row
    whose parent is not there breaks rule ``fk``.
    """
    declared = TABLES[table]
    require_columns(df, declared.key, table)
    rules = [r for r in table_rules(table, width) if r.column in df.columns and r.name != "not_null"]
    rules += [r for r in table_rules(table, width) if r.name == "not_null" and r.column not in declared.key]
    for r in rules:
        require_columns(df, [r.column], table)
    cells = set(df.schema[CELLS].dataType.fieldNames()) & set(declared.columns) if CELLS in df.columns else set()
    if strict_dates and "BREAKPOINT_DATE" in cells:
        rules.append(unreadable("BREAKPOINT_DATE", F.col(f"{CELLS}.BREAKPOINT_DATE")))
    open_key = F.lit(False)
    for c in declared.key:
        open_key = open_key | F.col(c).isNull()
    for column, parent in parents.items():
        known = parent.select(F.col(parent.columns[0]).alias(column)).distinct().withColumn(f"_HAS_{column}", F.lit(True))
        df = df.join(known, column, "left")
        rules.append(Rule("fk", column, F.col(column).isNotNull() & F.col(f"_HAS_{column}").isNull()))
    marked = df.withColumns({"_RULES": broken_rules(rules), "_OPEN": open_key})
    marked = marked.drop(*(f"_HAS_{column}" for column in parents))
    broken = F.size("_RULES") > 0
    metrics: dict[str, Column] = {
        "rows": F.count(F.lit(1)),
        "open_keys": F.count_if(F.col("_OPEN")),
        "broken": F.count_if(broken),
        "clashes": F.count_if(F.col(CLASH)) if CLASH in df.columns else F.count_if(F.lit(False)),
    }
    for c in cells:
        metrics[f"lost_{c}"] = F.count_if(F.col(f"{CELLS}.{c}").isNotNull() & F.col(c).isNull())
    if quarantine:
        typed = F.struct(*[c for c in df.columns if not c.startswith("_")])
        raw = F.struct(*[F.col(f"{CELLS}.{c}") for c in df.schema[CELLS].dataType.fieldNames() if c != ORDER]) if cells else typed
        marked = marked.withColumns({"_RAW": F.when(broken, F.to_json(raw)), "_TYPED": F.when(broken, F.to_json(typed)), "_OK": ~broken})
    folder, seen = store.write(to_declared(marked, table), table, metrics, "_OK" if quarantine else None)
    if seen["open_keys"] or seen["clashes"] or (seen["broken"] and not quarantine):
        store.discard([folder])
    if seen["open_keys"]:
        raise LoadError(f"{table}: {seen['open_keys']} rows without primary key {declared.key}")
    if seen["clashes"]:
        raise LoadError(f"{table}: {seen['clashes']} keys stand for several natural keys; use wider keys")
    if seen["broken"] and not quarantine:
        raise LoadError(f"{table}: {seen['broken']} rows break integrity rules")
    good = seen["rows"] - seen["broken"]
    place = f"{folder}/_OK=true" if quarantine else folder
    lost = {c: seen[f"lost_{c}"] for c in declared.columns if seen.get(f"lost_{c}")}
    return TableLoad(table, good, folders=(place,) if good else (), rejected=seen["broken"], lost=lost)


def verify(store: TableStore, done: Sequence[TableLoad]) -> None:
    """Compare the rows counted during the writes with those in the folders, by their Parquet footers."""
    written = {d.table: store.read_folders(d.table, list(d.folders)) for d in done if d.folders}
    found = {r["table_name"]: r["rows"] for r in count_rows(written).collect()} if written else {}  # one row per table
    for d in done:
        d.stored = found.get(d.table, 0)
        if not d.error and d.stored != d.rows:
            d.error = f"{d.rows} rows written, {d.stored} found"


def read_quarantine(store: TableStore, table: str, folder: str) -> DataFrame:
    """Rows a quarantine load set aside: (row_key, rules, raw, typed)."""
    schema = f"{', '.join(f'{c} string' for c in TABLES[table].key)}, _RULES array<string>, _RAW string, _TYPED string"
    rows = store.spark.read.schema(schema).parquet(folder.removesuffix("/_OK=true") + "/_OK=false")
    return rows.select(
        row_key(TABLES[table].key).alias("row_key"), F.col("_RULES").alias("rules"), F.col("_RAW").alias("raw"), F.col("_TYPED").alias("typed")
    )


def load_table(
    store: TableStore, df: DataFrame, table: str, truncate: bool = True, quarantine: bool = False
) -> int:
    """Load one table and make it visible. Empty input loads nothing and returns 0.

    With ``truncate`` the old rows go, and the tables that reference this one are emptied; without
    it only rows with new keys are added.
    """
    version, current = store.version(), store.current()
    if not truncate:
        df = only_new(store.read_folders(table, current.get(table, [])), df, table)
    done = write_table(store, df, table, quarantine)
    if not done.rows:
        return 0
    kept = {t: [] if truncate and t in dependants(table) else folders for t, folders in current.items()}
    old = [] if truncate else current.get(table, [])
    store.publish_or_discard({**kept, table: [*old, *done.folders]}, version, done.folders)
    return done.rows


def only_new(existing: DataFrame, incoming: DataFrame, table: str) -> DataFrame:
    """Rows with new keys; keys the table has for another natural key are marked as clashes."""
    key = TABLES[table].key
    parts = KEYS[key[0]][1] if len(key) == 1 and key[0] in KEYS else ()
    if not parts or any(p not in incoming.columns or p not in existing.columns for p in parts):
        return new_rows(existing, incoming, key)
    return new_entities(existing, incoming, key, parts, CLASH)


def correct_table(store: TableStore, corrections: DataFrame, table: str, key: Sequence[str], width: int = KEY_WIDTH) -> int:
    """Store corrections of a table's rows: rules are checked, tables that refer to it stay. Returns its rows."""
    version, current = store.version(), store.current()
    corrected = correct_rows(store.read_folders(table, current.get(table, [])), corrections, key)
    done = write_table(store, corrected, table, width=width)
    store.publish_or_discard({**current, table: list(done.folders)}, version, done.folders)
    return done.rows


def _refusal(error: Exception) -> str:
    """Why the data of a table was refused. A run that failed, by a lost executor, memory, disk or a file, says nothing of the data
    and is raised again: reported as a table without rows it would look like a result."""
    if isinstance(error, PySparkException):
        refused = (error.getSqlState() or "").startswith("22") or error.getCondition() == "USER_RAISED_EXCEPTION"  # 22: data
    else:
        refused = isinstance(error, ValueError)
    if not refused:
        raise error
    return str(error).split("\n", 1)[0]


def _attempt(table: str, load: Callable[[], TableLoad]) -> TableLoad:
    try:
        return load()
    except Exception as error:  # one refused table counts 0, the others go on
        return TableLoad(table, error=_refusal(error))


def require_loaded(report: DataFrame) -> None:
    """Raise if a load did not publish all its tables: what the store then holds is not what was given."""
    failed = report.where(~F.col("status").isin("loaded", "empty")).collect()  # one row per table
    if failed:
        raise LoadError("not loaded: " + "; ".join(f"{r['table_name']}: {r['error'] or r['status']}" for r in failed))


def prepare_sheet(sheet: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """Raw sheet with normal headers, written to Parquet once, so that each table's plan reads only
    its own columns, whatever the source; and whether each of its rows has a place."""
    rows = upper_headers(sheet)
    write_staged(rows, path)
    staged = sheet.sparkSession.read.schema(rows.schema).parquet(path)
    return number_order(staged), all_placed(staged)


#: Tables in the order of their references: those of one level don't refer to each other.
LEVELS = tuple(
    tuple(t for t in (*ENTITY_TABLES, *LINK_TABLES) if (t in LINK_TABLES, bool(TABLES[t].references)) in level)
    for level in ({(False, False)}, {(False, True)}, {(True, True), (True, False)})
)


def load_sheet(
    store: TableStore,
    sheet: DataFrame,
    changes: DataFrame | None = None,
    truncate: bool = True,
    quarantine: bool = False,
    all_or_nothing: bool = True,
    readings: Column | None = None,
    width: int = KEY_WIDTH,
    parallel: int = 4,
    stamp: str | None = None,
    placed: bool | None = None,
) -> DataFrame:
    """Full load of a raw sheet and, if given, a raw change sheet; returns the report.

    The tables are independent jobs over the staged sheet, so up to ``parallel`` run side by side.
    With ``all_or_nothing`` one refused table keeps the old version of all tables; a run that fails is raised, and nothing is published. Keys of parents and
    children come from the same rows, so a child can only lack a parent that was refused or set aside:
    then its rows are checked against what the parent's table will hold. Without a change sheet the
    change tables stay as they are; a truncating load then looks whether their parts are still there, and fails for
    them if not. Another load published in between makes this one fail. The report has for each table the rows
    written, the rows found in its folders afterwards, and the raw cells that its types could not hold.
    ``placed`` says that the sheet, or what it is a part of, comes from ``prepare_sheet``, and what that found: it is not written again, and stays.
    """
    if placed is not None:
        return _load_raw(store, sheet, placed, changes, truncate, quarantine, all_or_nothing, readings, width, parallel, stamp)
    spark, path = store.spark, scratch(store.spark, "sheet")
    raw, placed = prepare_sheet(sheet, path)
    try:
        return _load_raw(store, raw, placed, changes, truncate, quarantine, all_or_nothing, readings, width, parallel, stamp)
    finally:
        delete(spark, path)


def _load_raw(
    store: TableStore, raw: DataFrame, placed: bool, changes: DataFrame | None, truncate: bool, quarantine: bool, all_or_nothing: bool,
    readings: Column | None, width: int, parallel: int, stamp: str | None,
) -> DataFrame:
    if not is_complete(split_sheet(raw)):
        return _report(store, [TableLoad(t, error="no sheet rows") for t in ENTITY_TABLES])
    version, current = store.version(), store.current()
    old = {t: store.read_folders(t, current.get(t, [])) for t in TABLES}
    done: list[TableLoad] = []
    written: list[str] = []

    def job(table: str, df: DataFrame) -> TableLoad:
        rows = df if truncate else only_new(old[table], df, table)
        # of a load that will not be published, each table reports its own faults only
        lacking = {d.table for d in done if d.rejected or (d.error and not all_or_nothing)}
        folders = _folders(current, done, truncate)
        parents = {
            column: store.read_folders(parent, folders[parent]).select(TABLES[parent].key[0])
            for column, parent in TABLES[table].references.items()
            if parent in lacking
        }
        found = write_table(store, rows, table, quarantine, width, parents)
        written.extend(found.folders)
        return found

    def build(table: str) -> TableLoad:
        return _attempt(table, lambda: job(table, build_table(raw, table, True, readings, width, placed)))

    try:
        with ThreadPoolExecutor(parallel) as pool:
            for level in LEVELS:
                done += list(pool.map(build, level))
        folders = _folders(current, done, truncate)
        if changes is not None:
            done += _change_loads(store, changes, folders, truncate, quarantine, width, stamp, job)
            folders = _folders(current, done, truncate)
        else:
            folders |= {t: current.get(t, []) for t in CHANGE_TABLES}
            if truncate and folders["part_to_breakpoint"]:
                done += _kept_orphans(store, folders)
    except Exception:
        store.discard(written)
        raise
    return _settle(store, done, folders, version, all_or_nothing)


def _kept_orphans(store: TableStore, folders: Mapping[str, list[str]]) -> list[TableLoad]:
    """A failed entry if change rows that a reload keeps refer to parts that it no longer has."""
    links, parts = (store.read_folders(t, folders.get(t, [])) for t in ("part_to_breakpoint", "part_data"))
    gone = orphan_values(links, "PART_ID", parts, "PART_ID", "part_to_breakpoint").agg(F.sum("rows")).first()[0]
    if not gone:
        return []
    return [TableLoad("part_to_breakpoint", error=f"{gone} kept rows refer to parts that are gone")]


def _change_loads(
    store: TableStore, sheet: DataFrame, folders: Mapping[str, list[str]], truncate: bool, quarantine: bool, width: int, stamp: str | None,
    job: Callable[[str, DataFrame], TableLoad],
) -> list[TableLoad]:
    """Both change tables of a long or a short change sheet, over the tables in ``folders``: both, or neither."""
    tables = {t: store.read_folders(t, folders.get(t, [])) for t in TABLES}
    long = pair_sheet(sheet, tables["part_data"]) if is_pair_sheet(sheet) else sheet
    typed, path = type_changes(long), scratch(store.spark, "changes")
    try:
        staged = write_changes(typed, path)
        rows = breakpoint_tables(staged, tables, width, stamp, all_placed(staged))
        done = [_attempt(table, lambda t=table: job(t, rows[t])) for table in CHANGE_TABLES]
    except Exception as error:  # changes whose data can't be read fail both tables
        done = [TableLoad(table, error=_refusal(error)) for table in CHANGE_TABLES]
    finally:
        delete(store.spark, path)
    if any(d.error for d in done):
        for d in done:
            store.discard(d.folders)
        done = [TableLoad(d.table, error=d.error or "other change table failed") for d in done]
    return done


def load_changes(
    store: TableStore, sheet: DataFrame, truncate: bool = False, quarantine: bool = False, width: int = KEY_WIDTH, stamp: str | None = None,
    strict_dates: bool = True,
) -> DataFrame:
    """Bulk load of a raw change sheet, long or short, beside the loaded parts; returns the report.

    Both change tables become visible together, or neither. Every change must refer to a loaded part and to a breakpoint of the
    sheet or of the store: other rows break rule ``fk``, and with ``strict_dates`` dates must be readable. With ``truncate`` the old changes go, else known keys stay as they are.
    """
    version, current = store.version(), store.current()
    base = {**current, **dict.fromkeys(CHANGE_TABLES, [])} if truncate else current
    written: dict[str, tuple[str, ...]] = {}

    def job(table: str, rows: DataFrame) -> TableLoad:
        if not truncate:
            rows = only_new(store.read_folders(table, current.get(table, [])), rows, table)
        parents = {}
        for column, parent in TABLES[table].references.items():
            places = [*base.get(parent, []), *written.get(parent, ())]
            parents[column] = store.read_folders(parent, places).select(TABLES[parent].key[0])
        found = write_table(store, rows, table, quarantine, width, parents, strict_dates)
        written[table] = found.folders
        return found

    try:
        done = _change_loads(store, sheet, base, truncate, quarantine, width, stamp, job)
    except Exception:
        store.discard(f for folders in written.values() for f in folders)
        raise
    for d in done:
        store.discard(written.get(d.table, ()) if d.error else ())
    folders = {**base, **{d.table: [*base.get(d.table, []), *d.folders] for d in done}}
    return _settle(store, done, folders, version, True)


def _settle(store: TableStore, done: list[TableLoad], folders: Mapping[str, list[str]], version: int, all_or_nothing: bool) -> DataFrame:
    """Verify what was written, publish or discard it, and report."""
    try:
        verify(store, done)
    except Exception:
        store.discard(f for d in done for f in d.folders)
        raise
    if all_or_nothing and any(d.error for d in done):
        for d in done:
            d.published = False
            store.discard(d.folders)
    else:
        faulty = {d.table for d in done if d.error and d.folders}
        kept = {t: [f for f in found if t not in faulty or f not in {x for d in done if d.table == t for x in d.folders}] for t, found in folders.items()}
        store.publish_or_discard(kept, version, [f for d in done for f in d.folders])
    return _report(store, done)


def load_summary(report: DataFrame) -> DataFrame:
    """One row over a report: tables, rows, rows found, lost cells, and whether all of it succeeded."""
    lost = F.aggregate(
        F.filter(F.split("lost_cells", ","), lambda x: x != ""), F.lit(0).cast("long"), lambda s, x: s + F.split(x, "=")[1].cast("long")
    )
    return report.agg(
        F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("stored"), F.lit(0)).alias("stored"),
        F.coalesce(F.sum(lost), F.lit(0)).alias("lost_cells"),
        (F.coalesce(F.bool_and(F.col("status").isin("loaded", "empty")), F.lit(False)) & F.coalesce(F.sum("rows") == F.sum("stored"), F.lit(False))).alias("success"),
    )


def _folders(current: dict[str, list[str]], done: list[TableLoad], truncate: bool) -> dict[str, list[str]]:
    """Tables after the load: replaced or extended; a truncating load empties what it did not fill."""
    base = {t: [] if truncate else current.get(t, []) for t in TABLES}
    return {**base, **{d.table: [*base[d.table], *d.folders] for d in done}}


_STAGES = {
    **dict.fromkeys(ENTITY_TABLES, "entity"),
    **dict.fromkeys(LINK_TABLES, "link"),
    **dict.fromkeys(CHANGE_TABLES, "change"),
}


def _report(store: TableStore, done: list[TableLoad]) -> DataFrame:
    lost = lambda d: ",".join(f"{c}={n}" for c, n in d.lost.items())
    rows = [(d.table, _STAGES[d.table], d.rows, d.stored, d.status, lost(d), d.error) for d in done]
    return store.spark.createDataFrame(rows, REPORT_SCHEMA)


def table_counts(store: TableStore) -> DataFrame:
    """Rows of all 13 tables as they are visible now."""
    return count_rows(store.read_all())


def refuse_open_keys(df: DataFrame, table: str) -> None:
    """Raise if any row lacks a primary key."""
    found = null_key_count(df, TABLES[table].key).first()["null_keys"]
    if found:
        raise LoadError(f"{table}: {found} rows without primary key {TABLES[table].key}")
