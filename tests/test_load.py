"""Store, loads, report and the file-drop stream."""

import datetime as dt
import os
import random
import re

import pytest
from books import write_book
from pyspark.sql import functions as F

from catalog import queries
from partgraph.model import ORDER, SHEET_COLUMNS, TABLES
from partgraph.operators import changes, dedup, normalize, quality
from partgraph.plans import load
from partgraph.plans.store import TableStore
from partgraph.session import BOUNDS, tune
from partgraph.sources.trade import change_sheet
from partgraph.streaming.ingest import file_drop

BASE = {
    "PART_NUMBER": "P1", "PART_NAME": "engineMount", "PART_WEIGHT_KG": "1.256", "PART_PER_VEHICLE": "2",
    "CONFIGURATION": "std", "MODEL_CODE": "A01", "MODEL_NAME": "Jolion", "LINE_CODE": "L1", "LINE_NAME": "Line 1",
    "WORKSHOP_CODE": "AS", "WORKSHOP_NAME": "Assembly", "PART_PER_BOX": "10", "BOX_NUMBER": None,
    "BOX_TYPE": "non-returnable", "BOX_WEIGHT_KG": "3.5", "BOX_LENGTH_MM": "1340", "BOX_WIDTH_MM": "560",
    "BOX_HEIGHT_MM": "440", "BOX_VOL_M3": None, "BOX_AREA_M2": None, "BOX_STACKING": "2", "BOX_PER_PALLET": "4",
    "PALLET_NUMBER": "B 1-1-1", "PALLET_TYPE": "returnable", "PALLET_WEIGHT_KG": "20", "PALLET_LENGTH_MM": "1200",
    "PALLET_WIDTH_MM": "800", "PALLET_HEIGHT_MM": "900", "PALLET_VOL_M3": "0.9", "PALLET_AREA_M2": None,
    "PALLET_STACKING": "2", "SUPPLIER_NAME": "boltFactory", "LOCATION": "DE", "CITY": "Ulm", "STREET": "S",
    "BUILDING": "1", "LOCALIZATION": "no",
}


def row(**changed):
    return {**BASE, **changed}


def sheet(spark, *rows, start=0):
    values = [(*[r[c] for c in SHEET_COLUMNS], start + i) for i, r in enumerate(rows)]
    columns = ", ".join(f"{c} string" for c in SHEET_COLUMNS)
    return spark.createDataFrame(values, f"{columns}, {ORDER} bigint")


def counts(store):
    return {r["table_name"]: r["rows"] for r in load.table_counts(store).collect() if r["rows"]}


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


ROWS = (
    row(),
    row(PART_NAME="later name", SUPPLIER_NAME="other supplier", MODEL_CODE="B16", MODEL_NAME="H7"),
    row(PART_NUMBER="P2", LINE_CODE="L2", LINE_NAME="Line 2", BOX_TYPE="returnable", PART_PER_VEHICLE="n/a"),
    row(PART_NUMBER="P3", PALLET_NUMBER=None, PALLET_TYPE=None, PALLET_LENGTH_MM=None),
)
EXPECTED = {
    "supplier_data": 2, "part_data": 3, "box_data": 2, "pallet_data": 1, "model_data": 2, "workshop_data": 1,
    "line_data": 2, "part_to_box": 3, "box_to_pallet": 2, "part_to_model": 4, "part_to_line": 3,
}


def test_full_load(spark, store):
    report = load.load_sheet(store, sheet(spark, *ROWS)).collect()
    assert {r["table_name"]: r["rows"] for r in report} == EXPECTED
    assert {r["status"] for r in report} == {"loaded"}
    assert counts(store) == EXPECTED
    part = store.read("part_data").where("PART_NUMBER = 'P1'").first()
    assert (part["PART_NAME"], str(part["PART_WEIGHT_KG"])) == ("Engine Mount", "1.26")
    supplier = store.read("supplier_data").where(F.col("SUPPLIER_ID") == part["SUPPLIER_ID"]).first()
    assert supplier["SUPPLIER_NAME"] == "Bolt Factory"
    box = store.read("box_data").where("BOX_TYPE = 'non-returnable'").first()
    assert (box["BOX_NUMBER"], str(box["BOX_VOL_M3"]), str(box["BOX_AREA_M2"])) == ("A 1340-560-440", "0.33", "0.75")
    pallet = store.read("pallet_data").first()
    assert (str(pallet["PALLET_VOL_M3"]), str(pallet["PALLET_AREA_M2"])) == ("0.90", "0.96")
    assert quality.orphans(store.read_all()).isEmpty()


@pytest.mark.parametrize("truncate", [True, False])
def test_loading_twice_is_loading_once(spark, store, truncate):
    load.load_sheet(store, sheet(spark, *ROWS))
    first = {t: sorted(map(tuple, df.collect())) for t, df in store.read_all().items() if t in EXPECTED}
    load.load_sheet(store, sheet(spark, *ROWS).repartition(3), truncate=truncate)
    assert {t: sorted(map(tuple, df.collect())) for t, df in store.read_all().items() if t in EXPECTED} == first


def test_append_adds_new_and_keeps_old(spark, store):
    load.load_sheet(store, sheet(spark, *ROWS))
    more = sheet(spark, row(PART_NAME="renamed"), row(PART_NUMBER="P9"))
    report = {r["table_name"]: (r["rows"], r["status"]) for r in load.load_sheet(store, more, truncate=False).collect()}
    assert report["part_data"] == (1, "loaded")
    assert report["supplier_data"] == (0, "empty")
    names = {r["PART_NUMBER"]: r["PART_NAME"] for r in store.read("part_data").collect()}
    assert names["P1"] == "Engine Mount" and len(names) == 4


def test_empty_sheet_changes_nothing(spark, store):
    load.load_sheet(store, sheet(spark, *ROWS))
    report = load.load_sheet(store, sheet(spark, *ROWS).where("false")).collect()
    assert {r["status"] for r in report} == {"failed"}
    assert counts(store) == EXPECTED


def test_refused_table(spark, store):
    bad = (*ROWS, row(PART_NUMBER="P8", PART_WEIGHT_KG="1000"), row(PART_NUMBER="P9", LOCALIZATION="maybe", CITY="X"))
    report = {r["table_name"]: r for r in load.load_sheet(store, sheet(spark, *bad)).collect()}
    assert report["part_data"]["status"] == report["supplier_data"]["status"] == "failed"
    assert "1 rows break" in report["part_data"]["error"]
    assert report["box_data"]["status"] == "not published"
    assert counts(store) == {}  # all or nothing
    load.load_sheet(store, sheet(spark, *bad), all_or_nothing=False)
    assert "part_data" not in counts(store) and counts(store)["box_data"] == 2


def test_quarantine_keeps_every_row(spark, store):
    bad = (*ROWS, row(PART_NUMBER="P8", PART_WEIGHT_KG="1000"), row(PART_NUMBER="P9", LOCALIZATION="maybe", CITY="X"))
    report = load.load_sheet(store, sheet(spark, *bad), quarantine=True).collect()
    assert {r["status"] for r in report} == {"loaded"}
    assert counts(store)["part_data"] == 3 and counts(store)["supplier_data"] == 2
    (folder,) = store.current()["part_data"]
    aside = {tuple(r["rules"]): r for r in load.read_quarantine(store, "part_data", folder).collect()}
    assert set(aside) == {("decimal:PART_WEIGHT_KG",), ("fk:SUPPLIER_ID",)}  # P9's supplier was set aside as well
    assert '"PART_WEIGHT_KG":"1000"' in aside[("decimal:PART_WEIGHT_KG",)]["raw"]  # the sheet's cell
    assert '"PART_WEIGHT_KG":1000.0' in aside[("decimal:PART_WEIGHT_KG",)]["typed"]


def test_key_clash_refuses_the_table(spark, store):
    rows = [row(PART_NUMBER=f"P{i}") for i in range(200)]
    report = {r["table_name"]: r for r in load.load_sheet(store, sheet(spark, *rows), width=1).collect()}
    assert "wider keys" in report["part_data"]["error"]
    assert load.load_sheet(store, sheet(spark, *rows), width=20).where("status = 'failed'").isEmpty()
    assert counts(store)["part_data"] == 200


def test_load_table_and_truncate_cascade(spark, store):
    load.load_sheet(store, sheet(spark, *ROWS))
    suppliers = spark.createDataFrame([("SUP_1",), ("SUP_2",)], "SUPPLIER_ID string")
    full = suppliers.withColumns({c: F.lit(None).cast("string") for c in list(TABLES["supplier_data"].columns)[1:]})
    assert load.load_table(store, full, "supplier_data") == 2
    assert counts(store) == {**{t: n for t, n in EXPECTED.items() if not t.startswith("part_")}, "supplier_data": 2}
    assert load.load_table(store, full, "supplier_data", truncate=False) == 0
    assert load.load_table(store, full.where("false"), "supplier_data") == 0
    assert counts(store)["supplier_data"] == 2
    assert store.truncate("breakpoint_data", cascade=False) == ["breakpoint_data"]
    assert TableStore(spark, store.root + "-none").truncate("part_data") == []


def test_open_keys_and_missing_columns(spark, store):
    open_key = spark.createDataFrame([(None, "AS", "Assembly")], "WORKSHOP_ID string, WORKSHOP_CODE string, WORKSHOP_NAME string")
    with pytest.raises(load.LoadError, match="without primary key"):
        load.load_table(store, open_key, "workshop_data")
    with pytest.raises(load.LoadError, match="without primary key"):
        load.refuse_open_keys(open_key, "workshop_data")
    with pytest.raises(ValueError, match="WORKSHOP_ID"):
        load.load_table(store, open_key.drop("WORKSHOP_ID"), "workshop_data")
    assert store.read("workshop_data").isEmpty()


def test_two_publishers(spark, store):
    store.publish({"part_data": []})
    numbers = store._pointers()
    store._pointers = lambda: numbers[:-1]  # this writer has not seen the last pointer
    with pytest.raises(RuntimeError, match="published first"):
        store.publish({"part_data": ["x"]})


def test_writer_between_read_and_publish(spark, store):
    version = store.version()
    store.publish({"box_data": ["other"]})
    with pytest.raises(RuntimeError, match="published first"):
        store.publish({"part_data": ["x"]}, version)
    assert store.current() == {"box_data": ["other"]}


def test_append_refuses_a_key_that_stands_for_another_part(spark, store):
    load.load_sheet(store, sheet(spark, *[row(PART_NUMBER=f"P{i}") for i in range(3)]), width=1)
    before = counts(store)
    report = {r["table_name"]: r for r in load.load_sheet(store, sheet(spark, *[row(PART_NUMBER=f"Q{i}") for i in range(60)]), truncate=False, width=1).collect()}
    assert "wider keys" in report["part_data"]["error"] and report["part_to_box"]["status"] == "not published"
    assert counts(store) == before


def test_quarantined_parent_takes_its_links_along(spark, store):
    load.load_sheet(store, sheet(spark, *ROWS, row(PART_NUMBER="P8", PART_WEIGHT_KG="1000")), quarantine=True)
    assert quality.orphans(store.read_all()).isEmpty()
    assert counts(store)["part_data"] == 3 and counts(store)["part_to_line"] == EXPECTED["part_to_line"]


def test_reload_without_changes_keeps_history(spark, store):
    given = changes_of(spark, ("BP1", "2026-02-01", "P2", "P1", None), ("BP2", "2026-02-02", "P2", None, None))
    load.load_sheet(store, sheet(spark, *ROWS), given)
    load.load_sheet(store, sheet(spark, *ROWS))
    assert counts(store)["breakpoint_data"] == 2
    same = store.read("part_to_breakpoint").join(store.read("breakpoint_data"), "BREAKPOINT_ID").where("BREAKPOINT_NUMBER = 'BP2'")
    assert same.first()["SUPPLIER_NAME_BEFORE_CHANGE"] == "Bolt Factory"  # a blank old number is the part itself


def test_amounts_past_int_are_refused(spark, store):
    report = {r["table_name"]: r for r in load.load_sheet(store, sheet(spark, row(PART_PER_BOX="3000000000"))).collect()}
    assert "break integrity rules" in report["part_to_box"]["error"]


def test_corrections_are_stored_without_cascade(spark, store):
    load.load_sheet(store, sheet(spark, *ROWS))
    given = spark.createDataFrame([("P1", "New Name"), ("P1", "Other"), ("P9", "x")], "PART_NUMBER string, PART_NAME string")
    assert load.correct_table(store, given, "part_data", ["PART_NUMBER"]) == 3
    assert counts(store) == EXPECTED
    assert store.read("part_data").where("PART_NUMBER = 'P1'").first()["PART_NAME"] == "New Name"


def test_append_returns_rows(spark, store):
    part = spark.createDataFrame([("WSP_1", "AS", "Assembly")], "WORKSHOP_ID string, WORKSHOP_CODE string, WORKSHOP_NAME string")
    assert store.append(part, "workshop_data") == 1
    assert store.append(part.where("false"), "workshop_data") == 0
    assert store.append(part, "workshop_data") == 1
    assert store.read("workshop_data").count() == 2


def changes_of(spark, *rows):
    names = "BREAKPOINT_NUMBER string, BREAKPOINT_DATE string, PART_NUMBER string, PART_NUMBER_BEFORE_CHANGE string, LINE_NAME_BEFORE_CHANGE string"
    return spark.createDataFrame(rows, names)


def test_changes(spark, store):
    given = changes_of(
        spark,
        ("BP1", "2026-02-01", "P2", "P1", None),
        ("BP2", "2026-03-01", "P3", "P1", "Line 9"),
        ("BP3", "not a date", "P3", "P3", None),
    )
    report = load.load_sheet(store, sheet(spark, *ROWS), given, stamp="2026-01-01 12:00:00").collect()
    assert {r["table_name"]: r["rows"] for r in report if r["stage"] == "change"} == {"breakpoint_data": 3, "part_to_breakpoint": 5}
    dates = {r["BREAKPOINT_NUMBER"]: r["BREAKPOINT_DATE"] for r in store.read("breakpoint_data").collect()}
    assert dates == {"BP1": dt.datetime(2026, 2, 1), "BP2": dt.datetime(2026, 3, 1), "BP3": None}
    assert store.read("breakpoint_data").select("INPUT_DATE").distinct().first()[0] == dt.datetime(2026, 1, 1, 12)
    links = store.read("part_to_breakpoint").join(store.read("breakpoint_data"), "BREAKPOINT_ID")
    before = {
        (r["BREAKPOINT_NUMBER"], r["SUPPLIER_NAME_BEFORE_CHANGE"], r["LOCALIZATION_BEFORE_CHANGE"], r["LINE_NAME_BEFORE_CHANGE"])
        for r in links.collect()
    }
    assert before == {
        ("BP1", "Bolt Factory", "no", "Line 1"),
        ("BP2", "Bolt Factory", "no", "Line 9"),
        ("BP3", "Bolt Factory", "no", "Line 1"),
    }
    same = links.where("BREAKPOINT_NUMBER = 'BP3'").select("IS_ACTIVE_BEFORE", "IS_ACTIVE_AFTER").collect()
    assert [tuple(r) for r in same] == [(True, True)]


def test_change_without_number_fails_both_change_tables(spark, store):
    given = changes_of(spark, ("BP1", "2026-02-01", "P2", "P1", None), (None, "2026-02-01", "P2", "P1", None))
    report = load.load_sheet(store, sheet(spark, *ROWS), given, all_or_nothing=False).collect()
    assert {(r["rows"], r["status"]) for r in report if r["stage"] == "change"} == {(0, "failed")}
    assert "breakpoint_data" not in counts(store) and counts(store)["part_data"] == 3


def write_csv(path, rows):
    lines = [",".join(SHEET_COLUMNS), *[",".join(r[c] or "" for c in SHEET_COLUMNS) for r in rows]]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_file_drop_loads_each_file_once(spark, store, tmp_path):
    drop, checkpoint = tmp_path / "drop", str(tmp_path / "checkpoint")
    drop.mkdir()
    write_csv(drop / "one.csv", ROWS)
    write_csv(drop / "ignored.txt", [row(PART_NUMBER="NO")])
    run = lambda: file_drop(store, str(drop), checkpoint, glob="*.csv", max_files=1).awaitTermination()
    run()
    assert counts(store) == EXPECTED
    run()
    assert counts(store) == EXPECTED
    write_csv(drop / "two.csv", [row(PART_NAME="renamed"), row(PART_NUMBER="P9")])
    write_csv(drop / "three.csv", [row(PART_NUMBER="P10")])
    run()
    assert counts(store)["part_data"] == 5
    assert store.read("part_data").where("PART_NUMBER = 'P1'").first()["PART_NAME"] == "Engine Mount"


LINES = "LINE_ID string, LINE_CODE string, LINE_NAME string, WORKSHOP_ID string"


def test_folders_stay_bounded_over_many_batches(spark, store, tmp_path):
    for i in range(20):
        store.append(spark.createDataFrame([(f"L{i}", f"c{i}", f"n{i}", "w")], LINES), "line_data")
        store.merge_small(4)
        store.remove_old(2)
        assert len(list((tmp_path / "store" / "line_data").iterdir())) <= 2 * 4
        assert len(list((tmp_path / "store" / "_pointer").glob("0*.json"))) <= 2
    assert store.read("line_data").distinct().count() == 20


def test_stream_merges_folders(spark, store, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for i in range(2):
        write_csv(drop / f"{i}.csv", [row(PART_NUMBER=f"N{i}")])
    file_drop(store, str(drop), str(tmp_path / "checkpoint"), glob="*.csv", max_files=1, merge_from=2, keep_versions=1).awaitTermination()
    assert counts(store)["part_data"] == 2 and len(list((tmp_path / "store" / "part_data").iterdir())) == 1


def test_readers_of_the_version_before_go_on(spark, store):
    for i in range(3):
        store.append(spark.createDataFrame([(f"L{i}", f"c{i}", f"n{i}", "w")], LINES), "line_data")
    reader = store.read("line_data")
    assert store.merge_small(at_least=5) == {} and store.merge_small(at_least=3) == {"line_data": 3}
    assert store.remove_old(2) == 0 and reader.count() == 3  # all three folders are named by the version before
    assert len(store.current()["line_data"]) == 1 and store.read("line_data").count() == 3
    assert store.remove_old(1) == 3 and store.remove_old(1) == 0
    assert sorted(r["LINE_ID"] for r in store.read("line_data").collect()) == ["L0", "L1", "L2"]
    version = store.version()
    store._fs.create(store._path(store._pointer(version + 1)), False).close()  # a lost driver's
    assert store.remove_old(1) == 0 and store.read("line_data").count() == 3


def test_a_merge_that_comes_second_leaves_no_folder(spark, store, tmp_path, monkeypatch):
    one = lambda i: spark.createDataFrame([(f"L{i}", f"c{i}", f"n{i}", "w")], LINES)
    for i in range(2):
        store.append(one(i), "line_data")
    write = store.write

    def beaten(*args):
        found = write(*args)
        monkeypatch.setattr(store, "write", write)
        store.append(one(9), "line_data")
        return found

    monkeypatch.setattr(store, "write", beaten)
    with pytest.raises(RuntimeError, match="another load"):
        store.merge_small(at_least=2)
    assert store.read("line_data").count() == 3 and len(list((tmp_path / "store" / "line_data").iterdir())) == 3


def test_workbook_drop(spark, store, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    write_book(drop / "parts.xlsx", [list(SHEET_COLUMNS), *[[r[c] for c in SHEET_COLUMNS] for r in ROWS]])
    archive = str(tmp_path / "archive")
    options = {"fmt": "xlsx", "glob": "parts.xlsx", "clean_source": "archive", "archive": archive}
    file_drop(store, str(drop), str(tmp_path / "checkpoint"), **options).awaitTermination()
    assert counts(store) == EXPECTED


def test_failed_batch_is_reported_and_retried(spark, store, tmp_path):
    drop, checkpoint = tmp_path / "drop", str(tmp_path / "checkpoint")
    drop.mkdir()
    write_csv(drop / "bad.csv", [row(PART_WEIGHT_KG="-1")])
    for _ in range(2):
        with pytest.raises(Exception, match="batch not loaded"):
            file_drop(store, str(drop), checkpoint).awaitTermination()
    assert counts(store) == {}


CHANGE = "BREAKPOINT_NUMBER string, BREAKPOINT_DATE string, PART_NUMBER string, PART_NUMBER_BEFORE_CHANGE string, SUPPLIER_NAME_BEFORE_CHANGE string"


def change_rows(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], CHANGE)


def test_report_names_lost_cells(spark, store):
    rows = (*ROWS, row(PART_NUMBER="P4", PART_PER_BOX="ten", PART_WEIGHT_KG="heavy", PART_PER_VEHICLE="1.5"))
    report = load.load_sheet(store, sheet(spark, *rows))
    found = {r["table_name"]: r["lost_cells"] for r in report.collect() if r["lost_cells"]}
    assert found == {"part_data": "PART_WEIGHT_KG=1", "part_to_box": "PART_PER_BOX=1", "part_to_model": "PART_PER_VEHICLE=2"}
    summary = load.load_summary(report).first()
    assert summary["success"] and summary["lost_cells"] == 4 and summary["rows"] == summary["stored"] > 0


def test_rows_are_verified(spark, store, monkeypatch):
    original = store.read_folders
    monkeypatch.setattr(store, "read_folders", lambda t, f: original(t, f).where("MODEL_CODE <> 'B16'") if t == "model_data" and f else original(t, f))
    report = load.load_sheet(store, sheet(spark, *ROWS))
    by_table = {r["table_name"]: r for r in report.collect()}
    assert by_table["model_data"]["error"] == "2 rows written, 1 found"
    assert not load.load_summary(report).first()["success"] and store.current() == {}


def test_reload_without_the_parts_of_kept_changes(spark, store):
    given = change_rows(spark, ("B1", "2026-01-01", "P2", "P1"))
    load.load_sheet(store, sheet(spark, *ROWS), given)
    before = store.current()
    report = {r["table_name"]: r for r in load.load_sheet(store, sheet(spark, ROWS[0])).collect()}
    assert report["part_to_breakpoint"]["error"] == "1 kept rows refer to parts that are gone"
    assert store.current() == before
    load.load_sheet(store, sheet(spark, *ROWS[:3]))
    assert counts(store)["part_to_breakpoint"] == 2


def folders(store):
    fs, path = store._fs, store._path(store.root)
    tables = [s.getPath() for s in fs.listStatus(path) if not s.getPath().getName().startswith("_")]
    return {s.getPath().toString() for t in tables for s in fs.listStatus(t)}


def test_load_changes_long_and_short(spark, store):
    load.load_sheet(store, sheet(spark, *ROWS))
    base = store.current()
    long = change_rows(spark, ("1", "2026-01-01 10:00:00", "P2", "P1"), ("2", "2026-01-02", "P3", "P2"))
    report = load.load_changes(store, long, stamp="2026-01-01")
    assert {r["table_name"]: (r["rows"], r["stored"], r["status"]) for r in report.collect()} == {
        "breakpoint_data": (2, 2, "loaded"), "part_to_breakpoint": (4, 4, "loaded"),
    }
    rows = lambda: {t: sorted(map(str, store.read(t).collect())) for t in ("breakpoint_data", "part_to_breakpoint")}
    first = rows()
    ids = {r["PART_NUMBER"]: r["PART_ID"] for r in store.read("part_data").collect()}
    store.publish(base)
    day = dt.datetime
    short = [(day(2026, 1, 2), ids["P2"], ids["P3"]), (day(2026, 1, 1, 10), ids["P1"], ids["P2"]), (None, ids["P1"], ids["P2"])]
    short = spark.createDataFrame(short * 2, "breakpoint_date timestamp, old_part_id string, new_part_id string")
    load.load_changes(store, short, stamp="2026-01-01")
    assert rows() == first
    load.load_changes(store, long, stamp="2026-01-01")  # known keys stay
    assert rows() == first


def test_load_changes_is_all_or_nothing(spark, store):
    load.load_sheet(store, sheet(spark, *ROWS))
    before, on_disk = store.current(), folders(store)
    report = load.load_changes(store, change_rows(spark, ("B1", "2026-01-01", "P2", "unknown part")))
    errors = {r["table_name"]: r["error"] for r in report.collect()}
    assert errors == {"breakpoint_data": "other change table failed", "part_to_breakpoint": "part_to_breakpoint: 1 rows break integrity rules"}
    bad_date = load.load_changes(store, change_rows(spark, ("B1", "some day", "P2", "P1")))
    assert "break integrity rules" in bad_date.where("table_name = 'breakpoint_data'").first()["error"]
    gone = spark.createDataFrame([(dt.datetime(2026, 1, 1), "PRT_none", "PRT_none")], "breakpoint_date timestamp, old_part_id string, new_part_id string")
    assert {r["status"] for r in load.load_changes(store, gone).collect()} == {"failed"}
    assert store.current() == before and folders(store) == on_disk
    aside = load.load_changes(store, change_rows(spark, ("B1", "some day", "P2", "P1"), ("B2", "2026-01-01", "P2", "P1")), quarantine=True)
    assert {r["table_name"]: r["rows"] for r in aside.collect()} == {"breakpoint_data": 1, "part_to_breakpoint": 2}
    (folder,) = store.current()["breakpoint_data"]
    (kept,) = load.read_quarantine(store, "breakpoint_data", folder).collect()
    assert kept["rules"] == ["unreadable:BREAKPOINT_DATE"] and '"BREAKPOINT_DATE":"some day"' in kept["raw"]


def test_lost_race_leaves_no_folders(spark, store, monkeypatch):
    """A second writer between the look at the pointers and the create: the first one fails and cleans up."""
    load.load_sheet(store, sheet(spark, *ROWS))
    before, on_disk, numbers = store.current(), folders(store), store._pointers()
    other = TableStore(spark, store.root)
    other.publish(before)
    monkeypatch.setattr(store, "_pointers", lambda: numbers)
    with pytest.raises(RuntimeError, match="another load"):
        load.load_sheet(store, sheet(spark, *ROWS))
    with pytest.raises(RuntimeError, match="another load"):
        store.append(other.read("line_data"), "line_data")
    assert folders(store) == on_disk and other.version() == numbers[-1] + 1


def test_half_written_pointer_is_passed_over(spark, store):
    store.publish({"line_data": []})
    half = store._fs.create(store._path(f"{store.root}/_pointer/{2:012d}.json"), False)
    half.write(bytearray(b'{"line_'))
    half.close()
    assert store.current() == {"line_data": []}
    store.publish({"box_data": []})
    assert store.current() == {"box_data": []} and store.version() == 3


def test_file_drop_takes_the_older_file_first(spark, store, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for name, second, part in (("a.csv", 30, "lateName"), ("b.csv", 10, "firstName"), ("c.csv", 20, "secondName")):
        extra = [row(PART_NUMBER=f"{name}{i}") for i in range(200 if name == "a.csv" else 1)]
        write_csv(drop / name, [row(PART_NAME=part), *extra])
        os.utime(drop / name, (1_700_000_000 + second,) * 2)
    file_drop(store, str(drop), str(tmp_path / "checkpoint")).awaitTermination()
    assert store.read("part_data").where("PART_NUMBER = 'P1'").first()["PART_NAME"] == "First Name"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_tables_of_placed_rows_are_the_same_and_shuffle_less(spark):
    """Places repeat, rows of one place differ, cells are open and spelt in several ways."""
    random.seed(3)
    some = lambda *values: random.choice(values)
    rows = [
        row(
            PART_NUMBER=some("P1", "P1", "P2", "P3", None), PART_NAME=some("engineMount", "b", None), PART_WEIGHT_KG=some("1", "x", None),
            SUPPLIER_NAME=some("a b", "aB", None), MODEL_CODE=some("A01", "B16", None), MODEL_NAME=some("H3", None), CONFIGURATION=some("s", "t"),
            BOX_LENGTH_MM=some("0200", "200", None), PART_PER_BOX=some("1", "2"), PART_PER_VEHICLE=some("1", "n/a", None), LINE_CODE=some("L1", None),
        )
        for _ in range(400)
    ]
    df = sheet(spark, *rows).withColumn(ORDER, F.col(ORDER) % 150).repartition(5)
    fewer = set()
    for table in EXPECTED:
        slow, fast = (normalize.build_table(df, table, True, placed=placed) for placed in (False, True))
        assert slow.schema == fast.schema and sorted(map(str, slow.collect())) == sorted(map(str, fast.collect()))
        if exchanges(fast) < exchanges(slow):
            fewer.add(table)
    assert fewer == {"part_data"}  # its distinct rows are not shuffled
    plan = normalize.build_table(df, "part_to_model", True, placed=True)._jdf.queryExecution().executedPlan().toString()
    assert not any("CONFIGURATION" in keys for keys in re.findall(r"keys=\[([^\]]*)\]", plan))  # one row per link and task is shuffled


def test_open_places_do_not_beat_equal_rows(spark, store):
    """An open place counts only for rows that have no other; the load looks for open places itself."""
    rows = sheet(spark, row(PART_NAME="a", PART_NUMBER="P1"), row(PART_NAME="b", PART_NUMBER="P1"), row(PART_NAME="a", PART_NUMBER="P1"))
    opened = rows.withColumn(ORDER, F.when(F.col(ORDER) < 2, 5 - F.col(ORDER)))
    load.load_sheet(store, opened)
    assert store.read("part_data").first()["PART_NAME"] == "B"
    assert dedup.all_placed(rows) and not dedup.all_placed(opened) and not dedup.all_placed(rows.drop(ORDER))


def test_written_changes_read_the_same(spark, tmp_path):
    given = changes_of(spark, ("B1", "2026-02-01 10:11:12.123456", "P2", "P1", None), ("B2", "1700-01-01", "P2", None, "x"), (None, "no", "P3", "P3", None))
    typed = changes.type_changes(given.withColumn("LOCALIZATION_BEFORE_CHANGE", F.lit(None)))
    kept = changes.write_changes(typed, str(tmp_path / "changes"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, typed.collect()))
    assert exchanges(kept) == 0 and kept.columns == typed.columns


def test_changes_are_worked_out_once(spark, store, monkeypatch):
    read = []
    monkeypatch.setattr(load, "breakpoint_tables", lambda rows, *a: read.append(rows.inputFiles()) or changes.breakpoint_tables(rows, *a))
    given = changes_of(spark, ("BP1", "2026-02-01", "P2", "P1", None))
    report = load.load_sheet(store, sheet(spark, *ROWS), given).where("stage = 'change'").collect()
    assert {(r["table_name"], r["rows"]) for r in report} == {("breakpoint_data", 1), ("part_to_breakpoint", 2)}
    assert len(read) == 1 and all("/changes-" in f for f in read[0]) and read[0]
    assert not os.path.exists(read[0][0].removeprefix("file://"))  # gone after the load
    broken = given.withColumn("BREAKPOINT_NUMBER", F.raise_error(F.concat(F.lit("bad "), "PART_NUMBER")).cast("string"))
    failed = load.load_sheet(store, sheet(spark, *ROWS), broken).where("stage = 'change'").collect()
    assert {r["status"] for r in failed} == {"failed"} and len(failed) == 2 and counts(store)["breakpoint_data"] == 1


def test_change_sheet_of_odd_orders(spark, tmp_path):
    """Lines that repeat, have no number or no part: first and last part by line, then part."""
    random.seed(5)
    lines = [(random.randint(0, 40), random.choice([1, 1, 2, 3, None]), random.choice([*range(6), None])) for _ in range(300)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(i, dt.datetime(2026, 1, 1)) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    expected = set()
    for key in range(40):
        own = [(n, p) for k, n, p in lines if k == key and n is not None]
        if own:
            old = [p for n, p in own if n == min(x for x, _ in own) and p is not None]
            new = [p for n, p in own if n == max(x for x, _ in own) and p is not None]
            if old and new and min(old) != max(new):
                expected.add((f"BP{key}", f"P-{min(old)}", f"P-{max(new)}"))
    found = change_sheet(spark, str(tmp_path))
    assert {(r["BREAKPOINT_NUMBER"], r["PART_NUMBER_BEFORE_CHANGE"], r["PART_NUMBER"]) for r in found.collect()} == expected and expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate ") == 1  # lines are shuffled once


def test_staged_rows_are_read_in_small_splits(spark, tmp_path):
    names = list(BOUNDS)
    kept = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "128m")
        tune(spark)
        assert [spark.conf.get(n) for n in names] == [f"{most}b" for most in BOUNDS.values()]
        for n in names:
            spark.conf.set(n, "1m")  # less than the bound stays
        tune(spark)
        assert [spark.conf.get(n) for n in names] == ["1m", "1m"]
    finally:
        for n, value in kept.items():
            spark.conf.set(n, value)
    text = F.concat(*[F.sha2(F.concat(F.lit(i), F.col("id")), 256) for i in range(4)])
    wide = spark.range(200_000).coalesce(1).select(F.col("id").alias(ORDER), text.alias("PART_NUMBER"))
    staged, _ = load.prepare_sheet(wide, str(tmp_path / "sheet"))
    sizes = [len(rows) for rows in staged.select(ORDER).rdd.glom().collect()]
    assert max(sizes) < 150_000 and sum(sizes) == 200_000  # 50 MB of text in one file
    assert staged.agg(F.sum(F.xxhash64(F.col(ORDER), F.col("PART_NUMBER")) % 1000)).first() == wide.agg(
        F.sum(F.xxhash64(F.col(ORDER), F.col("PART_NUMBER")) % 1000)
    ).first()


def broken_file(spark, path, rows):
    """A written table whose file can't be read any more."""
    rows.coalesce(1).write.parquet(str(path))
    kept = spark.read.parquet(str(path))
    next(path.glob("*.parquet")).write_bytes(b"lost")
    return kept


def test_changes_that_fail_to_run_are_no_report(spark, store, tmp_path):
    given = changes_of(spark, ("BP1", "2026-02-01", "P2", "P1", None))
    lost = broken_file(spark, tmp_path / "given", given)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        load.load_sheet(store, sheet(spark, *ROWS), lost)
    assert store.current() == {} and folders(store) == set()
    load.load_sheet(store, sheet(spark, *ROWS))
    kept = folders(store)
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        load.load_changes(store, lost)
    assert folders(store) == kept


@pytest.fixture
def refused(spark, monkeypatch, tmp_path):
    """A folder whose sheet a load refuses."""
    monkeypatch.setattr(queries, "part_sheet", lambda *_: sheet(spark, *ROWS, row(PART_NUMBER="P9", PART_WEIGHT_KG="-1")))
    monkeypatch.setattr(queries, "change_sheet", lambda *_: change_rows(spark, ("B1", "2026-01-01", "P2", "P1")))
    return str(tmp_path)


def test_duplicate_keys_of_a_refused_load(spark, refused):
    with pytest.raises(load.LoadError, match="not loaded: .*part_data: 1 rows break"):
        queries.QUERIES["check_pk_unique"](spark, refused)


def test_a_table_that_fails_to_run_is_no_report(spark, store, monkeypatch):
    write = store.write

    def full_disk(df, table, *rest):
        if table == "part_to_box":
            raise OSError("No space left on device")
        return write(df, table, *rest)

    monkeypatch.setattr(store, "write", full_disk)
    with pytest.raises(OSError, match="No space left"):
        load.load_sheet(store, sheet(spark, *ROWS))
    assert store.current() == {} and folders(store) == set()


@pytest.mark.parametrize("name", ["find_by_city", "find_by_line_code", "find_by_line_name", "find_by_location", "part_history"])
def test_lookups_of_a_refused_load(spark, refused, name):
    with pytest.raises(load.LoadError, match="not loaded: .*part_data: 1 rows break"):
        queries.QUERIES[name](spark, refused)


def test_reloads_write_the_sheet_once(spark, monkeypatch, tmp_path):
    written, loads = [], []
    write, run = load.write_staged, load.load_sheet
    monkeypatch.setattr(load, "write_staged", lambda df, path: written.append(path) or write(df, path))
    monkeypatch.setattr(load, "load_sheet", lambda store, sheet, *a, **o: loads.append(sheet.count()) or run(store, sheet, *a, **o))
    rows = [row(PART_NUMBER=f"P-{i}", PART_NAME=f"part {i % 4}") for i in range(1, 7)]
    monkeypatch.setattr(queries, "part_sheet", lambda *_: sheet(spark, *rows))
    monkeypatch.setattr(queries, "change_sheet", lambda *_: change_rows(spark, ("B1", "2026-01-01", "P-2", "P-1"), ("B2", "2026-01-02", "P-4", "P-2")))
    found = {(r["table_name"], r["error"]): r["rows"] for r in queries.QUERIES["reload_keeps_history"](spark, str(tmp_path)).collect()}
    assert loads == [6, 6, 3] and len(written) == 1 and not os.path.exists(written[0].removeprefix("file:"))
    assert found["part_to_breakpoint", "1 kept rows refer to parts that are gone"] == 0
    assert (found["part_data", None], found["part_to_line", None], found["part_to_breakpoint", None], len(found)) == (6, 6, 4, 14)
