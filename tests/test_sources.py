"""Workbooks, CSV/JSON/TSV and the JDBC options."""

import os
import random
from pathlib import Path

import pytest
from books import write_book
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import queries
from partgraph.model import ORDER, SHEET_SCHEMA
from partgraph.operators import recipe
from partgraph.session import stage
from partgraph.sources import jdbc, sheet, trade, workbook

ABC = T.StructType([T.StructField(c, T.StringType()) for c in ("A", "B", "C")])


def test_workbook_cells(spark, tmp_path):
    rows = [
        ["c", " A ", None, "b"],
        [1, "text", "unused", 2.5],
        [0.33000000000000002, "rich text", None, True],
        [None, None, None, None],
        [1200.0, "inline:in <line>", None, (45658, 1)],
        [None, "001", None, (45658.75, 2)],
    ]
    write_book(tmp_path / "one.xlsx", rows)
    found = workbook.read_workbooks(spark, str(tmp_path), ABC).orderBy(ORDER).drop(ORDER).collect()
    assert [tuple(r) for r in found] == [
        ("text", "2.5", "1"),
        ("rich text", "true", "0.33"),
        ("in <line>", "2025-01-01 00:00:00", "1200"),
        ("001", "2025-01-01 18:00:00", None),
    ]


def test_number_cells_of_integer_columns_lose_their_fraction(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("PART_PER_BOX", "BOX_STACKING", "PART_WEIGHT_KG")])
    write_book(tmp_path / "n.xlsx", [schema.fieldNames(), [12.5, "12.5", 12.5], [-3.99, "7", "1.5"], [1e300, 2.0, 0.1]])
    rows = workbook.read_workbooks(spark, str(tmp_path), schema).orderBy(ORDER)
    assert [tuple(r) for r in rows.drop(ORDER).collect()] == [("12", "12.5", "12.5"), ("-3", "7", "1.5"), ("1e+300", "2", "0.1")]
    typed = recipe.apply_recipe(rows, recipe.sheet_recipe())
    assert [tuple(r) for r in typed.drop(ORDER).collect()] == [(12, None, 12.5), (-3, 7, 1.5), (None, 2, 0.1)]


def test_many_workbooks_keep_row_order_and_files_apart(spark, tmp_path):
    for book in range(5):
        write_book(tmp_path / f"b{book}.xlsx", [["A", "B", "C"], *[[f"b{book}", i, None] for i in range(40)]])
    df = workbook.read_workbooks(spark, str(tmp_path), ABC)
    assert df.select(ORDER).distinct().count() == 200
    places = df.groupBy("A").agg(F.max(ORDER) - F.min(ORDER)).collect()
    assert all(r[1] == 39 for r in places)
    ordered = [int(r["B"]) for r in df.where("A = 'b3'").orderBy(ORDER).collect()]
    assert ordered == list(range(40))


def test_workbook_without_a_column_is_refused(spark, tmp_path):
    write_book(tmp_path / "bad.xlsx", [["A", "B"], [1, 2]])
    with pytest.raises(Exception, match="missing columns \\['C'\\]"):
        workbook.read_workbooks(spark, str(tmp_path), ABC).collect()


def test_csv_goes_by_header(spark, tmp_path):
    (tmp_path / "one.csv").write_text("b,a,PART_per_BOX\n1,2,3\n,5,6\n", encoding="utf-8")
    df = sheet.read_sheet(spark, str(tmp_path))
    assert df.columns == ["B", "A", "PART_PER_BOX", ORDER]
    assert [tuple(r)[:3] for r in df.orderBy(ORDER).collect()] == [("1", "2", "3"), (None, "5", "6")]
    (tmp_path / "two.csv").write_text("a,b,PART_per_BOX\n1,2,3\n", encoding="utf-8")
    with pytest.raises(Exception, match="CSV header does not conform"):
        sheet.read_sheet(spark, str(tmp_path)).collect()


def test_csv_rows_keep_file_order_over_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("A\n" + "\n".join(str(i) for i in range(20_000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = sheet.read_sheet(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        assert [int(r["A"]) for r in df.orderBy(ORDER).collect()] == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("form", ["tsv", "json"])
def test_staged_forms_keep_nulls_and_odd_text(spark, tmp_path, form):
    rows = [(None, "tab\there", 1, 0.33), ("a\\N", 'quote "x"', None, None), ("", "line\nbreak", -5, 1e30), ("№", "«a»", 0, 2.5)]
    df = spark.createDataFrame(rows, "a string, b string, n bigint, x double")
    write, read = (sheet.write_tsv, sheet.read_tsv) if form == "tsv" else (sheet.write_json, sheet.read_json)
    write(df, str(tmp_path / form))
    found = read(spark, str(tmp_path / form), df.schema).collect()
    assert sorted(map(str, found)) == sorted(map(str, df.collect()))


def test_tsv_form(spark, tmp_path):
    sheet.write_tsv(spark.createDataFrame([("a", None, "c")], "a string, b string, c string").coalesce(1), str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("part-*")
    assert part.read_text() == "a\t\\N\tc\n"


def test_jdbc_needs_bounds(spark):
    with pytest.raises(ValueError, match="bounds"):
        jdbc.read_table(spark, "jdbc:none:x", "t", partition_column="id")


def test_jdbc_write_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jdbc, "scratch", lambda _, name: str(tmp_path / name))
    with pytest.raises(Exception, match="(?i)driver"):
        jdbc.write_table(spark.range(5).toDF("n"), "jdbc:none:x", "t", connections=2)
    assert not list(tmp_path.iterdir())


def test_sheet_joins_only_what_is_asked():
    assert trade.needed_tables(["MODEL_CODE", "LINE_CODE", "PART_NUMBER"]) == []
    assert trade.needed_tables(["LOCALIZATION"]) == ["supplier", "nation", "region"]
    assert trade.needed_tables(["CONFIGURATION", "PART_NAME"]) == ["orders", "part"]


def dropped(folder, name, rows, second):
    """A CSV file of A, B rows, last changed at a second of its own."""
    path = folder / name
    path.write_text("A,B\n" + "".join(f"{a},{b}\n" for a, b in rows), encoding="utf-8")
    os.utime(path, (1_700_000_000 + second,) * 2)


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_order_across_files(spark, tmp_path, split):
    """Older files come first whatever their names and sizes, and however Spark packs them."""
    dropped(tmp_path, "a.csv", [("k", "late"), ("x", "1")], 30)
    dropped(tmp_path, "b.csv", [(f"fill{i}", i) for i in range(5000)] + [("k", "first")], 10)
    dropped(tmp_path, "c.csv", [("k", "second"), ("k", "third")], 20)
    dropped(tmp_path, "d.csv", [("k", "tie by path")], 20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        df = sheet.read_sheet(spark, str(tmp_path))
        expected = ["first", "second", "third", "tie by path", "late"]
        assert [r["B"] for r in df.where("A = 'k'").orderBy(ORDER).collect()] == expected
        numbered = sheet.number_order(stage(df, "numbered"))
        assert dict(numbered.dtypes)[ORDER] == "bigint" and numbered.select(ORDER).distinct().count() == 5006
        assert [r["B"] for r in numbered.where("A = 'k'").orderBy(ORDER).collect()] == expected
        assert [r["B"] for r in numbered.where("A like 'fill%'").orderBy(ORDER).collect()] == [str(i) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_order_across_workbooks(spark, tmp_path):
    for name, second, value in (("a.xlsx", 30, "late"), ("b.xlsx", 10, "first"), ("c.xlsx", 20, "second")):
        write_book(tmp_path / name, [["A", "B", "C"], [value, 1, 2], [value + " next", 1, 2]])
        os.utime(tmp_path / name, (1_700_000_000 + second,) * 2)
    found = workbook.read_workbooks(spark, str(tmp_path), ABC).orderBy(ORDER).collect()
    assert [r["A"] for r in found] == ["first", "first next", "second", "second next", "late", "late next"]


def _bytes(folder):
    return sum(p.stat().st_size for p in Path(folder).iterdir() if p.name.startswith("part-"))


def test_staged_text_is_packed(spark, tmp_path):
    """A staged sheet takes less than half of its text, and comes back whole."""
    rows = spark.range(5000).selectExpr("'P-' || cast(id as string) as PART_NUMBER", "cast(null as string) as BOX_NUMBER", "'a \"b\", c' as PART_NAME", "id as PART_PER_BOX")
    lengths = rows.selectExpr("sum(length(PART_NUMBER) + length(PART_NAME) + length(PART_PER_BOX) + 5)").first()[0]
    sheet.write_json(rows, f"{tmp_path}/json")
    sheet.write_tsv(rows, f"{tmp_path}/tsv", packed=True)
    sheet.write_csv(rows, f"{tmp_path}/csv")
    for name in ("json", "tsv", "csv"):
        assert _bytes(tmp_path / name) < lengths / 2
    expected = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, sheet.read_json(spark, f"{tmp_path}/json", rows.schema).collect())) == expected
    assert sorted(map(tuple, sheet.read_tsv(spark, f"{tmp_path}/tsv", rows.schema).collect())) == expected
    text = [tuple(v if v is None else str(v) for v in r) for r in expected]
    assert sorted(map(tuple, sheet.read_sheet(spark, f"{tmp_path}/csv").drop("_ORD").collect())) == text
    plain = f"{tmp_path}/plain"
    sheet.write_tsv(rows, plain)
    assert spark.read.text(plain).count() == 5000 and any(Path(plain).glob("*.txt"))


def order_tables(spark, folder, lines=400):
    """Small order tables; some lines have no order, part, supplier or number, some come twice."""
    pick = random.Random(3)
    some = lambda n: pick.choice([None, *range(1, n)])
    rows = [(pick.randrange(1, 90), some(40), some(9), some(8), float(pick.randrange(1, 50)), pick.choice("RNA"), pick.choice("FO")) for _ in range(lines)]
    given = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string", rows + rows[:20]),
        "orders": ("o_orderkey long, o_orderpriority string", [(i, f"{i % 5}-P") for i in range(1, 80)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_size int", [(i, f"green part {i}", f"Brand#{i % 5}", i % 50) for i in range(1, 38)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(i, f"Supplier {i}", i % 4) for i in range(1, 8)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"NATION_{i}", i % 2) for i in range(4)]),
        "region": ("r_regionkey int, r_name string", [(0, "EUROPE"), (1, "ASIA")]),
    }
    for name, (schema, values) in given.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ordered_sheet_sorts_narrow_rows(spark, tmp_path):
    folder = order_tables(spark, tmp_path)
    ordered = trade.part_sheet(spark, folder, ordered=True)
    found = [r[ORDER] for r in ordered.collect()]
    assert found == sorted(found, key=lambda o: (o is not None, o)) and len(set(found)) > 100
    assert sorted(map(repr, ordered.collect())) == sorted(map(repr, trade.part_sheet(spark, folder).collect()))
    plan = ordered._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("Sort"):
        plan = plan.children().head()
    assert plan.output().size() <= 16  # the sheet's text has 38


def test_dropped_files_are_packed(spark, tmp_path, monkeypatch):
    drops = []

    class Ended:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(queries, "file_drop", lambda store, drop, *_, glob: drops.append((drop, glob)) or Ended())
    queries.QUERIES["stream_ingest"](spark, order_tables(spark, tmp_path))
    drop, glob = drops[0]
    names = sorted(n for n in os.listdir(drop.removeprefix("file:")) if n.startswith("part-"))
    assert names and glob == "*.csv.gz" and all(n.endswith(".csv.gz") for n in names)
    read = sheet.read_sheet(spark, drop, schema=SHEET_SCHEMA, pathGlobFilter=glob).orderBy(ORDER).drop(ORDER).collect()
    assert sorted(map(repr, read)) == sorted(map(repr, trade.part_sheet(spark, str(tmp_path)).drop(ORDER).collect()))
