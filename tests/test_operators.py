"""Guards, dedup, rules, edits and ordered operators on small frames, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from partgraph.functions import casts
from partgraph.model import ENTITY_COLUMNS, ORDER, SHEET_SCHEMA, TABLES, dependants
from partgraph.operators import changes, dedup, edits, normalize, ordered, overview, project, quality, recipe


def test_required_columns(spark):
    df = spark.createDataFrame([("a",)], "PART_NUMBER string")
    project.require_columns(df, ["PART_NUMBER"])
    with pytest.raises(ValueError, match=r"\['PART_NAME'\].*PART_NUMBER"):
        project.require_columns(df, ["PART_NUMBER", "PART_NAME"])
    with pytest.raises(ValueError, match="supplier"):
        project.project_entity(df, "supplier")


def test_empty_sheet_gives_typed_empty_entities(spark):
    frames = project.split_sheet(spark.createDataFrame([], SHEET_SCHEMA))
    assert len(frames) == 8
    for entity, columns in ENTITY_COLUMNS.items():
        assert frames[entity].columns == list(columns) == project.empty_entity(spark, entity).columns
        assert frames[entity].isEmpty()
    assert not project.is_complete(frames)


def test_is_complete(spark):
    sheet = spark.createDataFrame([tuple("x" for _ in SHEET_SCHEMA)], SHEET_SCHEMA)
    frames = project.split_sheet(sheet)
    assert project.is_complete(frames)
    frames.pop("line")
    assert not project.is_complete(frames)


def test_recipe(spark):
    df = spark.createDataFrame([("1", "x"), ("y", None), (None, "z")], "A string, B string")
    rules = {"A": casts.to_int64, "B": F.upper, "C": F.upper}
    assert [tuple(r) for r in recipe.apply_recipe(df, rules).collect()] == [(1, "X"), (None, None), (None, "Z")]
    stats = {r["column_name"]: tuple(r)[1:] for r in recipe.recipe_stats(df, rules).collect()}
    assert stats == {"A": ("applied", 1, 1), "B": ("applied", 2, 0), "C": ("skipped", 0, 0)}


def test_keep_first_matches_brute_force(spark):
    random.seed(7)
    rows = [
        (random.choice(["hot", "hot", "a", "b", None]), random.choice([None, "p", "q"]), random.randint(0, 5), i % 90)
        for i in range(600)
    ]
    best: dict = {}
    for key, text, number, place in rows:
        rank = (place, text is not None, text or "", number)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, (key, text, number))
    df = spark.createDataFrame(rows, f"k string, t string, n int, {ORDER} bigint")
    for parts in (1, 7):
        found = dedup.keep_first(df.repartition(parts), ["k"], ["t", "n"]).collect()
        assert sorted(map(str, (tuple(r) for r in found))) == sorted(str(v[1]) for v in best.values())


def test_key_filters(spark):
    df = spark.createDataFrame([("PRT_a1", "x"), (None, "x"), ("12", None)], "k string, v string")
    assert dedup.drop_null_keys(df, ["k", "v"]).count() == 1
    assert [r["k"] for r in dedup.drop_bad_keys(df, ["k"]).collect()] == ["PRT_a1"]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_are_dense_and_ordered(spark, parts):
    random.seed(parts)
    rows = random.sample(range(10_000), 500)
    df = spark.createDataFrame([(r, r % 7) for r in rows], "a int, b int")
    found = ordered.number_rows(df, ["b", "a"], "n", parts).collect()
    expected = sorted(rows, key=lambda r: (r % 7, r))
    assert [r["a"] for r in sorted(found, key=lambda r: r["n"])] == expected
    assert sorted(r["n"] for r in found) == list(range(1, 501))


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_next_value_across_ranges(spark, parts):
    """A hot key spans many ranges; small keys, single rows and null values lie between."""
    random.seed(parts)
    rows = [(random.choice(["hot"] * 6 + list("abcdefgh")), i, random.choice([None, i])) for i in range(400)]
    expected = {}
    for k in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == k)
        expected |= {(k, a[1]): b[2] for a, b in zip(own, own[1:], strict=False)} | {(k, own[-1][1]): None}
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    found = ordered.next_value(df, "k", ["i"], "v", "nxt", parts).collect()
    assert {(r["k"], r["i"]): r["nxt"] for r in found} == expected
    assert len(found) == len(rows)


def test_next_value_key_over_many_ranges(spark):
    df = spark.range(300).select(F.lit("one").alias("k"), F.col("id").alias("i"))
    found = {r["i"]: r["nxt"] for r in ordered.next_value(df, "k", ["i"], "i", "nxt", 24).collect()}
    assert found == {i: i + 1 if i < 299 else None for i in range(300)}


def test_rules_one_violation_each(spark):
    clean = ("PRT_1", "P1", "n", 1.5, "SUP_1")
    rows = [
        clean,
        ("PRT_2", "P2", "n" * 101, 1.5, None),
        ("PRT_3", "P3", "n", -1.0, None),
        ("PRT_4", "P4", "n", 1000.0, None),
        (None, "P5", "n", 1.5, None),
    ]
    df = spark.createDataFrame(
        rows, "PART_ID string, PART_NUMBER string, PART_NAME string, PART_WEIGHT_KG double, SUPPLIER_ID string"
    )
    found = quality.check_tables({"part_data": df}).select("rule", "column_name", "row_key").collect()
    assert sorted(map(tuple, found)) == [
        ("decimal", "PART_WEIGHT_KG", "PRT_4"),
        ("length", "PART_NAME", "PRT_2"),
        ("non_negative", "PART_WEIGHT_KG", "PRT_3"),
        ("not_null", "PART_ID", "null"),
    ]
    boxes = spark.createDataFrame([("BOX_1", "maybe", 40_000)], "BOX_ID string, BOX_TYPE string, BOX_LENGTH_MM bigint")
    found = quality.check_tables({"box_data": boxes}).select("rule", "column_name").collect()
    assert sorted(map(tuple, found)) == [("enum", "BOX_TYPE"), ("smallint", "BOX_LENGTH_MM")]


def test_breakpoint_rules(spark):
    df = spark.createDataFrame([("BPT_1", None), ("BPT_2", "B" * 11)], "BREAKPOINT_ID string, BREAKPOINT_NUMBER string")
    found = quality.check_tables({"breakpoint_data": df}).select("rule", "row_key").collect()
    assert sorted(map(tuple, found)) == [("length", "BPT_2"), ("not_null", "BPT_1")]


def test_duplicates_orphans_and_changed_values(spark):
    links = spark.createDataFrame([("p1", "b1"), ("p1", "b1"), ("p2", "b9")], "PART_ID string, BOX_ID string")
    assert [r["row_key"] for r in quality.duplicate_keys(links, "part_to_box", ["PART_ID", "BOX_ID"]).collect()] == ["p1|b1"]
    tables = {
        "part_to_box": links,
        "part_data": spark.createDataFrame([("p1", None), ("p2", None)], "PART_ID string, SUPPLIER_ID string"),
        "box_data": spark.createDataFrame([("b1",)], "BOX_ID string"),
    }
    found = quality.orphans(tables).collect()
    assert [tuple(r) for r in found] == [("part_to_box", "BOX_ID", "b9", 1)]
    old = spark.createDataFrame([("p1", "A"), ("p2", "B")], "PART_ID string, PART_NUMBER string")
    new = spark.createDataFrame([("p1", "A"), ("p2", "C")], "PART_ID string, PART_NUMBER string")
    assert [tuple(r) for r in quality.changed_values(old, new, ["PART_ID"], "PART_NUMBER").collect()] == [("p2", "B", "C")]


def test_insert_and_correct(spark):
    kind = "PART_ID string, PART_NUMBER string, PART_NAME string, PART_WEIGHT_KG double, SUPPLIER_ID string"
    old = spark.createDataFrame([("1", "A", "a", 1.0, "s1"), ("2", "B", "b", 2.0, "s2")], kind)
    new = spark.createDataFrame([("2", "B", "other", 9.0, "s9"), ("3", "C", "c", 3.0, "s3")], kind)
    merged = edits.insert_new(old, new, ["PART_ID"]).orderBy("PART_ID").collect()
    assert [r["PART_NAME"] for r in merged] == ["a", "b", "c"]
    assert edits.insert_new(old, new, ["PART_ID"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    clashing = spark.createDataFrame([("1", "Z", "z", 1.0, "s1"), ("2", "B", "b", 2.0, "s2"), (None, "N", "n", 1.0, "s1")], kind)
    assert [tuple(r) for r in edits.key_clashes(old, clashing, ["PART_ID"], ["PART_NUMBER"]).collect()] == [("1", "A")]
    open_keys = edits.insert_new(clashing, clashing.where("PART_ID is null"), ["PART_ID"])
    assert sorted(r["PART_NUMBER"] for r in open_keys.collect()) == ["B", "N", "N", "Z"]
    fixes = spark.createDataFrame(
        [("A", "fixed", None, "s9"), ("Z", "none", "1", "s9")],
        "PART_NUMBER string, PART_NAME string, PART_WEIGHT_KG string, SUPPLIER_ID string",
    )
    fixed = edits.correct_rows(old, fixes, ["PART_NUMBER"]).orderBy("PART_ID").collect()
    assert [tuple(r) for r in fixed] == [("1", "A", "fixed", 1.0, "s1"), ("2", "B", "b", 2.0, "s2")]


def test_dependants():
    assert set(dependants("supplier_data")) == {"part_data", "part_to_box", "part_to_model", "part_to_line", "part_to_breakpoint"}
    assert dependants("workshop_data") == ["line_data", "part_to_line"]
    assert dependants("part_to_box") == []


def test_changes(spark):
    pairs = spark.createDataFrame(
        [("2026-01-01", "p1", "p2"), ("2026-01-01", "p1", "p2"), (None, "p1", "p3"), ("2026-02-01", "p2", "p4")],
        "breakpoint_date string, old_part_id string, new_part_id string",
    ).withColumn("breakpoint_date", F.to_timestamp("breakpoint_date"))
    distinct = changes.pair_changes(pairs)
    assert distinct.count() == 2
    fanned = changes.fan_out(changes.pair_breakpoints(distinct)).drop("breakpoint_id").collect()
    assert sorted(map(tuple, fanned)) == sorted(
        [("p1", True, False), ("p2", False, True), ("p2", True, False), ("p4", False, True)]
    )
    assert changes.pair_changes(spark.range(3)).isEmpty()
    numbered = changes.number_breakpoints(distinct).orderBy("breakpoint_seq").collect()
    assert [(r["new_part_id"], r["breakpoint_seq"]) for r in numbered] == [("p2", 1), ("p4", 2)]


def test_overview_rejects_unknown_filter_and_skips_open_ones(spark):
    tables = {t.name: spark.createDataFrame([], t.schema) for t in TABLES.values()}
    with pytest.raises(ValueError, match="COLOUR"):
        overview.part_overview(tables, COLOUR="red")
    assert overview.part_overview(tables, PART_NUMBER=None).isEmpty()


def test_overview_filters_must_hold_on_one_row(spark):
    tables = {t.name: spark.createDataFrame([], t.schema) for t in TABLES.values()}
    tables["part_data"] = spark.createDataFrame([("p1", "P1"), ("p2", "P2")], "PART_ID string, PART_NUMBER string").withColumns(
        {"PART_NAME": F.lit("n"), "PART_WEIGHT_KG": F.lit(1.0), "SUPPLIER_ID": F.lit(None).cast("string")}
    )
    tables["line_data"] = spark.createDataFrame(
        [("l1", "L1", "one", None), ("l2", "L2", "two", None)], TABLES["line_data"].schema
    )
    tables["part_to_line"] = spark.createDataFrame([("p1", "l1"), ("p1", "l2"), ("p2", "l2")], "PART_ID string, LINE_ID string")
    chosen = lambda **f: sorted(r["PART_ID"] for r in overview.select_parts(tables, **f).collect())
    assert chosen(LINE_CODE="L1") == ["p1"]
    assert chosen(LINE_CODE="L2") == ["p1", "p2"]
    assert chosen(LINE_CODE="L1", LINE_NAME="two") == []
    assert chosen(LINE_CODE="L2", PART_NUMBER="P2") == ["p2"]
    chosen_once = overview.part_overview(tables, PART_NUMBER="P1")
    assert "chosen-parts" in "".join(chosen_once.inputFiles()) and "chosen-boxes" in "".join(chosen_once.inputFiles())
    sections = chosen_once.groupBy("SECTION").count().collect()
    assert {r["SECTION"]: r["count"] for r in sections} == {"part": 1, "line": 2}


def test_key_clash_is_seen(spark):
    rows = [(f"P{i}", "n", "1", "s", None, None, None, None, i) for i in range(200)]
    names = [*normalize.sheet_columns_for("part_data"), ORDER]
    assert names[:3] == ["PART_NUMBER", "PART_NAME", "PART_WEIGHT_KG"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names[:-1]) + f", {ORDER} bigint")
    assert normalize.build_table(df, "part_data", check=True).where(normalize.CLASH).isEmpty()
    assert not normalize.build_table(df, "part_data", check=True, width=1).where(normalize.CLASH).isEmpty()
