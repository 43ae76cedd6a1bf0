"""How five document filters overlap: what each removes, alone and behind the others, in every order.

Filters are letters, and bits of a mask of those that a document fails:

====  ===========================================================
A     under ``WORDS`` words
B     distinct words under ``DISTINCT`` percent of the words
C     ``[A-Z]`` over ``CAPITALS`` percent of the code points
D     holds one of ``#$%&*|``
E     the text equals that of a smaller doc_id, anywhere in the table
====  ===========================================================

E is an existential self-join: a left-semi join of rows on hash, exact text and smaller id. Only texts whose hash
occurs twice take part. The side that is looked up holds one row for each text with its smallest id, so a text
that fills a third of the table leaves each task as one row; the side that looks up is dealt over as many keys as the
text has ``SPREAD`` rows. The ids found are put under the failures of the other filters, and one aggregation by id makes
the bit combinations. From there on the work is on 32 counts for each part of the corpus, whatever its size: the
120 orders are read off them.

Null text is empty, null source is the part ''. Words are runs of anything but space and 0x09 to 0x0D. A row without an id fails E never,
counts as a document, and has no label. Rows that share an id are documents of their own; equal ones fail alike, and
none is a smaller id of the other. A document is good, or toxic, if any of its label rows says so. Empty tables give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import Scratch, bounded, let, text_or_empty

FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS = 200, 50, 2
ORDERS = ["".join(order) for order in permutations(FILTERS)]
#: Rows of one text that look up the same key.
SPREAD = 256
DUPLICATE = 1 << FILTERS.index("E")


def own_failures(text: Column) -> Column:
    """Bits of A to D."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(w: Column) -> Column:
        fails = (
            F.size(w) < WORDS,
            100 * F.size(F.array_distinct(w)) < DISTINCT * F.size(w),
            100 * capitals.cast("long") > CAPITALS * F.length(text),
            text.rlike("[#$%&*|]"),
        )
        return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))

    return let(words, bits)


def later_copies(rows: DataFrame, hashes: DataFrame, scratch: Scratch, spread: int = SPREAD) -> DataFrame:
    """doc_id, part and hash of the ``rows`` whose text a smaller id has; ``hashes`` has the same rows without text."""
    twice = hashes.where("doc_id is not null").groupBy("hash").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    twice = twice.where("copies > 1").select("hash", "first", F.ceil(F.col("copies") / spread).cast("int").alias("ways"))
    twice = bounded(scratch.save(twice, "twice"))
    held = rows.where("doc_id is not null").join(twice, "hash")
    first = held.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("ways").alias("ways"))
    first = first.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    asks = held.where("doc_id > first").withColumn("way", F.pmod(F.xxhash64("doc_id"), F.col("ways")).cast("int"))
    a, b = asks.alias("a"), first.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("hash", "way", "text")]
    found = a.join(b, [*same, F.col("a.doc_id") > F.col("b.first")], "left_semi")
    return found.select("doc_id", "part", "hash").distinct()


def combinations(docs: DataFrame, labels: DataFrame, scratch: Scratch, spread: int = SPREAD) -> DataFrame:
    """Documents for each part and mask of failed filters: n, good, toxic."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marked = scratch.save(rows.select("doc_id", "part", "hash", own_failures(F.col("text")).alias("mask")), "marked")
    copies = later_copies(rows, marked, scratch, spread)
    failures = marked.withColumn("n", F.lit(1)).unionByName(copies.select("*", F.lit(DUPLICATE).alias("mask"), F.lit(0).alias("n")))
    known = failures.where("doc_id is not null").groupBy("doc_id", "part", "hash").agg(
        F.sum("n").alias("n"), F.bit_or("mask").alias("mask")
    )
    says = lambda name: F.max((F.col(name) == 1).cast("int")).alias(name)
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality"), says("toxic"))
    known = known.join(judged, "doc_id", "left").select("part", "mask", "n", "quality", "toxic")
    nameless = marked.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    of = lambda name: F.sum(F.col("n") * F.coalesce(name, F.lit(0)))
    return known.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic")
    )


def interactions(combos: DataFrame) -> DataFrame:
    """What each step of every order keeps and removes, from the counts by part and mask."""
    table = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)),
        lambda m: F.struct(m.alias("mask"), *(F.coalesce(F.try_element_at("table", m)[c], F.lit(0).cast("long")).alias(c) for c in ("n", "good", "toxic"))),
    )
    parts = combos.groupBy("part").agg(table.alias("table")).select("part", cells.alias("cells"))
    orders = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ",")))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    letters = F.split("filter_order", "")
    steps = steps.select(
        "part", "filter_order", "step", "cells", bit(F.get(letters, F.col("step") - 1)).alias("own"),
        F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda s, x: s.bitwiseOR(bit(x))).alias("before"),
    )

    def total(value: str, fails_own: bool | None, fails_before: bool | None) -> Column:
        def of(cell: Column) -> Column:
            tests = [(cell["mask"].bitwiseAND(F.col(b)) != 0) == f for b, f in (("own", fails_own), ("before", fails_before)) if f is not None]
            return F.when(tests[0] & tests[-1], cell[value]).otherwise(F.lit(0).cast("long"))

        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, cell: s + of(cell))

    # of all orders, as large a share removes a document by this filter as it fails few filters
    share = lambda cell: F.floor(F.lit(len(ORDERS)) / F.greatest(F.bit_count(cell["mask"]), F.lit(1))).cast("long")
    shapley = F.aggregate(
        "cells", F.lit(0).cast("long"),
        lambda s, cell: s + F.when(cell["mask"].bitwiseAND(F.col("own")) != 0, cell["n"] * share(cell)).otherwise(F.lit(0).cast("long")),
    )
    return steps.select(
        "part", "filter_order", "step",
        total("n", False, False).alias("kept"), total("n", True, False).alias("removed"), total("n", True, True).alias("redundant"),
        F.get("cells", F.col("own"))["n"].alias("unique_fails"),
        total("good", True, False).alias("good_lost"), total("toxic", True, False).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch, spread: int = SPREAD) -> DataFrame:
    """One row per part, order and step."""
    return interactions(combinations(docs, labels, scratch, spread))
