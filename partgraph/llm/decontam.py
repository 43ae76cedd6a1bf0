"""Benchmark decontamination by template: numbers, names and units become typed placeholders.

Both sides are brought to one form: a word of its own for each number (``<n>``), name (``<p>``: capitalised inside
a sentence) and unit behind a number (``<u>``), all else lower-cased words without marks. A document is cut into consecutive blocks of
``BLOCK`` words, an item into all its windows of that size; they are joined by hash. Any shared run of
2 * BLOCK - 1 words holds a whole block, so none of that length is missed although a document has a row per block
only. A block of nothing but placeholders must be equal in their values, too, so tables of numbers don't meet all others. Texts with neighbouring placeholders of a kind (New York) are cut a second time with these made one, so that a name of
other length doesn't break a run. A joined pair gives the item's place in the document. Blocks of an item at places no more
than ``NEAR`` words apart are chained in order, none overlapping, and words are compared one by one along the chain. The values in
CONSISTENT of the slots must map one to one: the same value in the item is the same in the document and the other way round. So
a question with other numbers and names is caught, while words that merely share a shape are not. Where COPY of the
words that match are equal in value too, it is a copy, and neither slots nor their number are looked at.

Items of fewer than 2 * BLOCK - 1 words are joined whole with all document windows of just their lengths, and must be
equal there word for word and value for value, whatever their length.

All of it is DataFrame functions. Null or empty text matches nothing; rows equal in id and text are one document; repeated items count once per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partgraph.llm.common import Scratch, bounded, let, text_or_empty

BLOCK = 5
LEAST = 2 * BLOCK - 1  # words of a run that holds a whole block wherever it begins
#: Share of an item's words that must match in place, and share of those that must be no placeholders.
COVERAGE, PLAIN = 0.6, 0.5
#: Share of the words that match in place which are equal in value in a copy.
COPY = 0.9
#: Share of the slots that must map one to one, and words by which places of one leak may differ.
CONSISTENT, NEAR = 0.9, 30
# Units that may follow a number.
UNITS = (
    "percent|kilometers|kilometres|kilograms|centimeters|meters|metres|miles|feet|inches|grams|pounds|ounces|liters|litres|"
    "gallons|seconds|minutes|hours|days|weeks|months|years|dollars|euros|cents|degrees|km|kg|cm|mm|lb|oz|ml|mph|m|g|l"
)


def canonical(text: Column, values: bool = False) -> Column:
    """``text`` in the common form, words parted by one space. ``values``: placeholders hold what they replace."""
    put = (lambda kind: f"<{kind}:$1:{kind}>") if values else (lambda kind: f"<{kind}>")
    plain = F.regexp_replace(F.translate(text, "<>:_", "    "), r"(?<=[0-9]) ?%(?![\p{L}0-9])", " percent ")
    named = F.regexp_replace(plain, r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", f" {put('p')} ")
    joined = F.regexp_replace(named, r"(?<=[0-9])[.,](?=[0-9])", "_")
    measured = F.regexp_replace(joined, rf"(?<=[0-9]) ?({UNITS})(?![\p{{L}}0-9])", f" {put('u')} ")
    counted = F.regexp_replace(measured, r"(?<![\p{L}0-9_:])([0-9][0-9_]*)", f" {put('n')} ")
    typed = F.when(text.rlike("[0-9]"), counted).otherwise(named)
    lowered = F.translate(F.lower(typed), "\u0307", "")  # the dot that İ leaves would part a placeholder
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}<>:_]+", " "))


def without_values(form: Column) -> Column:
    """``canonical`` without values, from the one with values."""
    return F.regexp_replace(form, r"<([npu]):[^ <>]*:\1>", "<$1>")


def collapsed(form: Column, values: bool = False) -> Column:
    """``canonical`` with neighbouring placeholders of a kind as one."""
    return F.regexp_replace(form, r":([npu])> <\1:", "_") if values else F.regexp_replace(form, r"<([npu])>(?: <\1>)+", "<$1>")


def words(text: Column, values: bool = False, joined: bool = False) -> Column:
    form = canonical(text, values)
    return F.filter(F.split(collapsed(form, values) if joined else form, " "), lambda w: w != "")


def kind_of(word: Column) -> Column:
    """The placeholder of a word with its value, or the word."""
    return F.regexp_replace(word, "^(<[npu]):.*>$", "$1>")


def bare(text: Column) -> Column:
    """Words with values, without the marks of their placeholders, which depend on what stands in front."""
    return F.regexp_replace(text, "<[npu]:([^ <>]*):[npu]>", "$1")


def window_hash(items: Column) -> Column:
    return F.xxhash64(F.array_join(items, " "))


def block_hash(valued: Column) -> Column:
    """Hash of a block of words with values: of their form, or, if all of them are placeholders, of the values, too.

    Tables of numbers are alike in form, whatever they hold: there only a copy is a match.
    """
    return F.when(valued.rlike(rf"^(<[npu]:[^ ]*( |$)){{{BLOCK}}}$"), F.xxhash64(F.lit("values"), bare(valued))).otherwise(F.xxhash64(without_values(valued)))


def item_words(benchmark: DataFrame) -> DataFrame:
    """Words of each item as they are (joined 0) and with neighbouring placeholders as one (1)."""
    forms = [F.struct(F.lit(j).alias("joined"), words(text_or_empty(), True, j == 1).alias("item_words")) for j in (0, 1)]
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array(*forms)).alias("f")).select("item_id", "f.*")
    return rows.dropDuplicates(["item_id", "joined", "item_words"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """One row for each window of each item in both forms: hash, item and place."""
    worded = item_words(benchmark).select("item_id", "joined", F.col("item_words").alias("words")).where(F.size("words") >= LEAST)
    starts = F.sequence(F.lit(0), F.size("words") - BLOCK)
    placed = F.transform(starts, lambda i: F.struct(block_hash(F.array_join(F.slice("words", i + 1, F.lit(BLOCK)), " ")).alias("hash"), i.alias("place")))
    return worded.select("item_id", "joined", F.explode(placed).alias("w")).select("w.hash", "item_id", "joined", F.col("w.place").alias("item_place")).distinct()


def document_blocks(docs: DataFrame) -> DataFrame:
    """One row for each block of each document: document, hash, place of its first word, and form (2: both are the same)."""
    formed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), canonical(text_or_empty(), True).alias("form"))
    blocks = lambda form: F.regexp_extract_all(F.concat(form, F.lit(" ")), F.lit(f"(?:[^ ]+ ){{{BLOCK}}}"), F.lit(0))
    numbered = lambda form, joined: F.transform(
        blocks(form), lambda b, i: F.struct(joined.alias("of"), block_hash(F.trim(b)).alias("hash"), (i * BLOCK).alias("doc_place"))
    )
    one = F.struct("form", collapsed(F.col("form"), True).alias("joined"))
    rows = let(one, lambda f: F.when(f["form"] == f["joined"], numbered(f["form"], F.lit(2))).otherwise(
        F.concat(numbered(f["form"], F.lit(0)), numbered(f["joined"], F.lit(1)))
    ))
    return formed.select("doc_id", "tie", F.explode(rows).alias("b")).select("doc_id", "tie", "b.*")


def short_items(benchmark: DataFrame) -> DataFrame:
    """Length and hash of each item that is too short for blocks."""
    worded = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.filter(F.split(bare(canonical(text_or_empty(), True)), " "), lambda w: w != "").alias("words"))
    return worded.where(F.size("words").between(1, LEAST - 1)).select("item_id", F.size("words").alias("n"), window_hash(F.col("words")).alias("hash")).distinct()


def short_places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """First place in each document of each item of ``short_items``."""
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # fewer than LEAST
    worded = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.split(bare(canonical(text_or_empty(), True)), " ").alias("words")
    )

    def windows(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: i <= F.size("words") - n)
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), window_hash(F.slice("words", i + 1, F.lit(n))).alias("hash"), i.alias("place")))

    rows = worded.select("doc_id", "tie", F.explode(F.concat(*map(windows, lengths))).alias("w")).select("doc_id", "tie", "w.*")
    return rows.join(bounded(items), ["n", "hash"]).groupBy("doc_id", "tie", "item_id").agg(F.min("place").alias("place"))


PARTS = "array<struct<start:int,stop:int,place:int>>"


def chain(hits: Column) -> Column:
    """Parts of an item, each at one place, from its (at, place) hits: in order on both sides, none overlapping.

    A part reaches from its start to the stop that the next part holds. Words between two parts are halved.
    """
    zero = F.struct(F.array().cast(PARTS).alias("parts"), F.lit(0).alias("item_end"), F.lit(0).alias("doc_end"), F.lit(0).alias("place"))

    def step(state: Column, hit: Column) -> Column:
        at, place = hit["at"], hit["place"]
        first = F.size(state["parts"]) == 0
        follows = first | ((at >= state["item_end"]) & (at + place >= state["doc_end"]))
        gap = F.least(at - state["item_end"], at + place - state["doc_end"])
        back = F.floor(gap / 2).cast("int")
        part = F.when(first, F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), place.alias("place"))).otherwise(
            F.struct((at - back).alias("start"), (state["item_end"] + gap - back).alias("stop"), place.alias("place"))
        )
        parts = F.when(first | (place != state["place"]), F.concat(state["parts"], F.array(part).cast(PARTS))).otherwise(state["parts"])
        moved = F.struct(parts.alias("parts"), (at + BLOCK).alias("item_end"), (at + place + BLOCK).alias("doc_end"), place.alias("place"))
        return F.when(follows, moved).otherwise(state)

    return F.aggregate(F.array_sort(hits), zero, step, lambda s: s["parts"])


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Places in documents at which an item may begin, negative where the document has only its end, and parts of the item to compare."""
    joined = document_blocks(docs).join(bounded(item_windows(benchmark)), "hash").where((F.col("of") == 2) | (F.col("of") == F.col("joined")))
    of = ["doc_id", "tie", "item_id", "joined"]
    places = joined.groupBy(*of, (F.col("doc_place") - F.col("item_place")).alias("place")).agg(F.collect_set("item_place").alias("at"))
    places = places.select(*of, "place", F.transform("at", lambda at: F.struct(at.alias("at"), F.col("place").alias("place"))).alias("hits"))
    near = F.flatten(F.collect_list("hits").over(Window.partitionBy(*of).orderBy("place").rangeBetween(-NEAR, NEAR)))
    single = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.col("place"))).cast(PARTS)
    both = places.select(*of, F.col("place"), near.alias("near")).select(*of, F.explode(F.array_distinct(F.array(single, chain(F.col("near"))))).alias("parts"))
    both = both.select(*of, F.col("parts")[0]["place"].alias("place"), "parts").distinct()
    short = short_items(benchmark)
    if short.isEmpty():
        return both
    return both.unionByName(short_places(docs, short).withColumn("joined", F.lit(0)).select(*of, "place", single.alias("parts")))


def one_to_one(pairs: Column) -> Column:
    """Pairs of slot values map one to one."""
    distinct = lambda part: F.size(F.array_distinct(F.transform(pairs, lambda p: p[part])))
    both = F.size(F.array_distinct(pairs))
    return (both == distinct("item")) & (both == distinct("doc"))


def consistent(pairs: Column) -> Column:
    """Number of slots in pairs that map one to one; of those in conflict the most frequent count."""
    counted = F.transform(F.array_distinct(pairs), lambda d: F.struct((-F.size(F.filter(pairs, lambda p: p == d))).alias("c"), d["item"].alias("item"), d["doc"].alias("doc")))
    zero = F.struct(F.array().cast("array<string>").alias("items"), F.array().cast("array<string>").alias("docs"), F.lit(0).alias("n"))

    def step(state: Column, pair: Column) -> Column:
        fresh = ~F.array_contains(state["items"], pair["item"]) & ~F.array_contains(state["docs"], pair["doc"])
        added = F.struct(
            F.concat(state["items"], F.array(pair["item"])).alias("items"), F.concat(state["docs"], F.array(pair["doc"])).alias("docs"),
            (state["n"] - pair["c"]).alias("n"),
        )
        return F.when(fresh, added).otherwise(state)

    return F.when(one_to_one(pairs), F.size(pairs)).otherwise(F.aggregate(F.array_sort(counted), zero, step, lambda s: s["n"]))


def matched_words(item: Column, doc: Column, parts: Column) -> Column:
    """(item, doc) of the words that are equal, or placeholders of one kind, along the parts."""
    part_place = lambda i: F.aggregate(
        parts, F.lit(None).cast("int"),
        lambda place, p: F.when(i >= p["start"], p["place"]).when(i >= p["stop"], F.lit(None).cast("int")).otherwise(place),
    )
    pairs = F.transform(item, lambda w, i: F.struct(w.alias("item"), F.get(doc, i + part_place(i)).alias("doc")))
    return F.filter(pairs, lambda p: p["doc"].isNotNull() & ((kind_of(p["item"]) == kind_of(p["doc"])) | (bare(p["item"]) == bare(p["doc"]))))


def same_document(doc_id: str, tie: str) -> Column:
    return F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.col(tie) == F.col("tie"))


def candidate_words(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Words of each document with candidates, in the forms they ask for: worked out once, however many candidates it has."""
    wanted = found.groupBy("doc_id", "tie").agg(F.collect_set("joined").alias("forms"))  # 0, 1
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_tie"), text_or_empty().alias("text"))
    chosen = texts.join(bounded(scratch.save(wanted, "wanted")), same_document("_id", "_tie")).select("_id", "_tie", "text", F.explode("forms").alias("form"))
    own = F.when(F.col("form") == 1, words(F.col("text"), True, True)).otherwise(words(F.col("text"), True))
    return scratch.save(chosen.select("_id", "_tie", "form", own.alias("doc_words")), "words")


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold an item, with the best place of each: doc_id, tie, item_id, place, words matched and counted, slots.

    Places and words are those of the form with neighbouring placeholders as one where only that form matches.
    """
    found = scratch.save(candidates(docs, benchmark), "candidates")
    cut = candidate_words(docs, found, scratch).join(bounded(found, F.size("parts")), same_document("_id", "_tie")).drop("_id", "_tie")
    cut = cut.where(F.col("joined") == F.col("form")).drop("form")
    joined = cut.join(bounded(scratch.save(item_words(benchmark), "items"), F.length(F.array_join("item_words", " "))), ["item_id", "joined"])
    slots = lambda matched: F.filter(matched, lambda p: p["item"].rlike("^<[npu]:"))
    matched = matched_words(F.col("item_words"), F.col("doc_words"), F.col("parts"))
    key = ["doc_id", "tie", "item_id", "joined", "place"]
    compared = joined.select(*key, F.size("item_words").alias("n_words"), matched.alias("matched")).select(
        *key, F.col("n_words").cast("long").alias("n_words"), F.size("matched").cast("long").alias("n_matched"),
        F.size(slots(F.col("matched"))).cast("long").alias("n_slots"), consistent(slots(F.col("matched"))).alias("n_consistent"),
        F.size(F.filter("matched", lambda p: bare(p["item"]) == bare(p["doc"]))).alias("n_equal"),
    )
    enough = F.col("n_matched") >= F.greatest(coverage * F.col("n_words"), F.lit(LEAST))
    plain = F.col("n_matched") - F.col("n_slots") >= PLAIN * F.col("n_matched")
    whole = (F.col("n_words") < LEAST) & (F.col("n_equal") == F.col("n_words"))
    copied = F.col("n_equal") >= COPY * F.col("n_matched")
    accepted = whole | (enough & (copied | (plain & (F.col("n_consistent") >= CONSISTENT * F.col("n_slots")))))
    best = F.max_by(F.struct("place", "n_words", "n_matched", "n_slots"), F.struct(-F.col("joined"), F.col("n_matched"), -F.col("place"))).alias("b")
    return compared.where(accepted).groupBy("doc_id", "tie", "item_id").agg(best).select("doc_id", "tie", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    bad = bounded(scratch.save(leaks(docs, benchmark, scratch).select("doc_id", "tie").distinct(), "leaks"))
    same = docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["tie"])
    return docs.join(bad, same, "left_anti")
