"""MinHash near-dedup with tensored banding.

A document's set holds its distinct runs of ``SHINGLE`` words. Two small collections of sketches are made of it:
``A`` of two minhashes each and ``B`` of three. Table keys are all pairs of a sketch from each, so 8 and 10 sketches,
46 minhashes, serve 80 tables of five minhashes, which would take 400 by themselves. A pair at the threshold
shares no key with probability 1e-4; the numbers of sketches follow from that (10 and 14 at 0.80).

Keys only lead to comparisons; links are confirmed on full sets. Copies with equal sets are one class from the
start, and all work goes by class. No bucket is ever paired out:

1. Sketches that only one class has are dropped first: most classes have no key at all.
2. A first pass takes a few tables of each class. In each bucket the member whose sketches are the most common, which edits
   have changed least, is the pivot; each class is compared with the pivot its minhashes agree with most. So large groups
   of near copies are one component before all tables are made.
3. Of the buckets of all tables, only those that hold several components matter, and of those with the same classes only one:
   one aggregation finds both, by the labels and two exclusive ors over the members. Only their rows are read on.
4. In each of them all classes of other components are compared with its pivot.
5. Classes of buckets that still hold several components are compared by prefix filter: shingles are ordered from
   rare to common, and a linked pair must share one among the first 15 % of each (20 % at 0.80). Only pairs of different
   components are made, one side never is the component that has most of a shingle's rows, and bounds on sizes,
   on shingles that others have too, and on the parities of hashed places leave few pairs that aren't links.

So every pair with a common key and enough similarity ends in one component, while the pairs made follow
the number of classes, not its square. Minhash agreement only sorts out pairs that lie five standard deviations
below the threshold.

Null, empty and blank texts have an empty set and are linked with nothing. Rows without an id are linked with nothing and
kept. Rows that share an id are one node. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partgraph.llm.common import Scratch, bounded, map_batches, text_or_empty, unused
from partgraph.llm.links import components
from partgraph.llm.words import mix, windows, word_hashes

SHINGLE = 5
#: Minhashes per sketch of each collection, and the probability that a pair at the threshold shares no sketch of it.
SKETCHES = ((2, 4e-5), (3, 8e-5))
BITS = 1024  # places of a set's parities
#: Sketches of each collection whose tables the first pass takes.
FIRST = (3, 4)
SALT = np.uint64(0x5851F42D4C957F2D)

SCHEMA = "doc_id long, n_shingles long, key1 long, key2 long, minhashes array<int>, sketches array<long>"


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's set."""
    words = word_hashes(text.lower())  # of bytes: A to Z only
    if not len(words):
        return words
    return np.unique(windows(words, SHINGLE) if len(words) >= SHINGLE else windows(words, len(words)) + np.uint64(len(words)))


class Sketcher:
    """Minhashes and sketches for pairs of similarity ``share`` or more."""

    def __init__(self, share: float):
        self.sizes = [(math.ceil(math.log(miss) / math.log(max(1 - share**size, 1e-9))), size) for size, miss in SKETCHES]
        self.hashes = sum(count * size for count, size in self.sizes)
        random = np.random.default_rng(20260102)
        self.times = random.integers(1, 2**63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = random.integers(0, 2**63, self.hashes, dtype=np.uint64)

    def minhashes(self, found: np.ndarray) -> np.ndarray:
        """Minhashes of 32 bits."""
        low = np.full(self.hashes, 2**64 - 1, np.uint64)
        for at in range(0, len(found), 4096):
            part = found[at : at + 4096]
            low = np.minimum(low, ((part[None, :] * self.times[:, None]) + self.plus[:, None]).min(axis=1))
        return (low >> np.uint64(32)).astype(np.uint32)

    def sketches(self, low: np.ndarray) -> np.ndarray:
        """Hashes of the sketches of both collections, from a row of minhashes for each set; the lowest bit says which."""
        wide, out, at = low.astype(np.uint64), [], 0
        for side, (count, size) in enumerate(self.sizes):
            for i in range(count):
                h = np.full(len(low), 2 * (side * 1000 + i) + 1, np.uint64)
                for j in range(size):
                    h = mix((wide[:, at + j] ^ h) * np.uint64(0x9E3779B97F4A7C15))
                out.append((h & ~np.uint64(1)) | np.uint64(side))
                at += size
        return np.stack(out, axis=1)


def _sketch(sketcher: Sketcher) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            sizes, keys = [], []
            low = np.empty((batch.num_rows, sketcher.hashes), np.uint32)
            for i, value in enumerate(batch.column(1)):
                found = shingles(value.as_buffer().to_pybytes())
                low[i] = sketcher.minhashes(found)
                sizes.append(len(found))
                keys.append((mix(found).sum(dtype=np.uint64), mix(found ^ SALT).sum(dtype=np.uint64)) if len(found) else (np.uint64(0),) * 2)
            both = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            lists = lambda rows, kind: pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                 lists(low.view(np.int32), pa.int32()), lists(sketcher.sketches(low).view(np.int64), pa.int64())],
                ["doc_id", "n_shingles", "key1", "key2", "minhashes", "sketches"],
            )

    return run


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls to each of BITS places. Two sets differ in at least as many shingles as places."""
    odd = np.bincount((mix(found) >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(v.as_buffer().to_pybytes()) for v in batch.column(1)]
        columns = [[f.view(np.int64) for f in found], [parities(f) for f in found]]
        arrays = [batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, ["rep", "shingles", "bits"])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))


class NearDuplicates:
    """One run over ``docs``; links need ``percent`` * union <= 100 * intersection."""

    def __init__(self, docs: DataFrame, scratch: Scratch, percent: int = 85):
        self.docs, self.scratch, self.percent = docs, scratch, percent
        share = percent / 100
        self.sketcher = Sketcher(share)
        hashes = self.sketcher.hashes
        self.agree = int(np.floor(hashes * share - 5 * np.sqrt(hashes * share * (1 - share))))

    def run(self) -> DataFrame:
        """doc_id, n_shingles and component_id of every row."""
        save = self.scratch.save
        rows = save(map_batches(texts_of(self.docs), _sketch(self.sketcher), SCHEMA), "sketches")
        usable = rows.where("n_shingles > 0 and doc_id is not null")
        same = ["n_shingles", "key1", "key2"]
        self.reps = save(
            usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("minhashes").alias("minhashes"), F.first("sketches").alias("sketches")),
            "reps",
        )
        live = self.live_classes()
        # the first pass: a few tables, each class with its best pivot
        few = live.select("rep", "weight", *(F.slice(F.sort_array(c), 1, n).alias(c) for c, n in zip(("as", "bs"), FIRST)))
        pool = self.rated(self.pivot_pairs(save(self.keys(few), "few-keys")), "first")
        self.sets = self.sets_of(self.sides(pool), "sets0")
        edges = save(self.confirm(pool.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))), "edges0")
        labels = components(edges, self.scratch, "round0")
        # all tables: classes of other components than the pivot's
        chosen = self.open_buckets(live, labels)
        pairs = chosen.where("label <> pivot_label").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
        pool = self.rated(pairs, "all")
        self.add_sets(self.sides(pool), "sets1")
        edges = save(self.confirm(pool).union(self.as_edges(labels)), "edges1")
        labels = components(edges, self.scratch, "round1")
        edges = save(self.confirm(self.prefix_pairs(chosen.select("key", "rep"), labels)).union(self.as_edges(labels)), "edges2")
        labels = components(edges, self.scratch, "round2")
        classes = self.reps.join(labels, F.col("rep") == F.col("node"), "left")
        classes = save(classes.select(*same, F.coalesce("label", "rep").alias("component")).distinct(), "classes")
        found = rows.select("doc_id", *same).join(classes, same, "left")
        apart = F.col("doc_id").isNull() | F.col("component").isNull()
        return found.select("doc_id", "n_shingles", F.when(apart, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))

    @staticmethod
    def as_edges(labels: DataFrame) -> DataFrame:
        return labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))

    def live_classes(self) -> DataFrame:
        """Classes that share a sketch of both collections, the sketches they share, and how common those are."""
        single = self.reps.select("rep", F.explode("sketches").alias("sketch"))
        shared = single.groupBy("sketch").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
        shared = self.scratch.save(shared, "shared")
        live = single.join(shared, "sketch").groupBy("rep").agg(
            F.collect_set("sketch").alias("sketches"), F.sum("holders").alias("weight")  # at most 18 of each class at 0.85, 24 at 0.80
        )
        side = lambda bit: F.filter("sketches", lambda s: s.bitwiseAND(F.lit(1)) == bit)
        live = live.select("rep", "weight", side(0).alias("as"), side(1).alias("bs")).where("size(as) > 0 and size(bs) > 0")
        return self.scratch.save(live, "live")

    @staticmethod
    def keys(live: DataFrame) -> DataFrame:
        """Table keys of classes: all pairs of a sketch from each collection."""
        rest = [c for c in live.columns if c not in ("as", "bs")]
        pairs = live.select(*rest, F.explode("as").alias("a"), "bs").select(*rest, "a", F.explode("bs").alias("b"))
        return pairs.select(F.xxhash64("a", "b").alias("key"), *rest)

    @staticmethod
    def ranked() -> Column:
        """The largest of a bucket is its pivot."""
        return F.struct("weight", F.xxhash64("rep", "key"), "rep")

    def pivot_pairs(self, keys: DataFrame) -> DataFrame:
        """Each class with the pivots of its buckets: a, b."""
        pivots = keys.groupBy("key").agg(F.max(self.ranked())["rep"].alias("pivot"), F.min("rep").alias("low"), F.max("rep").alias("high"))
        pivots = pivots.where("low <> high").select("key", "pivot")
        return keys.join(pivots, "key").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()

    def open_buckets(self, live: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the buckets with several components, one bucket for each set of classes: key, rep, label, pivot, pivot_label."""
        named = live.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "weight", F.coalesce("label", "rep").alias("label"), "as", "bs")
        named = self.scratch.save(named, "named")
        keys = self.keys(named)
        top = F.struct("weight", F.xxhash64("rep", "key"), "rep", "label")
        buckets = keys.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.max(top).alias("top"), F.count(F.lit(1)).alias("members"),
            F.bit_xor(F.xxhash64("rep")).alias("mark1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("mark2"),
        )
        once = buckets.where("low <> high").groupBy("members", "mark1", "mark2").agg(F.min(F.struct("key", "top")).alias("one"))
        once = self.scratch.save(once.select("one.key", F.col("one.top.rep").alias("pivot"), F.col("one.top.label").alias("pivot_label")), "open-buckets")
        return self.scratch.save(keys.select("key", "rep", "label").join(once, "key"), "chosen")

    def rated(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that sizes and minhashes don't rule out: a, b, agree."""
        sizes = lambda name: self.reps.select(
            F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("minhashes").alias(f"m_{name}")
        )
        half = self.scratch.save(pairs.join(sizes("a"), "a"), f"{name}-half-pairs")
        same = F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        rated = half.join(sizes("b"), "b").where(self.sizes_fit("n_a", "n_b")).select("a", "b", same.alias("agree"))
        pool = self.scratch.save(rated.where(F.col("agree") >= self.agree), f"{name}-pool")
        self.scratch.drop(f"{name}-half-pairs")
        return pool

    @staticmethod
    def sides(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()

    def sizes_fit(self, x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= self.percent * F.greatest(x, y)

    def may_link(self, a: str, b: str) -> Column:
        """False only for pairs whose sets differ in too many shingles: by sizes, shared shingles, and parities."""
        total = F.col(f"n_{a}") + F.col(f"n_{b}")
        least = F.ceil(total * self.percent / (100 + self.percent))
        differ = sum(
            (F.bit_count(F.col(f"bits_{a}")[i].bitwiseXOR(F.col(f"bits_{b}")[i])) for i in range(BITS // 64)), F.lit(0)
        )
        fits = F.least(f"shared_{a}", f"shared_{b}") >= least
        return self.sizes_fit(f"n_{a}", f"n_{b}") & fits & (differ <= total - 2 * least)

    def sets_of(self, members: DataFrame, name: str) -> DataFrame:
        """Full sets of some classes."""
        members = bounded(self.scratch.save(members, f"{name}-members"))
        texts = texts_of(self.docs).join(members, F.col("doc_id") == F.col("rep"), "left_semi")
        return self.scratch.save(map_batches(texts, _sets, "rep long, shingles array<long>, bits array<long>"), name)

    def add_sets(self, members: DataFrame, name: str) -> None:
        """Full sets of the classes among ``members`` that have none yet."""
        self.sets = self.sets.union(self.sets_of(members.join(self.sets.select("rep"), "rep", "left_anti"), name))

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        own = lambda name: self.sets.select(F.col("rep").alias(name), F.col("shingles").alias(f"s_{name}"))
        joined = pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b")
        common = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - common
        return joined.select("a", "b", common.alias("common"), union.alias("union")).where(100 * F.col("common") >= self.percent * F.col("union")).select("a", "b")

    def prefix_pairs(self, chosen: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different components that the prefix filter leaves, among classes of buckets with several components."""
        save = self.scratch.save
        named = chosen.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
        named = save(named, "relabelled")
        mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        open_reps = save(named.join(mixed, "key", "left_semi").select("rep", "label").distinct(), "open")
        self.add_sets(open_reps.select("rep"), "sets2")
        sets = self.sets.join(open_reps, "rep").select("rep", F.size("shingles").alias("n"), "shingles")
        items = save(sets.select("rep", "n", F.explode("shingles").alias("item")), "items")
        common = save(items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
        shared = items.join(common, "item")
        place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "item"))
        alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("rep"))
        first = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1
        ranked = shared.withColumn("place", place).withColumn("alone", alone)
        leading = ranked.where(F.col("alone") + F.col("place") <= first)
        leading = save(leading.select("item", "rep", "n", (F.col("n") - F.col("alone")).alias("shared")), "leading")
        prefix = save(leading.join(open_reps, "rep").join(self.sets.select("rep", "bits"), "rep"), "prefix")
        most = prefix.groupBy("item", "label").agg(F.count(F.lit(1)).alias("rows")).groupBy("item").agg(
            F.max_by("label", F.struct("rows", "label")).alias("most"), F.count(F.lit(1)).alias("labels")
        )
        most = save(most.where("labels > 1").select("item", "most"), "most")
        side = lambda rows, x: rows.select(
            "item", F.col("rep").alias(x), F.col("label").alias(f"l_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "shared", "bits"))
        )
        few = save(side(prefix.join(most, "item").where("label <> most"), "a"), "few")
        many = side(prefix.join(most.select("item"), "item", "left_semi"), "b")
        found = (few["item"] == many["item"]) & (F.col("l_a") != F.col("l_b")) & self.may_link("a", "b")
        pairs = few.join(many, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return save(pairs, "prefix-pairs")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept (the id is the component's)."""
    found = NearDuplicates(docs, scratch, percent).run()
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, scratch: Scratch, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that are kept; rows equal in id and text stay once.

    Of each group the smallest id stays. Rows that share an id but not the text are documents of their own: for this
    they get numbers above all ids, so of a group with other members one of those stays.
    """
    node, digest = unused(docs, "node"), unused(docs, "digest")
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    twice = scratch.save(ids.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "twice")
    numbered = docs.withColumn(node, F.col("doc_id").cast("long"))
    again = not twice.isEmpty()
    if again:
        twice = bounded(twice)
        full = numbered.withColumn(digest, F.when(F.col(node).isNotNull(), F.sha2(text_or_empty(), 256)))
        texts = full.join(twice, F.col(node) == twice["id"], "left_semi").select(F.col(node).alias("id"), F.col(digest).alias("sum")).distinct()
        texts = scratch.save(texts, "texts")
        several = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        top = ids.agg(F.max("id")).first()[0]
        own = texts.join(several, "id", "left_semi").withColumn("new", F.monotonically_increasing_id() + F.lit(top + 1))
        own = bounded(scratch.save(own, "own-numbers"))  # written, so a number stays what it is
        joined = full.join(own, (full[node] == own["id"]) & (full[digest] == own["sum"]), "left")
        numbered = joined.select(*(full[c] for c in docs.columns), F.coalesce(own["new"], full[node]).alias(node))
    found = near_duplicates(numbered.select(F.col(node).alias("doc_id"), "text"), scratch, percent)
    out = bounded(scratch.save(found.where("not kept").select(F.col("doc_id").alias("id")).distinct(), "out"))
    kept = numbered.join(out, F.col(node) == out["id"], "left_anti")
    if again:
        repeated = bounded(scratch.save(twice.union(own.select("new")), "repeated"))
        once = kept.join(repeated, F.col(node) == repeated["id"], "left_semi").dropDuplicates([node])
        kept = kept.join(repeated, F.col(node) == repeated["id"], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
