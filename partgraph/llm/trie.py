"""Prefix trie of rebuilt conversations, with subtree totals rolled up by centroid decomposition.

Conversation c is rebuilt from the first h turns of conversation c - c mod 5 (mod from 0 to 4) and its own turns after its
first h, h = crc32 of c in decimal, mod 9. Every distinct sequence of first turns is a node; its name is its
smallest member and its depth.

Order without one task: turns are range-partitioned by their whole order, so a conversation that holds a third of
them spans many ranges, and one summary row per range carries counts over. A node is known by two 64-bit exclusive
ors over hashes of (place, SHA-256 of role and text), which add up over ranges in the same way.

Roll-up: parent edges make a tree whose size below any node is the number of its members' turns from there on, a plain sum.
In each round every component too large for one task is split at its centroid, the deepest node with half of
the component's weight below it. The total of what lies below the centroid (with it) is one aggregation; it is added to the
nodes on the path from the centroid to the component's top, whose weights shrink by the centroid's. The pieces, each at most half as heavy, are the
next round's components, so rounds grow with the logarithm of the turns even if all lie in one chain. Components of up to ``LIMIT`` weight
are finished by the same rule inside tasks, many in one. Which side of a centroid a node lies on is looked up where its own
smallest member stands at the centroid's depth; lookups are made once per member and ``BLOCK`` depths.

Tables of ids and depths pack to a twentieth of what they take in memory. So no join broadcasts a side by the size of its files, which the
driver would have to hold unpacked: sides count by their bytes as shuffled.

The member lists at the ends are hashed in order: ranges of them are joined to texts of ``CHUNK`` bytes in parallel, and
only those are brought together for each node.

Null role or text is empty, null turns come first, equal turns go by role and text. Rows without conv_id belong to no conversation and are
left out. Repeated rows are turns of their own. An empty table gives no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partgraph.llm.common import Scratch, map_batches, text_or_empty

GROUP, MOST = 5, 8
#: Weight of a component that one task finishes, depths that share a lookup, bytes of ids hashed as one text.
LIMIT, BLOCK, CHUNK = 20_000, 4096, 1 << 20
#: Members from which a node counts as large; no more than one in so many rows, so that those are few.
LARGE, SHARE = 256, 50_000


@contextmanager
def broadcasts_by_shuffled_size(spark: SparkSession) -> Iterator[None]:
    """Joins planned within choose a broadcast only once a side is shuffled and its bytes are known; ``F.broadcast`` stays."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    files, shuffled = spark.conf.get(names[0]), spark.conf.get(names[1], None)
    spark.conf.set(names[1], shuffled or files)
    spark.conf.set(names[0], "-1")
    try:
        yield
    finally:
        spark.conf.set(names[0], files)
        if shuffled is None:
            spark.conf.unset(names[1])
        else:
            spark.conf.set(names[1], shuffled)


def borrowed(conv: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST + 1)


class Ordered:
    """Rows in the order of ``keys``, the first of which is ``conv_id``, spread over ranges and written."""

    def __init__(self, rows: DataFrame, keys: list[str], scratch: Scratch, name: str):
        self.scratch, self.name = scratch, name
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = rows.withColumn("row", F.monotonically_increasing_id())  # deals equal rows out, too
        ranged = keyed.repartitionByRange(partitions, *keys, "row").sortWithinPartitions(*keys, "row")
        kept = [c for c in rows.columns if c not in keys[1:] or c == "place"]
        placed = scratch.save(ranged.select(*kept, F.monotonically_increasing_id().alias("at")), name)
        self.rows = placed.withColumn("range", F.shiftright("at", 33))

    def running(self, values: dict[str, tuple[str, Column]]) -> DataFrame:
        """The rows with running totals (sum or bit_xor of a column) over the turns of their conversation up to their own."""
        rows, call = self.rows, {n: (F.sum if how == "sum" else F.bit_xor) for n, (how, _) in values.items()}
        edges = self.scratch.save(rows.groupBy("range").agg(F.min("conv_id").alias("head"), F.max("conv_id").alias("tail")), f"{self.name}-edges")
        # one row per range: the broadcasts are bounded by the number of partitions
        last = rows.join(F.broadcast(edges), "range").where("conv_id = tail")
        last = last.groupBy("range").agg(F.max("tail").alias("key"), *(call[n](v).alias(n) for n, (_, v) in values.items()))
        first = edges.select("range", F.col("head").alias("key"), *(F.lit(0).cast("long").alias(n) for n in values))
        both = first.withColumn("kind", F.lit(0)).unionByName(last.withColumn("kind", F.lit(1)))
        before = Window.partitionBy("key").orderBy("range", "kind").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.select("range", "key", "kind", *(F.coalesce(call[n](n).over(before), F.lit(0)).alias(f"carried_{n}") for n in values))
        carried = carried.where("kind = 0").drop("kind")
        own = Window.partitionBy("range", "conv_id").orderBy("at")
        local = rows.select("*", *(call[n](v).over(own).alias(f"own_{n}") for n, (_, v) in values.items()))
        joined = local.join(F.broadcast(carried), "range")

        def total(n: str) -> Column:
            over = F.when(F.col("conv_id") == F.col("key"), F.col(f"carried_{n}")).otherwise(F.lit(0).cast("long"))
            added = F.col(f"own_{n}") + over if call[n] is F.sum else F.col(f"own_{n}").bitwiseXOR(over)
            return added.alias(n)

        return joined.select(*rows.columns, *map(total, values))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All conversations, with their number of rebuilt turns, and the rebuilt turns: conv_id, depth, key1, key2, bytes."""
    save = scratch.save
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.sha2(F.concat(F.sha2(role, 256), text), 256)
    given = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.xxhash64(digest).alias("hash1"), F.xxhash64(F.lit(1), digest).alias("hash2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    one = ("sum", F.lit(1).cast("long"))
    placed = save(Ordered(given, ["conv_id", "turn", "role", "text"], scratch, "given").running({"place": one}).drop("at", "range"), "placed")
    convs = placed.where("place = 1").select("conv_id")
    own = placed.where(F.col("place") > borrowed(F.col("conv_id")))
    lent = placed.where((F.pmod("conv_id", F.lit(GROUP)) == 0) & (F.col("place") <= MOST))
    lent = lent.withColumn("conv_id", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + GROUP - 1)))
    lent = lent.where(F.col("place") <= borrowed(F.col("conv_id"))).join(convs, "conv_id", "left_semi")
    ordered = Ordered(own.unionByName(lent), ["conv_id", "place"], scratch, "rebuilt")
    deep = ordered.running({"depth": one})
    mark = lambda *salt: F.xxhash64(*salt, "depth", "hash1", "hash2")
    ordered.rows, ordered.name = save(deep.withColumns({"mark1": mark(), "mark2": mark(F.lit(1))}), "deep"), "keyed"
    keyed = ordered.running({"key1": ("xor", F.col("mark1")), "key2": ("xor", F.col("mark2"))})
    keyed = save(keyed.select("conv_id", "depth", "key1", "key2", "bytes"), "keyed")
    lengths = convs.join(keyed.groupBy("conv_id").agg(F.max("depth").alias("turns")), "conv_id", "left")
    lengths = save(lengths.select("conv_id", F.coalesce("turns", F.lit(0).cast("long")).alias("turns")), "lengths")
    return lengths, keyed


def block(depth: str | Column) -> Column:
    return F.floor((F.col(depth) if isinstance(depth, str) else depth) / BLOCK).cast("long")


class Trie:
    """One run: ``nodes`` (with own values) and ``path``, the node at each depth of every conversation."""

    def __init__(self, turns: DataFrame, scratch: Scratch, limit: int = LIMIT):
        self.scratch, self.limit = scratch, limit
        save = scratch.save
        self.lengths, keyed = rebuilt(turns, scratch)
        root = self.lengths.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "key1", "key2", "bytes")))
        members = root.unionByName(keyed)
        # a long conversation's rows look its length up by blocks
        spans = self.lengths.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block("turns"))))
        members = members.withColumn("block", block("depth")).join(spans, ["conv_id", "block"])
        name = ["depth", "key1", "key2"]
        named = save(
            members.groupBy(*name).agg(
                F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
                F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
            ),
            "named",
        )
        self.path = self._path(root.unionByName(keyed).select("conv_id", *name), named.select(*name, "rep", "n_convs"))
        above = self.path.select(F.col("conv_id").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
        nodes = save(named.drop("key1", "key2").join(above, ["rep", "depth"], "left"), "parents")
        held = nodes.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = nodes.join(held, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        self.nodes = save(nodes, "nodes")

    def _path(self, members: DataFrame, named: DataFrame) -> DataFrame:
        """Members with their node's smallest one. Large nodes are few by their least size, and so broadcast; a small one has few rows."""
        name = ["depth", "key1", "key2"]
        least = max(LARGE, members.count() // SHARE)
        large = F.broadcast(named.where(F.col("n_convs") > least).drop("n_convs"))
        small = named.where(F.col("n_convs") <= least).drop("n_convs")
        rest = members.join(large, name, "left_anti").join(small, name)
        found = members.join(large, name).unionByName(rest).select("conv_id", "depth", "rep")
        return self.scratch.save(found, "path")

    def totals(self) -> DataFrame:
        """rep, depth, n_leaves and saved_tokens of every node, over its subtree."""
        save, found, turn = self.scratch.save, [], 0
        zero = F.lit(0).cast("long")
        root = self.nodes.where("depth = 0").select("rep", "weight").first() or (0, 0)
        state = self.nodes.select(
            "rep", "depth", "parent", "weight", (F.col("n_children") == 0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), zero.alias("sum_leaves"), zero.alias("sum_saved"),
            F.lit(root[0]).cast("long").alias("top"), zero.alias("top_depth"), F.lit(root[1]).cast("long").alias("total"),
        )
        state = save(state, "state0")
        small = []
        while True:
            small.append(state.where(F.col("total") <= self.limit))
            state = state.where(F.col("total") > self.limit)
            if state.isEmpty():
                break
            done, state = self._split(state, turn)
            found.append(done)
            turn += 1
        rest = reduce(DataFrame.unionByName, small).repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth")
        columns = ["top", "top_depth", "rep", "depth", "parent", "weight", "leaves", "saved", "sum_leaves", "sum_saved"]
        found.append(map_batches(rest.select(*columns), _finish, "rep long, depth long, n_leaves long, saved_tokens long"))
        return reduce(DataFrame.unionByName, found)

    def _spread(self, state: DataFrame, by_component: DataFrame) -> DataFrame:
        """``state`` with the columns of ``by_component``, which has the same totals: a component is dealt over keys by its weight."""
        ways = F.ceil(F.col("total") / self.limit)
        left = state.withColumn("way", F.pmod(F.xxhash64("rep", "depth"), ways))
        right = by_component.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)))
        return left.join(right.drop("total"), ["top", "top_depth", "way"]).drop("way")

    def _split(self, state: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Results of the centroids, and the state of all other nodes in the components they leave."""
        save = lambda df, name: self.scratch.save(df, f"{name}{turn}")
        heavy = state.where(2 * F.col("weight") >= F.col("total"))
        centroids = heavy.groupBy("top", "top_depth").agg(
            F.max("total").alias("total"), F.max_by(F.struct("rep", "weight"), "depth").alias("c"), F.max("depth").alias("c_depth")
        )
        centroids = save(centroids.select("top", "top_depth", "total", F.col("c.rep").alias("c_rep"), F.col("c.weight").alias("c_weight"), "c_depth"), "centroids")
        joined = save(self._spread(state, centroids).withColumn("block", block("depth")), "joined")
        below = F.col("depth") > F.col("c_depth")
        asked = joined.where(below).select("rep", "block", "c_rep", "c_depth").distinct()
        at = lambda by, name: self.path.select(F.col("conv_id").alias("rep"), (F.col("depth") - by).alias("c_depth"), F.col("rep").alias(name))
        answers = asked.join(at(0, "c_rep"), ["rep", "c_depth", "c_rep"]).join(at(1, "child"), ["rep", "c_depth"])
        sides = joined.join(answers, ["rep", "block", "c_rep", "c_depth"], "left")
        sides = save(sides.withColumn("child", F.when(below, F.col("child"))), "sides")
        is_centroid = (F.col("rep") == F.col("c_rep")) & (F.col("depth") == F.col("c_depth"))
        under = sides.where(is_centroid | F.col("child").isNotNull())
        sums = under.groupBy("c_rep", "c_depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sums = save(centroids.join(sums, ["c_rep", "c_depth"]), "sums")
        # the path from each centroid to its top, a block of depths at a time
        blocks = sums.withColumn("block", F.explode(F.sequence(block("top_depth"), block("c_depth"))))
        path = self.path.withColumn("block", block("depth"))
        on_path = blocks.join(path, (blocks["c_rep"] == path["conv_id"]) & (blocks["block"] == path["block"]))
        lifts = on_path.where("depth >= top_depth and depth <= c_depth").select(
            "rep", "depth", "more_leaves", "more_saved", F.when(F.col("depth") < F.col("c_depth"), F.col("c_weight")).otherwise(0).alias("less")
        )
        lifted = sides.join(lifts, ["rep", "depth"], "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        lifted = save(
            lifted.select(
                "rep", "depth", "parent", (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"), "leaves", "saved", plus("sum_leaves", "more_leaves"), plus("sum_saved", "more_saved"),
                F.coalesce("child", "top").alias("top"), F.when(F.col("child").isNotNull(), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
                "total", is_centroid.alias("done"),
            ),
            "lifted",
        )
        done = lifted.where("done").select("rep", "depth", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"))
        rest = lifted.where("not done").drop("done")
        sizes = save(rest.groupBy("top", "top_depth").agg(F.max("total").alias("total"), F.max("weight").alias("size")), "sizes")
        after = save(self._spread(rest, sizes).withColumn("total", F.col("size")).drop("size"), "after")
        self.scratch.drop(*(f"{n}{turn}" for n in ("joined", "sides", "sums", "centroids", "sizes")))
        return done, after

    def ends(self) -> DataFrame:
        """Hash of the ids of the conversations that end at a node: rep, depth, ends_sha256; nodes where none ends are missing."""
        last = self.lengths.select("conv_id", F.col("turns").alias("depth")).join(self.path, ["conv_id", "depth"]).select("rep", "depth", "conv_id")
        partitions = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = last.repartitionByRange(partitions, "rep", "depth", "conv_id").sortWithinPartitions("rep", "depth", "conv_id")
        texts = self.scratch.save(map_batches(ranged, _join_ids, "rep long, depth long, conv_id long, ids string"), "ids")
        dealt = texts.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "conv_id")
        return map_batches(dealt, _hash_ids, "rep long, depth long, ends_sha256 string")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node as texts of up to CHUNK bytes, with the first id of each."""
    node, first, held, size = None, None, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rep": [node[0]], "depth": [node[1]], "conv_id": [first], "ids": [",".join(held)]})

    for batch in batches:
        for rep, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (node != (rep, depth) or size >= CHUNK):
                yield row()
                held, size = [], 0
            if not held:
                node, first = (rep, depth), conv
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for batch in batches:
        done = []
        for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids"))):
            if node != (rep, depth):
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (rep, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["rep", "depth", "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["rep", "depth", "ends_sha256"])


def roll_up(parents: list[int], weights: list[int], values: list[tuple[int, ...]], sums: list[list[int]]) -> None:
    """Add to ``sums`` the subtree totals of a tree's nodes, by centroids; a node's parent comes before it, the top's is -1."""
    children: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    gone, tops = [False] * len(parents), [0] if parents else []
    while tops:
        top = centroid = tops.pop()
        step = top
        while step >= 0:
            centroid = step
            step = next((c for c in children[centroid] if not gone[c] and 2 * weights[c] >= weights[top]), -1)
        total, open_nodes = [0] * len(values[centroid]), [centroid]
        while open_nodes:
            i = open_nodes.pop()
            total = [a + b for a, b in zip(total, values[i])]
            open_nodes += [c for c in children[i] if not gone[c]]
        i, less = centroid, weights[centroid]
        while True:
            sums[i] = [a + b for a, b in zip(sums[i], total)]
            if i == top:
                break
            i = parents[i]
            weights[i] -= less
        gone[centroid] = True
        tops += [c for c in children[centroid] if not gone[c]]
        if centroid != top:
            tops.append(top)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the components that come one after the other, the top of each first."""
    component, rows = None, []

    def result() -> pa.RecordBatch:
        number = {(r[0], r[1]): i for i, r in enumerate(rows)}
        parents = [-1 if i == 0 else number[r[2], r[1] - 1] for i, r in enumerate(rows)]
        sums = [list(r[6:8]) for r in rows]
        roll_up(parents, [r[3] for r in rows], [r[4:6] for r in rows], sums)
        columns = [[r[0] for r in rows], [r[1] for r in rows], [s[0] for s in sums], [s[1] for s in sums]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "depth", "n_leaves", "saved_tokens"])

    for batch in batches:
        for top, top_depth, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if component != (top, top_depth):
                if rows:
                    yield result()
                component, rows = (top, top_depth), []
            rows.append(row)
    if rows:
        yield result()


def prefix_trie(turns: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """One row per node, with its counts, its subtree's totals and the hash of the conversations that end there."""
    with broadcasts_by_shuffled_size(turns.sparkSession):
        trie = Trie(turns, scratch, limit)
        totals = scratch.save(trie.totals(), "totals")
        ends = trie.ends()
    found = trie.nodes.join(totals.hint("merge"), ["rep", "depth"]).join(ends.hint("merge"), ["rep", "depth"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
