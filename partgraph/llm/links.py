"""Connected components of a table of links, by contraction; nothing is gathered on the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``label``, the smallest node it is linked with, for every node of ``edges`` (a, b).

    In each round every label takes the smallest label next to it, follows it as far as that one's own, and links
    become links between the new labels; links within one label vanish. The tables of a round replace those before.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    links = scratch.save(both, f"{name}-links0")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = scratch.save(nodes.select("node", F.col("node").alias("label")), f"{name}-labels0")
    turn = 0
    while not links.isEmpty():
        sides = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = scratch.save(
            sides.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), f"{name}-hooks{turn}"
        )
        above = hooked.select(F.col("a").alias("to"), F.col("to").alias("top"))
        hooks = scratch.save(
            hooked.join(above, "to", "left").select("a", F.coalesce("top", "to").alias("to")), f"{name}-tops{turn}"
        )
        moved = labels.join(hooks.select(F.col("a").alias("label"), "to"), "label", "left")
        new_labels = scratch.save(moved.select("node", F.coalesce("to", "label").alias("label")), f"{name}-labels{turn + 1}")
        a = hooks.select("a", F.col("to").alias("new_a"))
        b = hooks.select(F.col("a").alias("b"), F.col("to").alias("new_b"))
        left = scratch.save(links.join(a, "a").select("new_a", "b"), f"{name}-half{turn}")
        renamed = left.join(b, "b").where("new_a <> new_b")
        pairs = renamed.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct()
        links = scratch.save(pairs, f"{name}-links{turn + 1}")
        scratch.drop(*(f"{name}-{part}{turn}" for part in ("links", "labels", "hooks", "tops", "half")))
        labels, turn = new_labels, turn + 1
    return labels
