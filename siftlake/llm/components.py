"""Connected components by contraction, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (u, v): label is the least node of its component.

    Each round every node points to its least neighbour, or itself; pointers are followed twice, links are drawn
    between what their ends point to, and those within one node vanish. The nodes with a link left at least halve.
    Neighbours are never gathered, only their minimum, and every join's sides are tables, so a node with very many
    links is split. Rounds are cut by tables in the shared folder.
    """
    edges, labels, used = links.select("u", "v").where("u <> v").distinct(), None, []
    while True:
        edges = materialise(edges, "links")
        discard(*used)
        if edges.isEmpty():
            break
        both = edges.union(edges.select("v", "u"))
        to = materialise(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("to")), "pointers")
        used = [edges, to]
        for _ in range(2):
            up = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = materialise(to.join(up, "to").select("node", F.col("next").alias("to")), "pointers")
            used.append(to)
        if labels is None:
            new = to.select("node", F.col("to").alias("label"))
        else:
            used.append(labels)
            new = labels.join(to.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = materialise(new, "labels")
        ends = edges.join(to.select(F.col("node").alias("u"), F.col("to").alias("pu")), "u").select("v", "pu")
        ends = ends.join(to.select(F.col("node").alias("v"), F.col("to").alias("pv")), "v")
        edges = ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u <> v").distinct()
    return labels if labels is not None else links.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0)
