"""Connected components over tables of links, by joins only.

Each round every node moves to the neighbour (or itself) that comes first in an
order drawn anew for the round, moves once more along its neighbour's choice,
and the links are rewritten between the nodes moved to.  Links inside a group
vanish, so the tables shrink by a constant factor a round, whatever the shape of
the graph.  Every round cuts its lineage with a checkpoint in the shared folder;
only one bit a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.session import cut_bare

MAX_ROUNDS = 100  # a bound against endless loops; each round is expected to halve the links at least


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node of it.

    Self links and repeated links change nothing; nodes without links have no row.
    """
    edges = cut_bare(links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    for turn in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        first = lambda node: F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), F.col(node).alias("n"))  # noqa: E731, B023
        ends = edges.select(F.col("a").alias("node"), first("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), first("a").alias("near")))
        chosen = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("near", first("node")).getField("n").alias("to"))
        chosen = cut_bare(chosen)
        moved = chosen.join(chosen.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))
        moved = cut_bare(moved)
        at = lambda end: moved.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))  # noqa: E731, B023
        edges = edges.join(at("a"), "a").join(at("b"), "b").filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        edges = cut_bare(edges)
        if roots is None:
            roots = moved.select("node", F.col("to").alias("root"))
        else:
            roots = cut_bare(roots.join(moved.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(names, "root").select("node", "component")
