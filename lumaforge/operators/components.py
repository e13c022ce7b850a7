"""Connected components of a graph given by its edges, in a number of rounds that grows with its logarithm."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaforge.operators.hamming import linked
from lumaforge.session import cut_lineage

#: Edges up to which one task labels them all; beyond, rounds of joins do.
SMALL_EDGES = 500_000


def connected(edges: DataFrame, small: int = SMALL_EDGES, rounds: list | None = None) -> DataFrame:
    """``id, component`` (its smallest id) of every id in the materialized edges ``a, b``.

    ``rounds`` gets one entry for each round of joins.
    """
    if edges.limit(small + 1).count() <= small:
        return _in_one_task(edges)
    return _in_rounds(edges, [] if rounds is None else rounds)


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        if parts:
            ids, place = np.unique(np.concatenate(parts), return_inverse=True)
            a, b = place.reshape(-1, 2).T
            label = linked(np.arange(len(ids)), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "id long, component long")


def _in_rounds(edges: DataFrame, rounds: list) -> DataFrame:
    """Each node points to one of its component; in a round, nodes and their pointees are hooked to the least
    grandparent among their neighbors, and pointers are doubled (Zhang, Azad and Hu 2020). Minima combine before
    they are shuffled, so a node with many neighbors is no special case.
    """
    links = edges.select(F.col("a").cast("long").alias("id"), F.col("b").cast("long").alias("other"))
    links = cut_lineage(links.unionByName(links.selectExpr("other AS id", "id AS other")).distinct())
    nodes = links.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("parent"))
    above = _grandparents(cut_lineage(nodes))
    while True:
        rounds.append(1)
        seen = links.join(above.selectExpr("id AS other", "grand AS near"), "other").groupBy("id").agg(F.min("near").alias("near"))
        found = above.join(seen, "id")
        offers = [
            found.selectExpr("id", "least(near, grand) AS parent"),
            found.selectExpr("parent AS id", "near AS parent"),
        ]
        new = reduce(DataFrame.unionByName, offers).groupBy("id").agg(F.min("parent").alias("parent"))
        above, before = _grandparents(cut_lineage(new)), above
        changed = above.join(before.selectExpr("id", "grand AS was"), "id").where("grand != was")
        if changed.isEmpty():
            return above.selectExpr("id", "grand AS component")


def _grandparents(nodes: DataFrame) -> DataFrame:
    """``id, parent, grand``."""
    up = nodes.selectExpr("id AS parent", "parent AS grand")
    return cut_lineage(nodes.join(up, "parent").select("id", "parent", "grand"))
