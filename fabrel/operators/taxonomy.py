"""Taxonomies: names joined to nodes, and each node's line of ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CycleError
from ..storage import Scratch


def named_nodes(nodes: DataFrame, names: DataFrame, *, on: str = "id", kind: str | None = "scientific name", limit: int | None = None) -> DataFrame:
    """nodes joined with their names (`on`, name, kind): those of one kind, the first by text where a node has several; only nodes
    that have a name, the first `limit` by `on`."""
    chosen = (names if kind is None else names.where(F.col("kind") == kind)).groupBy(on).agg(F.min("name").alias("name"))
    out = nodes.join(chosen, on)
    return out if limit is None else out.orderBy(on).limit(limit)


def lineage(nodes: DataFrame, *, on: str = "id", parent: str = "parent") -> DataFrame:
    """(on, root, depth, line) of each node: line is the ids from the root down to the node, depth its length less one.

    A node without a parent, with itself as parent, or with one that is no node is a root. By pointer jumping: each node knows
    its line up to some ancestor; a round joins it with that ancestor's own line, which doubles the lines, so there are as many rounds
    as the depth has binary digits. Lines that have reached a root stay out of the join. A cycle raises CycleError.
    """
    scratch = Scratch(nodes.sparkSession, "lineage")
    known = nodes.select(F.col(on).alias("id"), F.col(parent).alias("up"))
    there = known.select(F.col("id").alias("up")).distinct().withColumn("__there", F.lit(True))
    state = known.join(there, "up", "left").select("id", F.when(F.col("__there") & (F.col("up") != F.col("id")), F.col("up")).alias("up"), F.array("id").alias("line"))
    state = scratch.written(state, "lines-0")
    total, turn = state.count(), 0
    while left := state.where("up IS NOT NULL").count():
        if 1 << turn > 2 * total:
            raise CycleError(f"{left} nodes lead to no root")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("__next"), F.col("line").alias("__above"))
        met = state.where("up IS NOT NULL").join(above, "up").select("id", F.col("__next").alias("up"), F.concat("__above", "line").alias("line"))
        turn += 1
        state = scratch.written(met.unionByName(state.where("up IS NULL")), f"lines-{turn}")
        scratch.drop(f"lines-{turn - 1}")
    return state.select(F.col("id").alias(on), F.col("line")[0].alias("root"), (F.size("line") - 1).alias("depth"), "line")
