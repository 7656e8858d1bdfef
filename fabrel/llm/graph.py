"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, looked_up


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _handed(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least of u's neighbours and itself; a hub's edges are not gathered in one task."""
    return looked_up(edges, least, ["u"], total)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of `edges` (u, v: long) the smallest node it is connected to.

    In each round every node hands its smallest neighbour to its larger ones, then to its smaller ones; rounds grow
    with the logarithm of the longest path. A node's neighbours are never gathered: minima are aggregated before the
    shuffle and joined back, those of hubs by broadcast. Each round is a table in the shared folder; the one before goes.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.written(e, "edges-0")
    before, turn = _state(e), 0
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("__n")), f"least-{turn}")
        large = _handed(both, least, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.written(large, f"large-{turn}")
        down = scratch.written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")), f"down-{turn}")
        small = _handed(large, down, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = scratch.written(small.where("u <> v").distinct(), f"edges-{turn + 1}")
        scratch.drop(f"edges-{turn}", f"least-{turn}", f"large-{turn}", f"down-{turn}")
        after, turn = _state(e), turn + 1
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
