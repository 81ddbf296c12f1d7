"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle, shared_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of `edges` (u, v: long) with the smallest node it reaches.

    Each round hangs a node below its smallest neighbour, jumps over two parents,
    and rewrites the edges between what is left; nodes that still have edges at
    least halve. The smallest neighbour is an aggregate, so a node with very many
    edges costs no more than a partial sum. Rounds end in written tables, and the
    table of a round is removed when the next one no longer needs it.
    Nulls and self-links are left out; no edges give an empty table.
    Returns (node, component).
    """
    spark, base = edges.sparkSession, shared_dir(edges.sparkSession)
    edges = settle(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{base}/e0")
    labels, k = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("up"))
        for j in range(2):
            up = settle(up, f"{base}/up{k}_{j}")
            above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
            up = up.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up"))
        up = settle(up, f"{base}/up{k}")
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            moved = up.select(F.col("node").alias("component"), "up")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = settle(labels, f"{base}/l{k}")
        for side in ("u", "v"):
            edges = edges.join(up.select(F.col("node").alias(side), "up"), side, "left").select(F.coalesce("up", side).alias(side), "v" if side == "u" else "u")
        edges = settle(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{base}/e{k + 1}")
        for old in (f"e{k}", f"up{k}_0", f"up{k}_1", f"up{k}", f"l{k - 1}"):
            discard(spark, f"{base}/{old}")
        k += 1
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def grown(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, component) of a graph to which edges (u, v) are added: only what these join is worked on."""
    base = shared_dir(edges.sparkSession)
    for side in ("u", "v"):
        own = labels.select(F.col("node").alias(side), "component")
        edges = edges.join(own, side, "left").select(F.coalesce("component", side).alias(side), "v" if side == "u" else "u")
    more = connected_components(edges)
    moved = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = more.join(labels.select("node"), "node", "left_anti")
    return settle(moved.unionByName(fresh), f"{base}/labels")
