"""Connected components by repeated contraction, on DataFrame functions.

Each round hooks every node to its least neighbour, follows the hooks twice, and
renames the links; at least half of the nodes that still have a link go away, so
the rounds are logarithmic in the nodes.  Minimums are combined inside each task
first, so a node with very many links costs one row a task.  Rounds are written
to the shared folder, which cuts the lineage; nothing is sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, is_empty


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``a, b`` links -> ``node, component``: the least node reachable, for every
    node that has a link to another one.  Repeated links and self links are
    harmless; an empty table gives an empty one."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.save(edges, f"{name}-edges-0")
    mapping: DataFrame | None = None
    turn = 0
    while not is_empty(edges):
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        hooks = scratch.save(least.select("node", F.least("node", "low").alias("root")), f"{name}-hooks-{turn}")
        for _ in range(2):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            hooks = hooks.join(up, "root").select("node", F.col("top").alias("root"))
        hooks = scratch.save(hooks, f"{name}-roots-{turn}")
        if mapping is None:
            mapping = hooks.withColumnRenamed("root", "component")
        else:
            up = hooks.select(F.col("node").alias("component"), "root")
            mapping = mapping.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        mapping = scratch.save(mapping, f"{name}-map-{turn}")
        at, to = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        renamed = edges.join(at, "a").join(to, "b").where("ra != rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        edges = scratch.save(renamed, f"{name}-edges-{turn}")
        scratch.drop(f"{name}-edges-{turn - 1}", f"{name}-hooks-{turn}", f"{name}-roots-{turn}", f"{name}-map-{turn - 1}")
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping
