"""Connected components of an edge list, as DataFrame joins and partial aggregates.

Each round hooks every node that has a smaller neighbour to its smallest neighbour, shortens
the hooks to stars by pointer jumping, and rewrites the edges onto the stars' centres. Edges
between two nodes of one star vanish, so the edge list shrinks every round. Hooks always lead
to smaller ids, hence no cycle and a component's label is its smallest id. Nothing is collected;
every round is a Parquet table in the shared folder, and the tables of earlier rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, scratch_tables


def _stars(hooks: DataFrame) -> DataFrame:
    """hooks(node, top), top < node: replace every top by the end of its chain."""
    while True:
        nxt = hooks.select(F.col("node").alias("top"), F.col("top").alias("over"))
        jumped = materialize(
            hooks.join(nxt, "top", "left").select(
                "node", F.coalesce("over", "top").alias("top"), F.col("over").isNotNull().alias("moved")
            ),
            "stars",
        )
        hooks = jumped.select("node", "top")
        if not jumped.where("moved").limit(1).count():
            return hooks


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge to another node.

    ``edges`` holds long ids in columns ``a`` and ``b``, in either order, with repeats and
    self-links allowed (they have no effect); rows with a null end are ignored. An empty edge
    list gives an empty table.
    """
    since = scratch_tables()
    e = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct(),
        "edges",
    )
    labels = None
    while e.limit(1).count():
        hooks = _stars(materialize(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("top")), "hooks"))
        if labels is None:
            labels = materialize(hooks.select("node", F.col("top").alias("component")), "labels")
        else:
            over = hooks.select(F.col("node").alias("component"), "top")
            moved = labels.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            # a centre of an earlier round that is hooked now has no label row of its own yet
            new = hooks.join(labels.select("node"), "node", "left_anti").select("node", F.col("top").alias("component"))
            labels = materialize(moved.unionByName(new), "labels")
        hi = hooks.select(F.col("node").alias("hi"), F.col("top").alias("hi_top"))
        lo = hooks.select(F.col("node").alias("lo"), F.col("top").alias("lo_top"))
        e = materialize(
            e.join(hi, "hi", "left")
            .join(lo, "lo", "left")
            .select(F.coalesce("hi_top", "hi").alias("x"), F.coalesce("lo_top", "lo").alias("y"))
            .where(F.col("x") != F.col("y"))
            .select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
            .distinct(),
            "edges",
        )
        drop_scratch(since, e, labels)
    if labels is None:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    centres = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(centres)
