"""Connected components by contraction, without a collected graph.

Each round hooks every vertex to its smallest smaller neighbour, flattens those
pointers by doubling, and rewrites the edges between the roots that are left.
The number of live vertices at least halves in every component that has an edge,
so the rounds are logarithmic; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.storage import Scratch


def _flatten(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, p) with p < u: every u pointed at the root of its tree."""
    while True:
        up = pointers.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = scratch.cut(
            pointers.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jump"
        )
        scratch.drop(pointers)
        pointers = step
        if pointers.filter("moved").isEmpty():
            return pointers


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``edges(a, b)`` of one orderable type to ``(id, component)``.

    The component is the smallest id that can be reached.  Only ids on an edge
    between two different ids are returned; null ends and loops are no edges.
    An empty input gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    live = scratch.cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    done: DataFrame | None = None
    while done is None or not live.isEmpty():
        hooked = scratch.cut(live.groupBy("u").agg(F.min("v").alias("p")), "hook")
        roots = _flatten(hooked, scratch).select("u", "p")
        if done is None:
            ends = live.select(F.explode(F.array("u", "v")).alias("id")).distinct()
            step = ends.join(roots, ends["id"] == roots["u"], "left").select("id", F.coalesce("p", "id").alias("component"))
        else:
            step = done.join(roots, done["component"] == roots["u"], "left").select("id", F.coalesce("p", "component").alias("component"))
        done = scratch.cut(step, "labels")
        a, b = roots.toDF("u", "pu"), roots.toDF("v", "pv")
        moved = (
            live.join(a, "u", "left").join(b, "v", "left")
            .select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y"))
            .filter("x <> y")
            .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        )
        after = scratch.cut(moved, "edges")
        scratch.drop(live)
        live = after
    return done
