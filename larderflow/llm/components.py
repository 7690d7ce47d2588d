"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm.scratch import Scratch


def _step(edges: DataFrame, rows: int, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """Relinks each node's larger (or smaller) neighbours to the least node around it.

    The least neighbour is a partial aggregate; edges and minima are then joined
    as two plain tables, so adaptive execution can split a node of many links.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(sides.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), f"{name}-least", 2 * rows)
    joined = sides.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return scratch.table(out.filter("u != v").distinct(), name, 2 * rows)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, label`` for every node of ``edges`` (u, v: long) that isn't its component's least; label is the least."""
    now = scratch.table(edges.filter("u != v").select("u", "v").distinct(), "star0")
    turn, was, rows = 0, None, now.count()
    while True:
        turn += 1
        large = _step(now, rows, scratch, f"large{turn}", True)
        small = _step(large, rows, scratch, f"small{turn}", False)
        state = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        scratch.drop(f"large{turn}", f"large{turn}-least", f"small{turn}-least", f"small{turn - 1}", "star0")
        now, rows = small, state["n"]
        if state == was or not state["n"]:  # the same edges again: all are links to a least node
            return small.select("u", F.col("v").alias("label"))
        was = state
