"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import remove, stored

#: Over how many tasks the edges of one node are dealt.
SALTS = 16


def _both_ways(u: str, v: str, back_u: str, back_v: str):
    """Two rows (u, v) of one, so that what makes the table is planned once."""
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    return F.inline(F.array(pair(u, v), pair(back_u, back_v)))


def _with_least(edges: DataFrame) -> DataFrame:
    """Joins to each directed edge (u, v) the least node m of u's neighbours and u.

    A node's edges are dealt over SALTS tasks; the least node goes to those that hold some of them,
    which the bits of a mask tell. Both sides grow with the graph, and their files are small for
    their rows, so that Spark would take one for small enough to send through the driver: the join
    is a merge join by hint.
    """
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = dealt.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("mask"))
    held = F.filter(F.array(*map(F.lit, range(SALTS))), lambda i: F.getbit("mask", i) == 1)
    own = least.select("u", "m", F.explode(held).alias("salt"))
    return dealt.join(own.hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether each larger node u of distinct edges (u, v) has one edge and no v is a u elsewhere."""
    nodes = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("root")), F.struct(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("root")))))
    ends = nodes.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("root").alias("root"))
    return not ends.agg(F.coalesce(F.max(F.col("ups") + F.col("root")), F.lit(0)).alias("most")).first()["most"] > 1


def connected_components(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``, the root being the component's least node; nodes without an edge are left out.

    Each round links every larger neighbour of a node to the node's least one, then every smaller
    one. Rounds go on until the edges form stars; their number grows with the logarithm of a
    component's diameter. Each round's edges are written to the shared folder, where they replace
    those of the round before; only one number comes to the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now = stored(now, folder, "edges-0")
    for k in range(1, most_rounds + 1):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        larger = _with_least(now.select(_both_ways("u", "v", "v", "u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        smaller = _with_least(larger).select(_both_ways("v", "m", "u", "m")).filter("u != v").distinct()
        now = stored(smaller, folder, f"edges-{k}")
        remove(now.sparkSession, f"{folder}/edges-{k - 1}")
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def component_labels(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """``nodes(node)`` with ``component``, the least node reachable; a node without edges is its own."""
    found = connected_components(edges, folder)
    return nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
