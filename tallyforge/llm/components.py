"""Connected components of an edge list, by joins.

Every round each node takes the smallest label among its neighbours and then the label of
its label (pointer doubling), so the number of rounds follows the logarithm of the longest
chain, not its length. Each round is written to the shared folder; nothing but a count
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, saved

#: A node's edges go to tasks in lots of this many, more where very many nodes have more.
LOT = 256
#: So many nodes of more than a lot are broadcast at most.
HUBS = 50_000


def _with_least(edges: DataFrame, n_edges: int, least) -> tuple[DataFrame, DataFrame]:
    """(edges(u, v) with m: the least v of their u, a table of u, m): edges of a hub are dealt into lots.

    The lot grows with the edges so that no more than HUBS nodes can have more than one: these are broadcast.
    """
    lot = max(LOT, -(-n_edges // HUBS))
    low = saved(edges.groupBy("u").agg(least.alias("m"), F.ceil(F.count("*") / lot).alias("lots")), "least")
    hubs = F.broadcast(low.where("lots > 1").select("u", "lots"))
    left = edges.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("lots", F.lit(1).cast("long"))).alias("lot"))
    right = low.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))
    return left.join(right, ["u", "lot"]).select("u", "v", "m"), low


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest node reachable from each node.

    Rows with a null end and loops are ignored; repeated and reversed edges count once.
    No edges give no rows. Works by alternating large-star and small-star steps: both
    replace edges by edges towards a smaller node of the same component, until every
    component is a star round its smallest node. A node with very many edges is no task's alone.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = saved(e, "edges")
    before = e.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
    for _ in range(max_rounds):
        if not before["n"]:
            break
        # large star: every neighbour larger than the node goes to the smallest of node and neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung, low_large = _with_least(both, 2 * before["n"], F.least(F.min("v"), F.col("u")))
        large = saved(hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: every smaller neighbour, and the node itself, go to the smallest neighbour
        hung, low = _with_least(large, before["n"], F.min("v"))
        small = (
            hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        was, e = e, saved(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        for x in (was, large, low, low_large):
            drop(x)
        done = (now["n"], now["s"]) == (before["n"], before["s"])
        before = now
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
