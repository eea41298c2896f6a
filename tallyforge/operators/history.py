"""Ancestry in a graph of commits, from the asked tips only.

A node with one parent lies in a run: it leads, one parent after the other, up to a top, which is a root or a merge. Runs are indexed by
doubling, so the ancestor 2**j steps up is one lookup, and a chain of any length takes its logarithm in rounds. Generation numbers
(longer than every parent's) tell which of two tips can lie above the other. A question lifts the younger tip inside its
run; only where runs differ does it go on from the parents of the merge, and never below the other tip's generation.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.incremental import work_folder

#: More doublings than any acyclic history has.
DEEPEST = 48


@dataclass
class History:
    """up[j]: (node, up), the ancestor 2**j steps up in the node's run; places: (node, top, depth, gen); merges: (node, parent) of tops with parents."""

    folder: str
    up: list[DataFrame]
    places: DataFrame
    merges: DataFrame

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def index(edges: DataFrame, ranked: bool = True, of: DataFrame | None = None) -> History:
    """The index of edges(child, parent); edges with a null end are none, repeated ones count once. A cycle is an error.

    ranked: with generation numbers, which above() asks for. of(node): these nodes and the parents of merges are the only ones with places.
    """
    h = History(work_folder(edges.sparkSession), [], edges, edges)
    e = edges.select("child", "parent").where("child is not null and parent is not null")
    # one parent where the least is the greatest; the edges themselves are not dealt out before that
    ends = h.written(e.groupBy("child").agg(F.min("parent").alias("lo"), F.nullif(F.max("parent"), F.min("parent")).alias("more")), "ends")
    single = ends.where("more is null").select(F.col("child").alias("node"), F.col("lo").alias("up"))
    h.merges = h.written(e.join(ends.where("more is not null").select("child"), "child", "left_semi").distinct().select(F.col("child").alias("node"), "parent"), "merges")
    h.up = [single]
    # nodes that are tops stand at depth 0; the others take the steps of their highest bit, then the rest
    while not h.up[-1].isEmpty():
        if len(h.up) > DEEPEST:
            raise ValueError("the edges hold a cycle")
        last = h.up[-1]
        on = last.alias("a").join(last.alias("b"), F.col("a.up") == F.col("b.node"))
        h.up.append(h.written(on.select(F.col("a.node").alias("node"), F.col("b.up").alias("up")), "up"))
    h.up.pop()
    if of is None:
        nodes = ends.select(F.col("child").alias("node")).union(single.select("up")).union(h.merges.select("parent")).distinct()
    else:
        nodes = of.select("node").union(h.merges.select("parent")).where("node is not null").distinct()
    at = nodes.select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("depth"))
    for j in reversed(range(len(h.up))):
        step = h.up[j].select(F.col("node").alias("top"), "up")
        at = at.join(step, "top", "left").select("node", F.coalesce("up", "top").alias("top"), (F.col("depth") + F.when(F.col("up").isNull(), 0).otherwise(1 << j)).alias("depth"))
    at = h.written(at, "runs")
    h.places = at
    if ranked:
        gens = _generations(h, at)
        at = at.withColumn("gen", F.col("depth") + 1) if gens is None else at.join(gens, "top").withColumn("gen", F.col("gen") + F.col("depth"))
        h.places = at.select("node", "top", "depth", "gen") if gens is None else h.written(at.select("node", "top", "depth", "gen"), "places")
    return h


def _generations(h: History, runs: DataFrame) -> DataFrame | None:
    """(top, gen): 1 for roots, else more than any parent's; one round for each merge on the longest way. None where all tops are roots."""
    if h.merges.isEmpty():
        return None
    tops = runs.where("depth = 0").select("top", F.lit(1).cast("long").alias("gen"))
    p = runs.select(F.col("node").alias("parent"), F.col("top").alias("above"), (F.col("depth") + 1).alias("weight"))
    links = h.written(h.merges.join(p, "parent").groupBy(F.col("node").alias("top"), "above").agg(F.max("weight").alias("weight")), "links")
    known = h.written(tops, "gen")
    moved, n, most = known, 0, links.select("top").distinct().count()
    while True:
        n += 1
        if n > most + 1:
            raise ValueError("the edges hold a cycle")
        new = moved.select(F.col("top").alias("above"), "gen").join(links, "above").groupBy("top").agg(F.max(F.col("gen") + F.col("weight")).alias("new"))
        moved = h.written(new.join(known, "top").where("new > gen").select("top", F.col("new").alias("gen")), "moved")
        if moved.isEmpty():
            return known
        known = h.written(known.join(moved.withColumnRenamed("gen", "new"), "top", "left").select("top", F.coalesce("new", "gen").alias("gen")), "gen")


def above(h: History, asked: DataFrame) -> DataFrame:
    """The pairs of asked(child, ancestor) that hold: ancestor lies above child, by one step or more. Distinct; tips outside the graph have no ancestor."""
    a = h.places.select(F.col("node").alias("ancestor"), F.col("top").alias("a_top"), F.col("depth").alias("a_depth"), F.col("gen").alias("a_gen"))
    left = asked.select("child", "ancestor").where("child <> ancestor").distinct().join(a, "ancestor").withColumn("node", F.col("child"))
    hits, n = [], 0
    while True:
        here = left.join(h.places, "node").where("gen >= a_gen")
        # in the ancestor's own run: as many steps up as their depths differ
        same = here.where("top = a_top and depth >= a_depth").select("child", "ancestor", "node", (F.col("depth") - F.col("a_depth")).alias("steps"))
        far = here.where("top <> a_top").select("child", "ancestor", "a_top", "a_depth", "a_gen", "top").distinct()
        for j, up in enumerate(h.up):
            moved = same.join(up, "node", "left")
            same = moved.select("child", "ancestor", F.when(F.col("steps").bitwiseAND(F.lit(1 << j).cast("long")) != 0, F.col("up")).otherwise(F.col("node")).alias("node"), "steps")
        hits.append(h.written(same.where("node = ancestor").select("child", "ancestor").distinct(), "hits"))
        if h.merges.isEmpty():
            break
        n += 1
        on = far.join(h.merges.select(F.col("node").alias("top"), F.col("parent").alias("node")), "top").drop("top").distinct()
        left = h.written(on.join(hits[-1], ["child", "ancestor"], "left_anti"), "left")
        if left.isEmpty():
            break
    out = hits[0]
    for more in hits[1:]:
        out = out.union(more)
    return out.distinct()


def reached(h: History, tips: DataFrame) -> DataFrame:
    """(node, level): tips(node, level) and all that lies above them, each node once with the highest level of a tip from which it is reached.

    Rounds go from merge to merge; runs are filled once, by doubling.
    """

    def highest(df: DataFrame) -> DataFrame:
        return df.groupBy("node").agg(F.max("level").alias("level"))

    every = new = h.written(highest(tips.select("node", "level").where("node is not null")), "tips")
    over = h.merges.select(F.col("node").alias("top"), F.col("parent").alias("node"))
    while not h.merges.isEmpty():
        tops = new.join(h.places, "node").groupBy("top").agg(F.max("level").alias("level"))
        up = highest(tops.join(over, "top"))
        known = highest(every).withColumnRenamed("level", "known")
        new = h.written(up.join(known, "node", "left").where("known is null or level > known").select("node", "level"), "tips")
        if new.isEmpty():
            break
        every = every.union(new)
    out = highest(every)
    for i, up in enumerate(h.up):
        out = out if i else h.written(out, "reached")
        out = h.written(highest(out.union(out.join(up, "node").select(F.col("up").alias("node"), "level"))), "reached")
    return out


def have_want(edges: DataFrame, wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """(node): what has to be sent for wanted(node) to one that offered(node): offers the graph lacks do not count, wants among
    the offers are held, and of all above the other wants goes what no held tip reaches."""
    # both sides in one pass: what a held tip reaches is held whatever else reaches it; an offer that the graph lacks and nobody wants reaches only itself
    tips = wanted.select("node", F.lit(1).alias("level")).union(offered.select("node", F.lit(2).alias("level")))
    h = index(edges, ranked=False, of=tips)
    return reached(h, tips).where("level = 1").select("node")
