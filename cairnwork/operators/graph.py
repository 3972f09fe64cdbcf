"""Call-graph reachability by a frontier that Spark joins with the edges, one hop a round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, stored


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, hops, via: every node reachable from each start by the fewest hops.

    edges: src, dst. starts: start. ``via`` is the smallest predecessor at that distance (null for the start),
    so routes read off it are the same in every run. Each round joins only the newest nodes, until there are none.
    """
    seen = cut(starts.select("start").filter("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast(edges.schema["src"].dataType).alias("via")))
    if seen.isEmpty():
        return seen
    # Read once a round.
    edges = stored(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    frontier = seen
    for hop in count(1):
        step = frontier.join(edges, F.col("node") == F.col("src")).groupBy("start", "dst").agg(F.min("src").alias("via"))
        fresh = step.select("start", F.col("dst").alias("node"), F.lit(hop).alias("hops"), "via").join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = cut(fresh.select("start", "node", "hops", "via"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier)) if hop % 8 == 0 else seen.unionByName(frontier)


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node: the starts and all that can be reached from any of them, each once, whatever start it was reached from.

    edges: src, dst. starts: node. The pairs of ``reach`` are never made, so this is bounded by the nodes.
    """
    edges = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    seen = frontier = cut(starts.select("node").filter("node is not null").distinct())
    for hop in count(1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier)) if hop % 8 == 0 else seen.unionByName(frontier)


def routes(reached: DataFrame, goals: DataFrame, sep: str = " > ") -> DataFrame:
    """start, goal, hops, route: the nodes of a shortest route in order, joined by ``sep``.

    Walks ``via`` back from all goals together, one join a hop.
    """
    back = cut(reached.select(F.col("start").alias("s"), F.col("node").alias("n"), F.col("hops").alias("h"), F.col("via").alias("v")))
    first = goals.select(F.col("from").alias("start"), "goal").join(back, (F.col("start") == F.col("s")) & (F.col("goal") == F.col("n")))
    at = first.select(F.col("s").alias("start"), F.col("n").alias("goal"), F.col("h").alias("hops"), F.array("n").alias("route"), F.col("v").alias("via"))
    done = None
    while True:
        at = cut(at)
        ended = at.filter("via is null").select("start", "goal", "hops", F.array_join("route", sep).alias("route"))
        done = ended if done is None else done.unionByName(ended)
        if at.filter("via is not null").isEmpty():
            return done
        on = at.select(F.col("start").alias("from"), "goal", "hops", "route", F.col("via").alias("by")).filter("by is not null")
        step = on.join(back, (F.col("from") == F.col("s")) & (F.col("by") == F.col("n")))
        at = step.select(F.col("s").alias("start"), "goal", "hops", F.concat(F.array("n"), F.col("route")).alias("route"), F.col("v").alias("via"))


def alias_closure(pairs: DataFrame, name: str, target: str) -> DataFrame:
    """name, final: where each alias ends, by pointer doubling; an alias in or into a cycle ends as null."""
    known = pairs.groupBy(name).agg(F.max(target).alias("to")).select(F.col(name).alias("name"), "to", F.lit(False).alias("lost"))
    state = known
    # A chain is no longer than there are names; what has not ended after as many steps is in or into a cycle.
    for _ in range(known.count().bit_length()):
        ahead = state.select(F.col("name").alias("n"), F.col("to").alias("next"))
        state = cut(state.join(ahead, F.col("to") == F.col("n"), "left").select("name", F.coalesce("next", "to").alias("to"), "lost"))
    looped = state.select(F.col("name").alias("n")).distinct()
    return state.join(looped, F.col("to") == F.col("n"), "left").select(F.col("name"), F.when(F.col("n").isNull(), F.col("to")).alias("final"))
