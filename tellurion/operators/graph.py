"""Graphs as edge tables: components, levels, closures and longest paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.sources.shared import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node reachable, of every node with an edge to another, by alternating stars.

    Each step is a min by node and an equi-join; it ends after a step that changes nothing.
    """
    e = stash(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        last, e = e, stash(large.join(m, "u").select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct())
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    nodes = edges.select(F.col("u").cast("long").alias("node")).union(edges.select(F.col("v").cast("long"))).distinct()
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def levels(edges: DataFrame, depth: int = 50) -> DataFrame:
    """(node, level) of an acyclic graph of edges u -> v: the length of the longest path to it. A path over depth raises, as a cycle has one."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    front = stash(nodes.join(edges.select(F.col("v").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("level")))
    out = front
    for i in range(1, depth + 2):
        front = stash(front.join(edges, front["node"] == edges["u"]).select(F.col("v").alias("node")).distinct().select("node", F.lit(i).alias("level")))
        if front.isEmpty():
            return out.groupBy("node").agg(F.max("level").alias("level"))
        out = out.unionByName(front)
    raise ValueError(f"a path is longer than {depth}: the graph may have a cycle")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, distance) of all that can be reached from each root, the root itself left out; distance is the shortest. Cycles do no harm."""
    seen = None
    front = roots.select(F.col("node").alias("root"), "node")
    for i in count(1):
        step = front.join(edges, front["node"] == edges["u"]).select("root", F.col("v").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = stash(step)
        if front.isEmpty():
            break
        found = front.withColumn("distance", F.lit(i))
        seen = found if seen is None else seen.unionByName(found)
        if i % 4 == 0:  # one table, so that the plan doesn't grow with the distance
            seen = stash(seen)
    return seen if seen is not None else front.withColumn("distance", F.lit(0))


def critical_path(edges: DataFrame, nodes: DataFrame, depth: int = 50) -> DataFrame:
    """(node, distance, place) of the longest path by the nodes' cost (node, cost), place 0 its end; of equally long ones the smallest nodes.

    Levels are settled one after another, so each node's distance is final when it is passed on; the path is then followed back, a row at a time.
    """
    order = levels(edges, depth)
    placed = stash(nodes.join(order, "node", "left").select("node", "cost", F.coalesce("level", F.lit(0)).alias("level")))
    top = placed.agg(F.max("level")).first()[0] or 0
    done = stash(placed.where("level = 0").select("node", F.col("cost").alias("distance"), F.lit(None).cast("long").alias("via")))
    for i in range(1, top + 1):
        mine = placed.where(F.col("level") == i)
        into = mine.join(edges, mine["node"] == edges["v"]).select("node", "cost", "u").join(done.select(F.col("node").alias("u"), "distance"), "u")
        best = into.groupBy("node", "cost").agg(F.max(F.struct("distance", (-F.col("u")).alias("m"))).alias("b"))
        done = done.unionByName(best.select("node", (F.col("cost") + F.col("b.distance")).alias("distance"), (-F.col("b.m")).alias("via")))
        if i % 4 == 0:
            done = stash(done)
    done = stash(done)
    at = done.orderBy(F.desc("distance"), "node").first()
    path = []
    while at is not None:  # no longer than depth
        path.append((at["node"], at["distance"], len(path)))
        at = done.where(F.col("node") == at["via"]).first() if at["via"] is not None else None
    return edges.sparkSession.createDataFrame(path, "node long, distance double, place int")


def fingerprint(edges: DataFrame) -> DataFrame:
    """One row: n and a hash of a graph's edges that no order of theirs bears on; edges are hashed one by one and summed, so none are gathered."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(">", F.col("u").cast("string"), F.col("v").cast("string")), 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    return edges.distinct().agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *[F.sum(part(i)).cast("string") for i in range(4)]), 256).alias("hash"))


def delete_with_dependents(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (node) less the roots and all that depends on them."""
    gone = descendants(edges, roots).select("node").union(roots.select("node")).distinct()
    return nodes.join(gone, "node", "left_anti")
