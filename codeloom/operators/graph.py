"""Traversal of a directed graph: levels, closures, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import prepare, stage

#: Levels a walk takes at most.
MAX_DEPTH = 32


def walk(edges: DataFrame, starts: DataFrame, depth: int | None, budget: int | None = None) -> DataFrame:
    """(node, depth): the least number of steps from a start, up to depth (None: to the end);
    starts are at 0. With a budget no further level begins once that many nodes are reached.

    Each level joins the frontier only; nodes seen before leave by an anti-join, so cycles
    end. Levels are written to the shared folder, which keeps the plan short.
    """
    prepare(edges.sparkSession)
    steps = edges.select("src", "dst").distinct()
    frontier = stage(starts.select("node").distinct().withColumn("depth", F.lit(0)), "walk")
    seen = frontier
    level, reached_so_far = 0, 0
    while depth is None or level < min(max(depth, 1), MAX_DEPTH):
        level += 1
        reached = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stage(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if budget is not None:
            reached_so_far += frontier.count()
            if reached_so_far >= budget:
                break
    return seen


def back_edges(edges: DataFrame, walked: DataFrame) -> DataFrame:
    """(src, dst): edges of a walk that lead back to a node at the same or a smaller depth, once each."""
    a, b = walked.select(F.col("node").alias("src"), F.col("depth").alias("da")), walked.select(F.col("node").alias("dst"), F.col("depth").alias("db"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("db <= da").select("src", "dst")


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) joined by a path of one step or more; for small graphs of modules or types.

    Path lengths double each round.
    """
    prepare(edges.sparkSession)
    known = stage(edges.select("src", "dst").distinct(), "closure")
    count = known.count()
    while True:
        longer = known.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        known = stage(known.unionByName(longer).distinct(), "closure")
        now = known.count()
        if now == count:
            return known
        count = now


#: Edges that the driver may search for cycles itself; a few MB.
DRIVER_EDGES = 200_000


def cycles(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(component, node): strongly connected components of two nodes or more, or with a loop
    on one node, named by their smallest node.

    Graphs of files are small: up to driver_edges counted edges go to the driver. Larger ones
    lose nodes without a way in or out; then every node takes the smallest node that reaches
    it as its colour, and what leads back to that node inside the colour is a component.
    """
    spark = prepare(edges.sparkSession)
    every = stage(edges.select("src", "dst").distinct(), "cycle-edges")
    loops = every.where("src = dst").select(F.col("src").alias("component"), F.col("src").alias("node"))
    kind = every.schema["src"].dataType.simpleString()
    if every.count() <= driver_edges:
        rows = _components([(r[0], r[1]) for r in every.collect()])
        return spark.createDataFrame(rows, f"component {kind}, node {kind}")
    live, found = every.where("src <> dst"), []
    while True:
        live = _trimmed(live)
        if live.isEmpty():
            break
        nodes = live.select(F.col("src").alias("node")).distinct()
        colour = stage(nodes.withColumn("colour", F.col("node")), "cycle-colour")
        while True:
            sent = live.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            now = stage(colour.join(sent, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")), "cycle-colour")
            colour = now.select("node", "colour")
            if now.where("moved").isEmpty():
                break
        a, b = colour.toDF("src", "ca"), colour.toDF("dst", "cb")
        inside = stage(live.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"), "cycle-inside")
        back = walk(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour").select("node"), None)
        part = stage(back.select("node").join(colour, "node").select(F.col("colour").alias("component"), "node"), "cycle-part")
        sizes = part.groupBy("component").count().where("count > 1").select("component")
        found.append(part.join(sizes, "component", "left_semi"))
        gone = part.select("node")
        live = stage(live.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"), "cycle-live")
    out = loops
    for part in found:
        out = out.unionByName(part)
    return out.groupBy("node").agg(F.min("component").alias("component")).select("component", "node")


def _trimmed(live: DataFrame) -> DataFrame:
    """Edges whose ends both have a way in and a way out, over and over."""
    n = live.count()
    while n:
        ins, outs = live.select("dst").distinct(), live.select("src").distinct()
        live = stage(live.join(ins.toDF("src"), "src", "left_semi").join(outs.toDF("dst"), "dst", "left_semi"), "cycle-trim")
        now = live.count()
        if now == n:
            break
        n = now
    return live


def _components(edges: list[tuple]) -> list[tuple]:
    """(smallest, node) of the cyclic components of a small graph: two searches, by finishing times."""
    ahead, behind = {}, {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        behind.setdefault(b, []).append(a)
    order, seen = [], set()
    for start in sorted(ahead):
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead[start]))]
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(ahead.get(step, ()))))
    out, loops, seen = [], {a for a, b in edges if a == b}, set()
    for root in reversed(order):
        if root in seen:
            continue
        part, todo = [], [root]
        seen.add(root)
        while todo:
            node = todo.pop()
            part.append(node)
            more = [x for x in behind.get(node, ()) if x not in seen]
            seen.update(more)
            todo += more
        if len(part) > 1 or part[0] in loops:
            out += [(min(part), x) for x in part]
    return out
