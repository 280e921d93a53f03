"""Graph queries over edge tables (src, dst): reachability, depth, cycles.

All loops run on the driver over distributed frontiers; every round is written
to the shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a cyclic residue that the driver takes over; a larger one stays distributed.
SMALL_RESIDUE = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in spark.checkpoint.dir; computed once.

    Only where that is unset, and driver and executors are one process (tests),
    is a local folder used.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/docweave-checkpoints"
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): what is reachable from each root, roots included at depth 0.

    A forest whose roots are asked for is answered by pointer doubling, in
    log2(depth) rounds; any other graph breadth first, a round a level.  A node
    keeps its least depth, and cycles end by themselves.
    """
    steps = cut(edges.select("src", "dst").distinct())
    roots = cut(roots.select("node").distinct())
    if max_depth is None and _is_forest(steps, roots):
        return _doubled(steps, roots)
    seen = cut(roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("depth")))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = (
            front.join(steps, front.node == steps.src)
            .select("root", F.col("dst").alias("node"))
            .distinct()
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
            .withColumn("depth", F.lit(depth).cast("long"))
        )
        front = cut(nxt)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def _is_forest(steps: DataFrame, roots: DataFrame) -> bool:
    """Whether no node has several edges into it, and no root has one."""
    several = steps.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1")
    return several.isEmpty() and steps.join(roots.select(F.col("node").alias("dst")), "dst", "left_semi").isEmpty()


def _doubled(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """Each node's ancestor 1, 2, 4, ... steps above it, until that is a root or there is none left."""
    ends = roots.select(F.col("node").alias("above"), F.lit(True).alias("at_root"))
    up = steps.select(F.col("dst").alias("node"), F.col("src").alias("above"), F.lit(1).cast("long").alias("n"))
    up = cut(up.join(ends, "above", "left").withColumn("at_root", F.coalesce("at_root", F.lit(False))))
    most, reached = up.count(), 1
    while reached <= most and not (left := up.where("NOT at_root")).isEmpty():
        hop = up.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("n").alias("more"), F.col("at_root").alias("end"))
        moved = left.join(hop, "above").select(F.col("next").alias("above"), "node", (F.col("n") + F.col("more")).alias("n"), F.col("end").alias("at_root"))
        up = cut(up.where("at_root").unionByName(moved))
        reached *= 2  # what is longer than all edges runs round a cycle, which no root reaches
    found = up.where("at_root").select(F.col("above").alias("root"), "node", F.col("n").alias("depth"))
    return roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("depth")).unionByName(found)


def peel(edges: DataFrame) -> DataFrame:
    """Edges between nodes that lie on a cycle or between two cycles."""
    rest = cut(edges.select("src", "dst").distinct())
    n = rest.count()
    while n:
        kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = cut(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = kept.count()
        rest = kept
        if m == n:
            break
        n = m
    return rest


def cycle_members(edges: DataFrame, small: int = SMALL_RESIDUE) -> DataFrame:
    """(node, cycle): nodes on a cycle, each with the least node of its strongly connected component.

    Where every node has one edge at most, cycles are found in logarithmic
    rounds; any other graph loses its tails first, a link a round.
    """
    if edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _functional_cycles(edges)
    rest = peel(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")).distinct()
    if rest.isEmpty():
        return loops
    if rest.limit(small + 1).count() <= small:
        found = _tarjan([(r.src, r.dst) for r in rest.collect()])
        kind = edges.schema["src"].dataType.simpleString()
        comps = edges.sparkSession.createDataFrame(found, f"node {kind}, cycle {kind}")
    else:
        comps = _components(rest)
    return comps.unionByName(loops).groupBy("node").agg(F.min("cycle").alias("cycle"))


def _functional_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that 1, 2, 4, ... steps lead to, and the least node on each way; in the end all of them lie on cycles."""
    way = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("src").alias("cycle")).distinct())
    n, reached = way.count(), 1
    while reached < n:
        hop = way.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("cycle").alias("more"))
        way = cut(way.join(hop, "to").select("node", F.col("next").alias("to"), F.least("cycle", "more").alias("cycle")))
        reached *= 2
    return way.join(way.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", "cycle")


def _tarjan(edges: list[tuple]) -> list[tuple]:
    """Components of several nodes, without recursion."""
    to: dict = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
        to.setdefault(b, [])
    index, low, on, stack, out = {}, {}, set(), [], []
    for start in to:
        if start in index:
            continue
        work = [(start, iter(to[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, children = work[-1]
            for child in children:
                if child not in index:
                    index[child] = low[child] = len(index)
                    stack.append(child)
                    on.add(child)
                    work.append((child, iter(to[child])))
                    break
                if child in on:
                    low[node] = min(low[node], index[child])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    comp = []
                    while True:
                        comp.append(stack.pop())
                        on.discard(comp[-1])
                        if comp[-1] == node:
                            break
                    if len(comp) > 1:
                        out += [(x, min(comp)) for x in comp]
    return out


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Least colour that reaches each node along the edges."""
    while True:
        via = edges.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c")
        nxt = cut(colour.unionByName(via).groupBy("node").agg(F.min("c").alias("c")))
        changed = nxt.join(colour.withColumnRenamed("c", "old"), "node").where("c <> old")
        if changed.isEmpty():
            return nxt
        colour = nxt


def _components(rest: DataFrame) -> DataFrame:
    """Strongly connected components by forward colours and a backward search inside each colour."""
    done = None
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colour = _spread(rest, nodes.withColumn("c", F.col("node")))
        inside = (
            rest.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
            .where("cs = cd")
            .select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        inside = cut(inside)
        roots = colour.where("node = c").select("node")
        back = reach(inside, roots).select("node", F.col("root").alias("cycle"))
        sizes = back.groupBy("cycle").count().where("count > 1").select("cycle")
        found = cut(back.join(sizes, "cycle", "left_semi").select("node", "cycle"))
        done = found if done is None else done.unionByName(found)
        rest = rest.join(back.select(F.col("node").alias("src")), "src", "left_anti")
        rest = peel(rest.join(back.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return done
