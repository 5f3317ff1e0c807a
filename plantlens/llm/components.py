"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import counted, saved


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def rooted(hook: DataFrame) -> DataFrame:
    """(node, up) with every node at the root of its tree: pointers are doubled until none moves, so a tree of depth d takes about log2 d steps.

    Only the pointers of distinct parents are looked up, so a root of very many nodes is one row there.
    """
    hook = saved(hook)
    while True:
        parents = hook.select(F.col("up").alias("node")).distinct().join(hook, "node").where("up <> node")
        above, many = counted(parents.select(F.col("node").alias("up"), F.col("up").alias("higher")))
        if not many:
            return hook
        hook = saved(hook.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); a component's number is its least node.

    Each round hooks every node to its least neighbour (or leaves it, if it is
    itself less), goes up to the roots of the trees this gives, and replaces the
    edges by those between roots. A root that nobody hooks to is no root in the
    next round, as its neighbours have gone to lesser nodes; so every other round
    at least halves the nodes left, and n nodes take O(log n) rounds of O(log n)
    steps. A chain in order of its numbers is one round. All of it are joins and
    grouped minima over tables in the shared folder; nothing reaches the driver.
    """
    live, many = counted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    while many:
        hook = rooted(both_ways(live).groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up")))
        hooks.append(hook)
        first, second = hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = live.join(first, "a").join(second, "b").where("ua <> ub")
        live, many = counted(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if not hooks:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = hooks[0].select("node", F.col("up").alias("component"))
    for hook in hooks[1:]:
        found = found.join(hook.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return saved(found) if len(hooks) > 1 else found


def with_links(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) when edges (a, b) come to known ones; only the components that these edges touch are worked on."""
    name = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    above = components(between).select(F.col("node").alias("component"), F.col("component").alias("up"))
    new = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return saved(known.select("node", "component").union(new).join(above, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
