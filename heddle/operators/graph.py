"""Dependency depth, chains, reachability and closure over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources.shared import materialize


def depth_of(parents: Column | str) -> Column:
    """Depths of topologically ordered items, given each item's array of 0-based parent positions: roots 1, else one more than the deepest parent."""
    p = parents if isinstance(parents, str) else "parents"
    return F.expr(f"aggregate({p}, cast(array() as array<int>), (acc, x) -> concat(acc, array(1 + coalesce(array_max(transform(x, i -> acc[i])), 0))))")


def reachable(edges: DataFrame, start: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(node, distance) of all nodes reached from `start` (node) along `edges` (src, dst) without entering blocked nodes.

    Frontier by frontier, each written and deduplicated against all seen before: cycles end, and a diamond's node is
    visited once. The number of rounds is the longest shortest path. Edges are written once, and blocked nodes are taken from
    what a round reaches, not from the edges.
    """
    edges = materialize(edges.select("src", "dst"), "reach-edges")
    if blocked is not None:
        blocked = materialize(blocked.select("node").distinct(), "reach-blocked")
        start = start.join(blocked, "node", "left_anti")
    seen = materialize(start.select("node").distinct().withColumn("distance", F.lit(0)), "reach")
    frontier, step = seen, 0
    while not frontier.isEmpty():
        step += 1
        near = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        near = near if blocked is None else near.join(blocked, "node", "left_anti")
        frontier = materialize(near.join(seen, "node", "left_anti").withColumn("distance", F.lit(step)), "reach")
        seen = seen.unionByName(frontier)
    return seen


def chain(df: DataFrame, key: str, parent: str, limit: int) -> DataFrame:
    """(key, hops, ancestor): each row's ancestors up to `limit` hops; a cycle back to the row itself ends its chain.

    Doubles as pointer chase: one self-join a hop, each on the key, with the limit known beforehand. Rows and hops are
    written, so that a task holds one join's rows however many hops there are.
    """
    df = materialize(df.select(key, parent), "chain-links")
    links = df.filter(F.col(parent).isNotNull()).select(F.col(key).alias("_k"), F.col(parent).alias("_p"))
    hop = df.select(key, F.lit(1).alias("hops"), F.col(parent).alias("ancestor")).filter("ancestor is not null")
    out = hop
    for n in range(2, limit + 1):
        hop = hop.join(links, hop["ancestor"] == links["_k"]).select(key, F.lit(n).alias("hops"), F.col("_p").alias("ancestor"))
        hop = materialize(hop.filter(F.col("ancestor").isNotNull() & (F.col("ancestor") != F.col(key))), "chain-hop")
        out = out.unionByName(hop)
    return out


def causal_stage(items: DataFrame, keys: list[str], pos: str, parents: str) -> DataFrame:
    """items with `stage`: an item is unlocked once the last of its parents (array of positions) has arrived."""
    return items.withColumn("stage", F.coalesce(F.array_max(parents) + 1, F.lit(0)))


def divide(rows: DataFrame, key: str, feature: str, wanted: DataFrame) -> DataFrame:
    """Keys that have every wanted feature (relational division)."""
    n = wanted.select(feature).distinct().agg(F.count("*").alias("_all"))
    have = rows.join(wanted.select(feature).distinct(), feature).groupBy(key).agg(F.count_distinct(feature).alias("_n"))
    return have.join(F.broadcast(n)).filter("_n = _all").select(key)


def _until_same(step, start: DataFrame, tag: str) -> DataFrame:
    """Apply `step` to a table until its sum of hashes stays the same; each round is written."""
    table, before = materialize(start, tag), None
    while True:
        now = tuple(table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))).first())
        if now == before:
            return table
        before, table = now, materialize(step(table), tag)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of a directed graph (src, dst): nodes that reach one another have the same component, named by one of them.

    Rounds of three steps on what is left: nodes without an edge in or out are alone; every node takes the greatest node
    that reaches it as its colour; what reaches a colour's own node, within the colour, is a component. Edges between
    colours go, so the rest falls apart quickly. Rows that repeat an edge and loops change nothing.
    """
    edges = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "scc-edges")
    left = materialize(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "scc-nodes")
    done = left.select("node", F.col("node").alias("component")).limit(0)
    while not left.isEmpty():
        ends = [edges.select(F.col(c).alias("node")).distinct() for c in ("src", "dst")]
        core = left.join(ends[0], "node", "left_semi").join(ends[1], "node", "left_semi")
        alone = left.join(core, "node", "left_anti")
        inner = materialize(edges.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi"), "scc-edges")

        def spread(colour: DataFrame, inner: DataFrame = inner) -> DataFrame:
            told = colour.withColumnRenamed("node", "src").join(inner, "src").select(F.col("dst").alias("node"), "colour")
            return colour.unionByName(told).groupBy("node").agg(F.max("colour").alias("colour"))

        colour = _until_same(spread, core.select("node", F.col("node").alias("colour")), "scc-colour")
        same = inner.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst").filter("_a = _b")
        same = materialize(same.select("src", "dst"), "scc-same")

        def back(found: DataFrame, same: DataFrame = same) -> DataFrame:
            return found.unionByName(same.join(found.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component")).distinct()

        strong = _until_same(back, colour.filter("node = colour").select("node", F.col("node").alias("component")), "scc-found")
        found = materialize(strong.unionByName(alone.select("node", F.col("node").alias("component"))), "scc-done")
        done = done.unionByName(found)
        left = materialize(left.join(found, "node", "left_anti"), "scc-nodes")
        edges = materialize(same.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"), "scc-edges")
    return done


def _closure(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(starts, pairs, of): sources (node) with their component, the pairs of components (component, at) that a path of one edge
    or more leads between, from those of the sources, and every node's component.

    Paths are followed between strong components, pair by pair, and only from pairs that the round before found: a cycle
    costs one node, and a source's own component is followed once for all sources in it.
    """
    edges = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "closure-edges")
    of = materialize(strong_components(edges).unionByName(edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))).groupBy("node").agg(F.max("component").alias("component")), "closure-nodes")
    a, b = (of.select(F.col("node").alias(c), F.col("component").alias(k)) for c, k in (("src", "_a"), ("dst", "_b")))
    between = edges.join(a, "src").join(b, "dst").groupBy("_a", "_b").agg(F.count("*").alias("n"))
    steps = materialize(between.filter("_a <> _b").select("_a", "_b"), "closure-steps")
    cyclic = between.filter("_a = _b").select(F.col("_a").alias("_own"))  # these reach themselves
    starts = sources.select("node").distinct().join(of, "node")
    frontier = materialize(starts.select("component").distinct().withColumn("at", F.col("component")), "closure-pairs")
    seen = frontier
    while not frontier.isEmpty():
        reached = frontier.join(steps, F.col("at") == F.col("_a")).select("component", F.col("_b").alias("at")).distinct()
        frontier = materialize(reached.join(seen, ["component", "at"], "left_anti"), "closure-pairs")
        seen = seen.unionByName(frontier)
    itself = seen.filter("component = at")
    return starts, seen.filter("component <> at").unionByName(itself.join(cyclic, F.col("at") == F.col("_own")).select("component", "at")), of


def closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node) for every node that a path of one edge or more leads to from each of `sources` (node): as many rows as there are such pairs.

    Members of components are put back at the end; where only sums over the nodes are asked for, `closure_sums` doesn't."""
    starts, pairs, of = _closure(edges, sources)
    members = of.select(F.col("component").alias("at"), F.col("node").alias("_to"))
    return starts.withColumnRenamed("node", "source").join(pairs, "component").join(members, "at").select("source", F.col("_to").alias("node"))


def closure_sums(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, n, nodes): how many nodes `closure` has for each source that reaches any, and their sum.

    Nodes are summed in their component, components in the source's component, and sources get the sums: no pair of nodes is built."""
    starts, pairs, of = _closure(edges, sources)
    each = of.groupBy(F.col("component").alias("at")).agg(F.count("*").alias("n"), F.sum("node").alias("nodes"))
    sums = pairs.join(each, "at").groupBy("component").agg(F.sum("n").alias("n"), F.sum("nodes").alias("nodes"))
    return starts.join(sums, "component").select(F.col("node").alias("source"), "n", "nodes")
