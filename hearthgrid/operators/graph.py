"""Graph operators: components, label propagation and closures as iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, never_sent


def _settled(edges: DataFrame) -> bool:
    """Whether the edges u -> v are stars: one edge per u, and no v that is itself a u.

    One aggregate by node; only the answer reaches the driver.
    """
    roles = edges.selectExpr("explode(array(struct(u AS n, 1 AS up), struct(v AS n, 0 AS up))) AS r")
    return roles.groupBy("r.n").agg(F.expr("sum(r.up) AS ups"), F.expr("min(r.up) AS low")).filter(
        "ups > 1 or (ups = 1 and low = 0)").isEmpty()


HEAVY_EDGES, HEAVY_SHARE = 100_000, 1000


def _with_minimum(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with the m of their u, from low (u, m, n = edges of u).

    An aggregate on the key of a join cannot be split by adaptive execution, so heavy nodes take
    another way: fewer than ``HEAVY_SHARE`` nodes can hold more than that part of the edges each.
    """
    if total < HEAVY_EDGES:  # no node is heavy
        return edges.join(low.select("u", "m"), "u")
    low = cut_lineage(low)  # read by both ways
    heavy = F.broadcast(low.filter(F.col("n") > total / HEAVY_SHARE).select("u", "m"))
    light = low.filter(F.col("n") <= total / HEAVY_SHARE).select("u", "m")
    return edges.join(heavy.select("u"), "u", "left_anti").join(light, "u").unionByName(edges.join(heavy, "u"))


def _stars(edges: DataFrame) -> DataFrame:
    """The edges u -> v (distinct) with done: their component is a star, every other node of it has the one edge to v."""
    roles = edges.selectExpr("explode(array(struct(u AS n, v AS up, 0 AS down), struct(v AS n, NULL AS up, 1 AS down))) AS r")
    nodes = roles.groupBy("r.n").agg(F.expr("count(r.up) AS ups"), F.expr("min(r.up) AS up"), F.expr("sum(r.down) AS downs"))
    # a middle is done when all that point to it are ends
    middle = nodes.filter("ups = 0 OR (ups = 1 AND downs = 0)").selectExpr("if(ups = 0, n, up) AS v", "if(ups = 0, 0L, 1L) AS e", "if(ups = 0, downs, 0L) AS d").groupBy(
        "v").agg(F.sum("e").alias("e"), F.sum("d").alias("d")).filter("e = d").select("v")
    return edges.join(never_sent(middle.withColumn("hit", F.lit(True))), "v", "left").select("u", "v", F.coalesce("hit", F.lit(False)).alias("done"))


def _small_components(base: DataFrame, max_rounds: int) -> DataFrame:
    """node, component of the edges u >= v; components that have become stars leave the rounds."""
    labels = base.filter("u = v").selectExpr("u AS node", "v AS component")
    current = base.filter("u <> v")
    for _ in range(max_rounds):
        parted = cut_lineage(_stars(current))
        labels = labels.unionByName(parted.filter("done").selectExpr("explode(array(struct(u AS node, v AS component), struct(v AS node, v AS component))) AS l").select("l.*"))
        current = parted.filter("NOT done").select("u", "v")
        size = current.count()
        if not size:
            return labels.groupBy("node").agg(F.min("component").alias("component"))
        current = cut_lineage(_round(current, size))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _round(current: DataFrame, size: int) -> DataFrame:
    """One large star and one small star of ``size`` edges."""
    # large star: every larger neighbour of u points to the smallest neighbour of u
    both = current.selectExpr("explode(array(struct(u, v), struct(v AS u, u AS v))) AS e").select("e.u", "e.v")
    low = both.groupBy("u").agg(F.expr("least(u, min(v)) AS m"), F.expr("count(*) AS n"))
    star = _with_minimum(both.filter("v > u"), low, 2 * size).selectExpr("v AS u", "m AS v").distinct()
    # small star: smaller neighbours of u, and u itself, point to the smallest of them
    low = star.groupBy("u").agg(F.expr("min(v) AS m"), F.expr("count(*) AS n"))
    return _with_minimum(star, low, size).selectExpr(
        "explode(array(struct(v AS u, m AS v), struct(u, m AS v))) AS e").select("e.u", "e.v").filter("u <> v").distinct()


def connected_components(edges: DataFrame, source: str = "source", target: str = "target",
                         max_rounds: int = 100, small: bool = False) -> DataFrame:
    """Columns node, component; the label is the smallest node of the component.

    Alternating large-star / small-star rounds: O(log n) rounds even on long chains. Minima are
    partial aggregates. Nodes with more than a thousandth of all edges are at most a few thousand; their
    minima are broadcast, and only the edges of other nodes are shuffled to meet theirs. ``small``: most
    components have few nodes, so that it pays to part those that are done from the others in every round.
    """
    # computed once: the rounds and the final node list both start from here
    base = cut_lineage(edges.select(F.col(source).alias("u"), F.col(target).alias("v")).filter(
        F.col("u").isNotNull() & F.col("v").isNotNull()).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if small:
        return _small_components(base, max_rounds)
    nodes = base.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    current = base.filter("u <> v")
    for _ in range(max_rounds):
        if _settled(current):
            break
        current = cut_lineage(_round(current, current.count()))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def propagate_seed(components: DataFrame, seeds: DataFrame, seed_key: str = "id") -> DataFrame:
    """Nodes of every component that holds at least one seed."""
    marked = components.join(
        seeds.select(F.col(seed_key).alias("node")), "node", "left_semi").select("component").distinct()
    return components.join(marked, "component", "left_semi").select("node")


_LEVELS_PER_ROUND = 4


def descendants(roots: DataFrame, edges: DataFrame, parent: str = "parent", child: str = "child",
                max_rounds: int = 1000) -> DataFrame:
    """Closure (root, node, depth) under parent -> child, each root included at depth 0.

    A round expands several levels in one plan and then keeps only pairs not seen before, so cycles
    end and the number of jobs stays small.
    """
    e = edges.select(F.col(parent).alias("__p"), F.col(child).alias("__c")).filter(
        "__p is not null and __c is not null").distinct()
    first = roots.columns[0]
    seen = cut_lineage(roots.select(F.col(first).alias("root"), F.col(first).alias("node")).distinct().withColumn(
        "depth", F.lit(0)))
    front, low = seen, 0
    for _ in range(max_rounds):
        cur = front
        for level in range(low, low + _LEVELS_PER_ROUND):
            here = F.struct("node", "depth")
            below = F.when(F.col("__c").isNotNull() & (F.col("depth") == level), F.struct(
                F.col("__c").alias("node"), (F.col("depth") + 1).alias("depth")))
            cur = cur.join(e, F.col("node") == F.col("__p"), "left").select(
                "root", F.explode(F.array_compact(F.array(here, below))).alias("n")).groupBy(
                "root", F.col("n.node").alias("node")).agg(F.min("n.depth").alias("depth"))
        low += _LEVELS_PER_ROUND
        new = cut_lineage(cur.join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen = seen.unionByName(new)
        front = new.filter(F.col("depth") == low)
        if front.isEmpty():
            return seen
        seen = cut_lineage(seen)
    raise RuntimeError(f"closure deeper than {max_rounds * _LEVELS_PER_ROUND}")


def class_descendants(classes: DataFrame, root: Column | int, only_concrete: bool = False) -> DataFrame:
    """Subclasses of one class in a class table (id, superclass_id, is_abstract)."""
    start = classes.filter(F.col("id") == root).select("id")
    closed = descendants(start, classes, "superclass_id", "id").select(F.col("node").alias("id"))
    out = classes.join(closed, "id", "left_semi")
    return out.filter("coalesce(is_abstract, 0) = 0") if only_concrete else out
