"""Chains of ways: groups of few parts are ordered in one row, small components leave the rounds, lone places are not paired."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import geometry as G
from hearthgrid.operators import graph, spatial
from hearthgrid.plans import network as R


def groups_df(spark, rows):
    return spark.createDataFrame([(g, [{"x": float(x), "y": float(y)} for x, y in line]) for g, line in rows], f"g string, geom {G.LINE}").repartition(3)


def test_parts_in_a_row_as_by_joins(spark, monkeypatch):
    """Random groups with branches, rings, gaps, parts that close or repeat, in both ways of ordering."""
    rng = np.random.default_rng(7)
    rows = []
    for g in range(300):
        for _ in range(int(rng.integers(1, 13))):
            (a, b), (c, d) = rng.integers(0, 3, (2, 2)) + rng.choice([0, 0, 0, 0.004, 0.008], (2, 2))
            middle = [(a + 0.3, d - 0.2)] if rng.random() < 0.4 else []
            rows.append((f"g{g}", [(a, b), *middle, (c, d)]))
    df = groups_df(spark, rows)

    def merged():
        return {r.g: [(p.x, p.y) for p in r.geom] for r in R.line_merge(df, "g", tol=0.01).collect()}
    by_joins, joined = [], R._merged_by_joins
    monkeypatch.setattr(R, "_merged_by_joins", lambda *a: by_joins.append(1) or joined(*a))
    at_once = merged()
    assert not by_joins and len(at_once) == 300
    monkeypatch.setattr(R, "PARTS_IN_ROW", 0)
    want = merged()
    assert by_joins and at_once == want
    # both in one run
    monkeypatch.setattr(R, "PARTS_IN_ROW", 6)
    assert merged() == want


def test_odd_lengths_go_by_joins(spark):
    nan = float("nan")
    rows = [("nan", [(0, 0), (nan, 1), (1, 0)]), ("nan", [(1, 0), (2, 0)]), ("fine", [(0, 0), (1, 0)]), ("fine", [(2, 0), (1, 0)])]
    got = {r.g: len(r.geom) for r in R.line_merge(groups_df(spark, rows), "g", tol=0.01).collect()}
    assert got["fine"] == 3 and set(got) == {"nan", "fine"}


@pytest.mark.parametrize("small", [False, True])
def test_components_of_chains(spark, small):
    rng = np.random.default_rng(5)
    edges, start = [(-1, -1), (7, 7)], 0
    for n in rng.geometric(0.3, 200).tolist() + [150]:
        names = rng.permutation(np.arange(start, start + n + 1)).tolist()
        edges += list(zip(names, names[1:]))
        start += n + 1
    edges += [(-10, -11), (-10, -12), (-10, -13), (-12, -13)]
    want = {}
    for u, v in edges:
        a, b = want.get(u, {u}), want.get(v, {v})
        for k in a | b:
            want[k] = a | b
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "source long, target long").repartition(3), small=small).collect()}
    assert got == {k: min(v) for k, v in want.items()}
    if small:
        assert graph.connected_components(spark.createDataFrame([], "source long, target long"), small=True).count() == 0


def test_pairs_need_no_round(spark, monkeypatch):
    """Pairs and stars are done before the first round; the rounds get the one chain that is left."""
    sizes, once = [], graph._round
    monkeypatch.setattr(graph, "_round", lambda edges, size: sizes.append(size) or once(edges, size))
    pairs = spark.range(500).selectExpr("id * 2 AS source", "id * 2 + 1 AS target")
    chain = spark.range(4).selectExpr("10000 + id AS source", "10001 + id AS target")
    got = graph.connected_components(pairs.union(chain), small=True)
    assert sizes and sizes[0] == 4 and got.select("component").distinct().count() == 501


def test_lone_places_are_not_paired(spark, monkeypatch):
    """Ends further apart than the tolerance: counts of cells tell, no pairs are sought."""
    calls, pairs = [], spatial.half_pairs
    monkeypatch.setattr(spatial, "half_pairs", lambda *a, **k: calls.append(1) or pairs(*a, **k))
    w = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("ags"), G.make_line(
        G.make_point(F.col("id") * 50, F.lit(0)), G.make_point(F.col("id") * 50 + 50, F.lit(0))).alias("geom"))
    assert R.chain_edges(w).count() == 49 and not calls
    shifted = w.withColumn("geom", F.transform("geom", lambda p, i: G.make_point(p["x"] + 0.15 * (1 - i), p["y"])))
    assert R.chain_edges(shifted).count() == 49 and calls
