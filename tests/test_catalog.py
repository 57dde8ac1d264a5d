"""Registered queries against the oracle engine on the smallest data (ALL_QUERIES=1 runs every one)."""

import os

import pytest

from hearthgrid.catalog import load
from hearthgrid.catalog.base import TABLES
from hearthgrid.catalog.check import canonical

QUERIES, ORACLES = load()
FAST = [
    "b8_allocate_occupants", "b6_impute_floors", "b9_derive_households", "b18_fix_types", "b19_rebalance_ab", "b19_rebalance_mfh",
    "b19_rebalance_th", "h7_annual_heat_demand", "h8_linear_heat_density", "h6_building_rc", "j10_knn_unbounded", "j4_point_in_polygon",
    "n1_connected_components", "n5_property_children", "s9_upsert", "s17_extract_links", "w2_rank_in_cell", "r10_build_nodes",
]
NAMES = sorted(QUERIES) if os.environ.get("ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150
    prefixes = {n.split("_")[0] for n in QUERIES}
    wanted = [f"g{i}" for i in range(1, 27)] + [f"b{i}" for i in range(1, 21)] + [f"h{i}" for i in range(1, 9)] + [
        f"r{i}" for i in range(1, 12)] + [f"n{i}" for i in range(1, 10)] + [f"j{i}" for i in range(1, 25)] + [
        f"a{i}" for i in range(1, 20)] + [f"w{i}" for i in range(1, 8)] + [f"f{i}" for i in range(1, 17)] + ["x1", "x2", "x3"]
    assert not set(wanted) - prefixes


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
