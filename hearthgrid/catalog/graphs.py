"""Graph operators and feature store jobs (section N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, spatial
from ..plans import features as FE
from .base import MEMBERS, frame, members, query, table

_EPS = 40
_NEAR = f"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_EPS * _EPS} AND a.x BETWEEN b.x - {_EPS} AND b.x + {_EPS}"
_REACH = f"""WITH RECURSIVE e AS (SELECT a.{{k}} AS s, b.{{k}} AS t FROM ({MEMBERS}) a JOIN ({MEMBERS}) b ON a.id <> b.id AND {_NEAR}),
r AS (SELECT DISTINCT s AS node, s AS other FROM e UNION SELECT r.node, e.t FROM r JOIN e ON r.other = e.s)"""


def _pairs(spark, sf):
    return spatial.within_distance_points(members(spark, sf).select("id", "x", "y", "objectid"), "id", float(_EPS), ["objectid"])


@query("n1_connected_components", _REACH.format(k="id") + " SELECT node, min(other) AS component FROM r GROUP BY node")
def _(spark, sf):
    return graph.connected_components(_pairs(spark, sf), "a_id", "b_id")


@query("n2_smallest_text_root", _REACH.format(k="objectid") + " SELECT node, min(other) AS component FROM r GROUP BY node")
def _(spark, sf):
    return graph.connected_components(_pairs(spark, sf), "a_objectid", "b_objectid")


@query("n3_propagate_seed", _REACH.format(k="id") + " SELECT DISTINCT node FROM r WHERE other % 10 = 0")
def _(spark, sf):
    comp = graph.connected_components(_pairs(spark, sf), "a_id", "b_id")
    return graph.propagate_seed(comp, members(spark, sf).filter("id % 10 = 0").select("id"))


# Class tree: parts form a binary tree, odd sizes are abstract.
_TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor((p_partkey - 1) / 2e0) AS BIGINT) END AS superclass_id, p_size % 2 AS is_abstract FROM part"


@query("n4_class_descendants", f"""
WITH RECURSIVE t AS ({_TREE}), r AS (SELECT id FROM t WHERE id = 5 UNION ALL SELECT t.id FROM t JOIN r ON t.superclass_id = r.id) SELECT r.id FROM r JOIN t ON t.id = r.id WHERE is_abstract = 0""")
def _(spark, sf):
    return graph.class_descendants(frame(spark, sf, _TREE), 5, only_concrete=True).select("id")


@query("n5_property_children", f"""
WITH RECURSIVE t AS ({_TREE}), r AS (SELECT id AS root, id, 0 AS depth FROM t WHERE id % 97 = 3 UNION ALL SELECT r.root, t.id, r.depth + 1 FROM t JOIN r ON t.superclass_id = r.id) SELECT root, id AS node, depth FROM r""")
def _(spark, sf):
    t = frame(spark, sf, _TREE)
    return graph.descendants(t.filter("id % 97 = 3").select("id"), t, "superclass_id", "id").select("root", "node", "depth")


# Feature store: orders own their customers' next order; each order is a feature, lines are properties.
_FEATURE = """SELECT o_orderkey AS id, 901 AS objectclass_id, CAST(o_orderkey AS STRING) AS objectid, CAST(NULL AS TIMESTAMP) AS termination_date, o_orderdate AS last_modification_date,
 CAST(NULL AS STRING) AS reason_for_update, CAST(NULL AS STRING) AS updating_person, CAST(NULL AS STRING) AS lineage FROM orders"""
_CONTAINS = """SELECT 2 * o_orderkey AS id, o_orderkey AS feature_id, CAST(NULL AS BIGINT) AS parent_id, 'boundary' AS name, 1 AS namespace_id, o_orderkey * 3 + 1 AS val_feature_id, 1 AS val_relation_type, o_orderkey AS val_geometry_id, o_custkey AS val_address_id FROM orders WHERE o_orderkey * 3 + 1 < (SELECT max(o_orderkey) FROM orders)
UNION ALL SELECT 2 * o_orderkey + 1, o_orderkey, CAST(NULL AS BIGINT), 'boundary', 1, o_orderkey * 3 + 1, 1, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM orders WHERE o_orderkey % 7 = 6 AND o_orderkey * 3 + 1 < (SELECT max(o_orderkey) FROM orders)
UNION ALL SELECT 100000000000 + o_orderkey, o_orderkey + 1, CAST(NULL AS BIGINT), 'boundary', 1, o_orderkey * 3 + 1, 1, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey * 3 + 1 < (SELECT max(o_orderkey) FROM orders)"""
_ROOTS = "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 40 = 7"

@query("n6_cascade_delete")
def _(spark, sf):
    store = {"feature": frame(spark, sf, _FEATURE), "property": frame(spark, sf, _CONTAINS),
             "geometry_data": table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")),
             "address": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))}
    out = FE.cascade_delete(store, frame(spark, sf, _ROOTS))
    return out["feature"].select(F.lit("feature").alias("kind"), "id").unionByName(
        out["property"].select(F.lit("property").alias("kind"), "id")).unionByName(
        out["geometry_data"].select(F.lit("geometry").alias("kind"), "id")).unionByName(
        out["address"].select(F.lit("address").alias("kind"), "id"))


# A store whose features have one containing feature each: plain recursion is exact.
_SINGLE = """SELECT o_orderkey AS id, o_orderkey AS feature_id, CAST(NULL AS BIGINT) AS parent_id, 'boundary' AS name, 1 AS namespace_id, o_orderkey * 3 + 1 AS val_feature_id, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS val_relation_type, o_custkey AS val_address_id FROM orders"""
_SINGLE_GONE = f"""WITH RECURSIVE gone AS (SELECT id FROM ({_ROOTS}) z UNION SELECT val_feature_id FROM ({_SINGLE}) s JOIN gone ON s.feature_id = gone.id AND val_relation_type = 1)"""


@query("n6_cascade_delete_tree", f"""
{_SINGLE_GONE}, dead AS (SELECT s.id, val_relation_type, val_address_id FROM ({_SINGLE}) s WHERE feature_id IN (SELECT id FROM gone) OR val_feature_id IN (SELECT id FROM gone))
SELECT 'feature' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'property', id FROM ({_SINGLE}) s WHERE id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'address', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT val_address_id FROM dead WHERE val_relation_type = 1)""")
def _(spark, sf):
    store = {"feature": frame(spark, sf, _FEATURE), "property": frame(spark, sf, _SINGLE),
             "address": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))}
    out = FE.cascade_delete(store, frame(spark, sf, _ROOTS))
    return out["feature"].select(F.lit("feature").alias("kind"), "id").unionByName(
        out["property"].select(F.lit("property").alias("kind"), "id")).unionByName(out["address"].select(F.lit("address").alias("kind"), "id"))


@query("n7_terminate", f"""
{_SINGLE_GONE} SELECT o_orderkey AS id, CASE WHEN g.id IS NOT NULL THEN TIMESTAMP '2024-05-01' END AS termination_date, CASE WHEN g.id IS NOT NULL THEN 'replaced' END AS reason_for_update, CASE WHEN g.id IS NOT NULL THEN 'job' END AS updating_person
FROM orders LEFT JOIN gone g ON g.id = o_orderkey""")
def _(spark, sf):
    out = FE.terminate(frame(spark, sf, _FEATURE), frame(spark, sf, _SINGLE), frame(spark, sf, _ROOTS), {
        "termination_date": "2024-05-01", "last_modification_date": "2024-05-01", "reason_for_update": "replaced", "updating_person": "job"})
    return out.select("id", F.col("termination_date").cast("timestamp_ntz").alias("termination_date"), "reason_for_update", "updating_person")


@query("n8_feature_envelope", f"""
WITH RECURSIVE c AS (SELECT id AS root, id AS node FROM ({_ROOTS}) z UNION SELECT c.root, val_feature_id FROM c JOIN ({_SINGLE}) s ON s.feature_id = c.node AND val_relation_type = 1)
SELECT root AS id, min(CAST(o_custkey % 1000 AS DOUBLE)) AS xmin, max(CAST(o_custkey % 1000 + 2 AS DOUBLE)) AS xmax, min(CAST(o_orderkey % 500 AS DOUBLE)) AS ymin, max(CAST(o_orderkey % 500 + 1 AS DOUBLE)) AS ymax,
 min(CAST(o_orderkey % 9 AS DOUBLE)) AS zmin, max(CAST(o_orderkey % 9 + 3 AS DOUBLE)) AS zmax FROM c JOIN orders ON o_orderkey = node GROUP BY root""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    x, y, z = F.col("o_custkey") % 1000, F.col("o_orderkey") % 500, F.col("o_orderkey") % 9
    g = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("feature_id"),
                 F.array(G.make_point(x, y, z), G.make_point(x + 2, y + 1, z + 3)).alias("points"))
    return FE.feature_envelope(frame(spark, sf, _FEATURE), frame(spark, sf, _SINGLE), g, frame(spark, sf, _ROOTS)).drop("envelope")


@query("n9_feature_change_log", """
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 1), n AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 2)
SELECT CASE WHEN n.o_orderkey IS NULL THEN NULL ELSE n.o_orderkey END AS id, CAST(coalesce(n.o_orderkey, o.o_orderkey) AS VARCHAR) AS objectid,
 CASE WHEN n.o_orderkey IS NULL THEN 'DELETE' WHEN n.o_orderkey % 10 = 3 THEN 'TERMINATE' WHEN o.o_orderkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS transaction_type
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey
WHERE coalesce(n.o_orderkey, o.o_orderkey) % 2 = 1 AND (n.o_orderkey IS NULL OR o.o_orderkey IS NULL OR n.o_orderkey % 10 IN (3, 5))
UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR), 'DELETE' FROM orders WHERE false
UNION ALL SELECT CASE WHEN false THEN 1 ELSE NULL END, CAST(o_orderkey AS VARCHAR), 'DELETE' FROM orders WHERE false""")
def _(spark, sf):
    base = frame(spark, sf, _FEATURE).withColumn("objectclass_id", F.when(F.col("id") % 2 == 1, 901).otherwise(709))
    old = base.filter("id % 10 <> 1")
    moved = F.col("id") % 10 == 5
    new = base.filter("id % 10 <> 2").withColumns({
        "last_modification_date": F.when(moved, F.col("last_modification_date") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("last_modification_date")),
        "termination_date": F.when(F.col("id") % 10 == 3, F.lit("2024-05-01").cast("timestamp"))})
    classes = table(spark, sf, "region").select(
        F.when(F.col("r_regionkey") == 0, 901).otherwise(709).alias("id"), F.when(F.col("r_regionkey") == 0, 1).otherwise(0).alias("is_toplevel")).distinct()
    return FE.feature_change_log(old, new, classes).select("id", "objectid", "transaction_type")
