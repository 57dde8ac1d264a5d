"""Jobs on the feature store: flattening, linked surfaces, cascades, envelopes, change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, scalar as S
from ..operators import graph, tables
from ..session import cut_lineage, never_sent

# Fixed class ids: building, and its wall, ground and roof surfaces.
BUILDING, SURFACES = 901, (709, 710, 712)
CONTAINS = 1
CHILDREN = "struct<children:array<struct<objectId:string>>>"


def flatten_city_buildings(feature: DataFrame, prop: DataFrame, address: DataFrame, ags: list[str] | None = None,
                           object_prefix: str = "") -> DataFrame:
    """Attribute rows of building features to one flat row per building."""
    f = feature.filter((F.col("objectclass_id") == BUILDING) & F.col("objectid").startswith(object_prefix)).select(
        F.col("id").alias("feature_id"), "objectclass_id", "objectid")
    wide = tables.eav_pivot(prop.join(f.select("feature_id"), "feature_id", "left_semi"), ["feature_id"], {
        "building_function_code": ("function", "val_string"), "gemeindeschluessel": ("Gemeindeschluessel", "val_string"),
        "storeysaboveground": ("storeysAboveGround", "val_int"), "address_id": ("address", "val_address_id"),
        "height": ("value", "val_double")})
    code = F.col("building_function_code")
    kept = wide.filter((code >= "31001_") & (code < "31002"))
    if ags is not None:
        kept = kept.filter(F.col("gemeindeschluessel").isin(*ags))
    else:
        kept = kept.filter(F.col("gemeindeschluessel").isNotNull())
    adr = address.select(F.col("id").alias("address_id"), "zip_code", S.street_name("street").alias("street"),
                         S.house_number("street").alias("house_number"), "city", "country", "state")
    return f.join(kept, "feature_id").join(adr, "address_id", "left").withColumn(
        "ags_id", F.substring("gemeindeschluessel", 1, 2)).drop("address_id")


def child_objects(geometry: DataFrame) -> DataFrame:
    """One row per child object id named in the properties of a geometry."""
    return geometry.select(
        F.col("id").alias("geometry_id"), "feature_id",
        F.explode(F.from_json("geometry_properties", CHILDREN)["children"]).alias("c")).select(
        "geometry_id", "feature_id", F.col("c.objectId").alias("child_id")).filter("child_id is not null")


def link_surfaces(feature: DataFrame, geometry: DataFrame, prop: DataFrame, objectclass: DataFrame) -> DataFrame:
    """Surfaces with the building whose solid names the same child object.

    All but ``objectclass`` grow with the buildings; only the names of the surface classes are broadcast.
    """
    kids = child_objects(geometry).join(
        never_sent(feature.filter(F.col("objectclass_id").isin(BUILDING, *SURFACES)).select(
            F.col("id").alias("feature_id"), "objectid", "objectclass_id")), "feature_id")
    solids = kids.filter(F.col("objectclass_id") == BUILDING).select(
        "child_id", F.col("objectid").alias("building_objectid"), F.col("feature_id").alias("building_id"))
    links = kids.filter(F.col("objectclass_id").isin(*SURFACES)).select(
        "child_id", "geometry_id", "feature_id", "objectclass_id").join(never_sent(solids), "child_id").drop("child_id").distinct()
    areas = prop.groupBy("feature_id").agg(
        F.max(F.when(F.col("name") == "Flaeche", F.col("val_string"))).alias("area"))
    keys = prop.filter(F.col("name") == "Gemeindeschluessel").groupBy(F.col("feature_id").alias("building_id")).agg(
        F.max("val_string").alias("gemeindeschluessel"))
    out = links.join(never_sent(areas), "feature_id").join(never_sent(keys), "building_id").join(
        F.broadcast(objectclass.filter(F.col("id").isin(*SURFACES)).select(F.col("id").alias("objectclass_id"), "classname")), "objectclass_id")
    grouped = out.groupBy("building_objectid", "objectclass_id", "classname", "geometry_id").agg(
        F.max("area").cast("double").alias("area"), F.max("gemeindeschluessel").alias("gemeindeschluessel"))
    return grouped.join(never_sent(geometry.select(F.col("id").alias("geometry_id"), F.col("geometry").alias("geom"))), "geometry_id")


def building_view(b: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Buildings with their ground surface (polygon), its area and a point inside."""
    ground = surfaces.filter(F.col("objectclass_id") == 710).select(
        F.col("building_objectid").alias("objectid"), F.col("area").alias("groundsurface_flaeche"),
        F.col("geom").alias("__g"))
    return b.join(never_sent(ground), "objectid").withColumns(
        {"geom": G.to_multi("__g"), "centroid": G.point_on_surface("__g")}).drop("__g")


# ---------------------------------------------------------------- cascades


def _children_closed(seed: DataFrame, prop: DataFrame) -> DataFrame:
    """Property ids plus everything below them in the property tree."""
    return graph.descendants(seed.select("id"), prop, "parent_id", "id").select(F.col("node").alias("id")).distinct()


def _same_named_ancestors(seed: DataFrame, prop: DataFrame) -> DataFrame:
    """Climb to the parent while it carries the same name and namespace."""
    up = prop.alias("c").join(prop.alias("p"), F.col("p.id") == F.col("c.parent_id")).filter(
        (F.col("p.name") == F.col("c.name")) & (F.col("p.namespace_id") == F.col("c.namespace_id"))).select(
        F.col("c.id").alias("below"), F.col("p.id").alias("above"))
    return graph.descendants(seed.select("id"), up, "below", "above").select(F.col("node").alias("id")).distinct()


def cascade_delete(store: dict[str, DataFrame], ids: DataFrame, max_rounds: int = 1000) -> dict[str, DataFrame]:
    """New tables after deleting features and everything only they own.

    ``store`` holds feature, property, geometry_data, implicit_geometry, appearance,
    appear_to_surface_data, surface_data, tex_image, address (the last seven may be missing);
    ``ids`` has a column id. A contained feature goes with its parent unless another remaining
    reference contains it.
    """
    feature, prop = store["feature"], store["property"]
    new = cut_lineage(ids.select("id").distinct().join(feature.select("id"), "id", "left_semi"))
    gone_f = new
    gone_p = None
    flat = "parent_id" not in prop.columns or prop.filter("parent_id is not null").isEmpty()
    for _ in range(max_rounds):
        own = prop.join(new.withColumnRenamed("id", "feature_id"), "feature_id", "left_semi").select("id")
        refs = prop.join(new.withColumnRenamed("id", "val_feature_id"), "val_feature_id", "left_semi").select("id")
        tree = refs if flat else _children_closed(_same_named_ancestors(refs, prop), prop)
        step = own.unionByName(tree)
        gone_p = cut_lineage((step if gone_p is None else gone_p.unionByName(step)).distinct())
        dropped = prop.join(gone_p, "id", "left_semi")
        left = prop.join(gone_p, "id", "left_anti")
        owned = dropped.filter(F.col("val_feature_id").isNotNull() & (F.col("val_relation_type") == CONTAINS)).select(
            F.col("val_feature_id").alias("id")).distinct().join(gone_f, "id", "left_anti")
        holders = left.filter(F.col("val_feature_id").isNotNull()).groupBy(F.col("val_feature_id").alias("id")).agg(
            F.bool_or(F.coalesce(F.col("val_relation_type"), F.lit(0)) == 0).alias("loose"))
        new = cut_lineage(owned.join(holders, "id", "left").filter("loose is null or loose").select("id").join(
            feature.select("id"), "id", "left_semi"))
        if new.isEmpty():
            break
        gone_f = cut_lineage(gone_f.unionByName(new).distinct())
    else:
        raise RuntimeError("cascade did not settle")

    out = dict(store)
    out["feature"] = feature.join(gone_f, "id", "left_anti")
    out["property"] = prop.join(gone_p, "id", "left_anti")
    # only rows that hold no feature reference, or contain it, release what they point to
    releasing = prop.join(gone_p, "id", "left_semi").filter(
        F.col("val_feature_id").isNull() | (F.col("val_relation_type") == CONTAINS))

    def released(column: str) -> DataFrame:
        return releasing.select(F.col(column).alias("id")).filter("id is not null").distinct()

    def without(table: str, dead: DataFrame, key: str = "id") -> None:
        if table in out:
            out[table] = out[table].join(dead.select(F.col("id").alias(key)).distinct(), key, "left_anti")

    dead_geometry = released("val_geometry_id") if "val_geometry_id" in prop.columns else None
    dead_looks = released("val_appearance_id") if "val_appearance_id" in prop.columns else None
    if "val_implicitgeom_id" in prop.columns and "implicit_geometry" in out:
        dead = released("val_implicitgeom_id").join(
            out["property"].select(F.col("val_implicitgeom_id").alias("id")), "id", "left_anti")
        inner = store["implicit_geometry"].join(dead, "id", "left_semi").select(
            F.col("relative_geometry_id").alias("id")).filter("id is not null")
        dead_geometry = inner if dead_geometry is None else dead_geometry.unionByName(inner)
        if "appearance" in out and "implicit_geometry_id" in store["appearance"].columns:
            more = store["appearance"].join(
                dead.withColumnRenamed("id", "implicit_geometry_id"), "implicit_geometry_id", "left_semi").select("id")
            dead_looks = more if dead_looks is None else dead_looks.unionByName(more)
        without("implicit_geometry", dead)
    if dead_geometry is not None:
        without("geometry_data", dead_geometry)
    if dead_looks is not None:
        without("appearance", dead_looks)
        if "appear_to_surface_data" in out:
            link = store["appear_to_surface_data"]
            cut = link.join(dead_looks.select(F.col("id").alias("appearance_id")).distinct(), "appearance_id", "left_semi")
            without("appear_to_surface_data", dead_looks, "appearance_id")
            lone = cut.select(F.col("surface_data_id").alias("id")).distinct().join(
                out["appear_to_surface_data"].select(F.col("surface_data_id").alias("id")), "id", "left_anti")
            if "surface_data" in out:
                images = store["surface_data"].join(lone, "id", "left_semi").select(
                    F.col("tex_image_id").alias("id")).filter("id is not null").distinct()
                without("surface_data", lone)
                images = images.join(out["surface_data"].select(F.col("tex_image_id").alias("id")), "id", "left_anti")
                without("tex_image", images)
    if "val_address_id" in prop.columns:
        without("address", released("val_address_id"))
    return out


def terminate(feature: DataFrame, prop: DataFrame, ids: DataFrame, metadata: dict[str, str] | None = None,
              cascade: bool = True, max_rounds: int = 1000) -> DataFrame:
    """Set termination fields; a child follows once every feature that contains it is terminated."""
    meta = metadata or {}
    new = cut_lineage(ids.select("id").distinct().join(feature.select("id"), "id", "left_semi"))
    done = new
    holds = prop.filter((F.col("val_relation_type") == CONTAINS) & F.col("val_feature_id").isNotNull()).select(
        F.col("feature_id").alias("parent"), F.col("val_feature_id").alias("child")).distinct()
    for _ in range(max_rounds if cascade else 0):
        kids = holds.join(new.withColumnRenamed("id", "parent"), "parent", "left_semi").select(
            F.col("child").alias("id")).distinct().join(done, "id", "left_anti")
        alive = feature.filter("termination_date is null").select("id").join(done, "id", "left_anti")
        held = holds.join(alive.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id"))
        new = cut_lineage(kids.join(held, "id", "left_anti").join(feature.select("id"), "id", "left_semi"))
        if new.isEmpty():
            break
        done = cut_lineage(done.unionByName(new))
    hit = F.col("__hit")
    out = feature.join(done.withColumn("__hit", F.lit(True)), "id", "left")

    def when_given(name: str, default: Column) -> Column:
        value = F.lit(meta[name]).cast(feature.schema[name].dataType) if name in meta else default
        return F.when(hit, value).otherwise(F.col(name))

    defaults = {
        "termination_date": F.current_timestamp(), "last_modification_date": F.current_timestamp(),
        "reason_for_update": F.col("reason_for_update") if "reason_for_update" in feature.columns else None,
        "updating_person": F.current_user(), "lineage": F.col("lineage") if "lineage" in feature.columns else None}
    return out.withColumns({
        n: when_given(n, d) for n, d in defaults.items() if n in feature.columns and d is not None}).drop("__hit")


# ---------------------------------------------------------------- envelopes and change log

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def placed_matrix(matrix_json, ref_point) -> Column:
    """Row-major matrix as array<double> with the reference point added to the shift."""
    m = F.coalesce(F.from_json(G.col(matrix_json), "array<double>"), F.array(*[F.lit(v) for v in IDENTITY]))
    p = G.col(ref_point)
    checked = F.when(F.size(m) >= 12, m).otherwise(
        F.raise_error(F.lit("a transformation matrix needs 12 elements")).cast("array<double>"))
    return F.transform(checked, lambda v, i: v + F.coalesce(
        F.when(i == 3, p["x"]).when(i == 7, p["y"]).when(i == 11, p["z"]), F.lit(0.0)))


def _corners(points) -> Column:
    """Extent of 3D points as struct<xmin, xmax, ymin, ymax, zmin, zmax>."""
    def values(axis: str) -> Column:
        return F.transform(points, lambda p: p[axis])

    return F.struct(*[
        f(values(a)).alias(f"{a}{n}") for a in "xyz" for f, n in ((F.array_min, "min"), (F.array_max, "max"))])


def box_ring(b) -> Column:
    """The ring that stands for an envelope: lower corners below, upper corners above."""
    b = G.col(b)
    lo, hi = b["zmin"], b["zmax"]
    return F.array(
        G.make_point(b["xmin"], b["ymin"], lo), G.make_point(b["xmax"], b["ymin"], lo),
        G.make_point(b["xmax"], b["ymax"], hi), G.make_point(b["xmin"], b["ymax"], hi),
        G.make_point(b["xmin"], b["ymin"], lo))


def feature_envelope(feature: DataFrame, prop: DataFrame, geometry: DataFrame, roots: DataFrame,
                     implicit: DataFrame | None = None, use_stored: bool = False) -> DataFrame:
    """Box (columns xmin .. zmax and ``envelope``) of each root with all it contains.

    ``geometry``: id, feature_id, points (array of x, y, z); implicit geometries are placed by
    val_array and val_implicitgeom_refpoint of the property. With ``use_stored`` a feature that has
    an envelope (array of points) contributes it and is not searched further.
    """
    holds = prop.filter((F.col("val_relation_type") == CONTAINS) & F.col("val_feature_id").isNotNull()).select(
        F.col("feature_id").alias("parent"), F.col("val_feature_id").alias("child"))
    stored = None
    if use_stored:
        stored = feature.filter("envelope is not null").select(F.col("id").alias("feature_id"), F.col("envelope").alias("points"))
        holds = holds.join(stored.select(F.col("feature_id").alias("parent")), "parent", "left_anti")
    closure = graph.descendants(roots.select("id"), holds).select("root", F.col("node").alias("feature_id"))
    shapes = geometry.filter("feature_id is not null and points is not null").select("feature_id", "points")
    if implicit is not None:
        use = prop.filter("val_implicitgeom_id is not null").select(
            "feature_id", F.col("val_implicitgeom_id").alias("ig"), "val_array", "val_implicitgeom_refpoint")
        base = implicit.select(F.col("id").alias("ig"), "relative_geometry_id").join(
            geometry.select(F.col("id").alias("relative_geometry_id"), F.col("implicit_points").alias("ip")), "relative_geometry_id", "left")
        moved = use.join(base, "ig", "left").withColumn("m", placed_matrix("val_array", "val_implicitgeom_refpoint"))
        box = F.when(F.col("ip").isNotNull(), G.affine_line(box_ring(_corners(F.col("ip"))), "m")).when(
            F.col("val_implicitgeom_refpoint").isNotNull(),
            F.array(G.make_point(F.get("m", 3), F.get("m", 7), F.get("m", 11))))
        shapes = shapes.unionByName(moved.select("feature_id", box.alias("points")).filter("points is not null"))
    if stored is not None:
        shapes = shapes.join(stored.select("feature_id"), "feature_id", "left_anti").unionByName(stored)
    # one small box per feature before the closure multiplies rows
    boxes = shapes.select("feature_id", _corners(F.col("points")).alias("b")).groupBy("feature_id").agg(*[
        (F.min if n == "min" else F.max)(f"b.{a}{n}").alias(f"{a}{n}") for a in "xyz" for n in ("min", "max")])
    merged = closure.join(boxes, "feature_id").groupBy("root").agg(*[
        (F.min if n == "min" else F.max)(f"{a}{n}").alias(f"{a}{n}") for a in "xyz" for n in ("min", "max")])
    return merged.withColumn("envelope", box_ring(F.struct("xmin", "xmax", "ymin", "ymax", "zmin", "zmax"))).withColumnRenamed("root", "id")


def feature_change_log(old: DataFrame, new: DataFrame, objectclass: DataFrame, prop: DataFrame | None = None) -> DataFrame:
    """One row per change of a top-level feature between two snapshots.

    Kinds: INSERT, DELETE, TERMINATE (termination date set), UPDATE (only when the modification
    date differs). With ``prop`` a changed child counts as an update of the features containing it.
    """
    cols = ["objectclass_id", "objectid", "last_modification_date", "termination_date", "reason_for_update"]
    o = old.select("id", F.struct(*cols).alias("o"))
    n = new.select("id", F.struct(*cols).alias("n"))
    both = o.join(n, "id", "full")
    top = objectclass.filter("is_toplevel = 1").select(F.col("id").alias("objectclass_id"))
    moved = F.col("o").isNotNull() & F.col("n").isNotNull() & (
        F.col("o.last_modification_date") != F.col("n.last_modification_date"))
    touched_rows = F.col("o").isNull() | F.col("n").isNull() | ~F.col("o").eqNullSafe(F.col("n"))
    kind = F.when(F.col("n").isNull(), "DELETE").when(F.col("n.termination_date").isNotNull(), "TERMINATE").when(
        F.col("o").isNull(), "INSERT").when(moved, "UPDATE")
    own = both.filter(touched_rows).withColumn("transaction_type", kind).filter("transaction_type is not null").select(
        "id", F.coalesce("n.objectclass_id", "o.objectclass_id").alias("objectclass_id"),
        F.coalesce("n.objectid", "o.objectid").alias("objectid"), "transaction_type",
        F.when(F.col("n").isNotNull(), F.col("n.reason_for_update")).alias("reason_for_update"))
    log = own.join(top, "objectclass_id", "left_semi")
    if prop is not None:
        changed_kids = both.filter(moved & F.col("n.termination_date").isNull()).select(
            F.col("id").alias("val_feature_id"), F.col("n.objectclass_id").alias("objectclass_id")).join(
            top, "objectclass_id", "left_anti")
        up = prop.filter(F.col("val_relation_type") == CONTAINS).select("feature_id", "val_feature_id")
        closure = graph.descendants(changed_kids.select("val_feature_id"), up, "val_feature_id", "feature_id")
        parents = closure.filter("depth > 0").select(F.col("node").alias("id")).distinct().join(
            log.select("id"), "id", "left_anti")
        more = new.join(parents, "id", "left_semi").join(top, "objectclass_id", "left_semi").select(
            "id", "objectclass_id", "objectid", F.lit("UPDATE").alias("transaction_type"), "reason_for_update")
        log = log.unionByName(more.select(*log.columns))
    return log.withColumn("id", F.when(F.col("transaction_type") != "DELETE", F.col("id")))
