import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import scalar as S


def first(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_casts(spark):
    r = first(spark, a=S.cast_int_lenient(F.lit("1.234 m")), b=S.cast_int_lenient(F.lit("–")), c=S.cast_int_lenient(F.lit("x")),
              d=S.cast_decimal_comma(F.lit("3,5")), e=S.cast_decimal_comma(F.lit("—")))
    assert (r.a, r.b, r.c, r.d, r.e) == (1234, None, None, 3.5, None)


def test_street_with_umlaut(spark):
    r = first(spark, s=S.street_name(F.lit(" Straße 12ä ")), n=S.house_number(F.lit("Straße 12ä")), none=S.house_number(F.lit("Am Markt")))
    assert (r.s, r.n, r.none) == ("Straße", "12ä", None)


def test_unknown_use_raises(spark):
    codes = spark.createDataFrame([("31001_2310", "Residential"), ("31001_2310", "Residential"), ("31001_3020", "Public")], "code string, building_use string")

    def use(*listed):
        rows = spark.createDataFrame([(c,) for c in listed], "c string")
        return sorted(str(r.building_use) for r in S.classify_use_by_list(rows, "c", codes).collect())
    assert use("31001_2310", None, "31001_3020") == ["None", "Public", "Residential"]
    with pytest.raises(Exception, match="unknown building function code"):
        use("31001_3001")


def test_weighted_choice(spark):
    w = [F.lit(1.0), F.lit(3.0)]
    r = first(spark, a=S.weighted_choice(w, ["x", "y"], F.lit(0.25)), b=S.weighted_choice(w, ["x", "y"], F.lit(0.26)),
              c=S.weighted_choice([F.lit(0.0), F.lit(0.0)], ["x", "y"], F.lit(0.5)))
    assert (r.a, r.b, r.c) == ("x", "y", None)


def test_scope_patterns():
    assert S.resolve_scope(["09_", "05", " ", "1%"]) == ["09_", "05%", "1%"]
    assert S.resolve_scope(None) == [] and S.resolve_scope("05") == ["05%"]


def test_rounding_of_doubles_is_half_even(spark):
    r = first(spark, a=F.rint(F.lit(2.5)), b=F.rint(F.lit(3.5)))
    assert (r.a, r.b) == (2, 4)


def test_greatest_skips_null(spark):
    assert first(spark, a=F.greatest(F.lit(None).cast("double"), F.lit(1.0))).a == 1


def test_split_url_edge_cases(spark):
    r = first(spark, a=S.split_url(F.lit("https://h/x/.profile"))["extension"], b=S.split_url(F.lit("https://h"))["filename"],
              c=S.split_url(F.lit("https://h/a.b/c"))["extension"], d=S.split_url(F.lit("https://h/a.tar.gz#q"))["stem"])
    assert (r.a, r.b, r.c, r.d) == ("", "", "", "a.tar")


def test_hourly_range_excludes_the_end(spark):
    r = first(spark, t=S.hourly_range(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 03:00:00").cast("timestamp")))
    assert len(r.t) == 3
