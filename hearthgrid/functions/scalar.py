"""Scalar rules on text, numbers and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .geometry import col, let

# Dash forms that mean "no value" in census files.
MISSING_MARKS = ("-", "–", "—")


def cast_int_lenient(c) -> Column:
    text = F.when(~F.trim(col(c)).isin(*MISSING_MARKS), col(c))
    return F.nullif(F.regexp_replace(text, "[^0-9-]", ""), F.lit("")).try_cast("bigint")


def cast_decimal_comma(c) -> Column:
    text = F.when(~F.trim(col(c)).isin(*MISSING_MARKS), col(c))
    return F.nullif(F.replace(text, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def cast_by_map(df: DataFrame, types: dict[str, str], xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Cast every column by a lower-cased name -> type map; coordinates are doubles, the rest text."""
    wanted = {k.lower(): v.lower() for k, v in types.items()}

    def one(name: str) -> Column:
        low = name.lower()
        kind = "double" if low in xy else wanted.get(low, "text")
        if kind in ("int", "integer", "bigint", "long", "smallint"):
            return cast_int_lenient(name).alias(low)
        if kind in ("double", "double precision", "float", "numeric", "decimal", "real"):
            return cast_decimal_comma(name).alias(low)
        return F.col(name).cast("string").alias(low)

    return df.select(*[one(n) for n in df.columns])


def resolve_scope(scope: str | list[str] | None) -> list[str]:
    """LIKE patterns: a bare key is a prefix, an item with a wildcard is taken as it is."""
    items = [] if scope is None else [scope] if isinstance(scope, str) else list(scope)
    cleaned = [str(i).strip() for i in items]
    return [i if ("%" in i or "_" in i) else f"{i}%" for i in cleaned if i]


def like_any(c, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col(c).like(p) for p in patterns], F.lit(False))


# Fixed replacements for category names, in this order.
SLUG_STEPS = (
    ("und ", ""), (" ", "_"), ("-", ""), ("/", "_"), ("ä", "ae"),
    ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), (",", ""),
)


def rename_slug(c) -> Column:
    return reduce(lambda e, s: F.replace(e, F.lit(s[0]), F.lit(s[1])), SLUG_STEPS, col(c))


# (?U) makes \w match letters outside ASCII.
_HOUSE_NUMBER = r"(?U)\s*\d+[\w,]*$"


def street_name(c) -> Column:
    return F.regexp_replace(F.trim(col(c)), _HOUSE_NUMBER, "")


def house_number(c) -> Column:
    return F.nullif(F.regexp_extract(F.trim(col(c)), r"(?U)\s*(\d+[\w,]*)$", 1), F.lit(""))


def grid_id(resolution: str, y, x) -> Column:
    return F.format_string("%sN%dE%d", F.lit(resolution), col(y).cast("bigint"), col(x).cast("bigint"))


def resolution_meters(c) -> Column:
    """``1km`` -> 1000, ``100m`` -> 100, anything else is NULL."""
    n = F.nullif(F.regexp_extract(col(c), r"^(\d+)(km|m)$", 1), F.lit("")).try_cast("int")
    return F.when(F.endswith(col(c), F.lit("km")), n * 1000).otherwise(n)


def classify_use_by_list(df: DataFrame, code: str, code_list: DataFrame) -> DataFrame:
    """Column building_use from a code list (code, building_use); a NULL code stays NULL, codes not listed raise.

    A code listed twice takes the first use in order.
    """
    from ..operators.tables import lookup

    listed = code_list.filter("code is not null").groupBy(F.col("code").alias(code)).agg(F.min("building_use").alias("building_use"))
    out = df.join(lookup(listed), code, "left")
    return out.withColumn("building_use", F.when(
        F.col(code).isNull() | F.col("building_use").isNotNull(), F.col("building_use")
    ).otherwise(F.raise_error(F.concat(F.lit("unknown building function code: "), F.col(code))).cast("string")))


def nan_to_zero(c) -> Column:
    return F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def hash_uniform(seed, key) -> Column:
    """Reproducible draw in [0, 1] from the first four bytes of an md5."""
    seed = F.lit(str(seed)) if not isinstance(seed, Column) else seed
    digest = F.md5(F.concat_ws(":", seed, col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967295.0


def weighted_choice(weights: list, labels: list[str], r) -> Column:
    """First label whose cumulative share reaches ``r``; NULL without any weight."""
    weights = [col(w) for w in weights]
    total = reduce(lambda a, b: a + b, weights)
    out = F.when(total <= 0, F.lit(None).cast("string"))
    running = F.lit(0.0)
    safe = F.when(total > 0, total).otherwise(F.lit(1.0))
    for w, label in list(zip(weights, labels))[:-1]:
        running = running + w
        out = out.when(col(r) <= running / safe, F.lit(label))
    return out.when(total > 0, F.lit(labels[-1]))


# Construction periods and the years they cover (the last ends with the simulation).
AGE_CLASSES = (
    ("-1919", 1860, 1918), ("1919-1948", 1919, 1948), ("1949-1978", 1949, 1978),
    ("1979-1990", 1979, 1990), ("1991-2000", 1991, 2000), ("2001-2010", 2001, 2010),
    ("2011-2019", 2011, 2019), ("2020-", 2020, None),
)
PERIODS = tuple(c[0] for c in AGE_CLASSES)


def year_from_class(age_class, u, last_year: int) -> Column:
    """Uniform year inside the class, both ends included."""
    c, u = col(age_class), col(u)
    out = None
    for label, lo, hi in AGE_CLASSES:
        span = (hi or last_year) - lo + 1
        year = (F.lit(lo) + F.least(F.floor(u * span), F.lit(span - 1))).cast("int")
        out = F.when(c == label, year) if out is None else out.when(c == label, year)
    return out


def normal_from_uniform(u1, u2) -> Column:
    """Standard normal draw (Box-Muller) from two uniform draws."""
    u1, u2 = col(u1), col(u2)
    return F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * F.pi() * u2)


def split_url(url) -> Column:
    """struct<filename, stem, extension> of the path of a URL."""
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    return let(F.regexp_extract(path, r"([^/]*)$", 1), lambda f: F.struct(
        f.alias("filename"),
        F.when(f.rlike(r"^\.*[^.].*\."), F.regexp_replace(f, r"\.[^.]*$", "")).otherwise(f).alias("stem"),
        F.when(f.rlike(r"^\.*[^.].*\."), F.regexp_extract(f, r"(\.[^.]*)$", 1)).otherwise(F.lit("")).alias("extension")))


def surrogate_id(*parts) -> Column:
    """Stable md5 id from its inputs, in place of a random one."""
    return F.md5(F.concat_ws(",", *[col(p).cast("string") for p in parts]))


def hourly_range(start, end, step_hours: int = 1) -> Column:
    """Times from start up to, not including, end."""
    step = F.expr(f"INTERVAL {int(step_hours)} HOUR")
    return F.filter(F.sequence(col(start), col(end), step), lambda t: t < col(end))
