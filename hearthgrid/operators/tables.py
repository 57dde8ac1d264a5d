"""Table level operators: upserts, lookups with fallback, ranked and weighted aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, of several the one with the smallest remaining columns; stored, so joins can still split hot keys of the other side."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else rows.distinct()
    return cut_lineage(one.select(*rows.columns))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    """Insert or replace by key. With ``cols`` a matching row keeps its other columns.

    Of several updates of one key the one with the smallest remaining columns counts.
    """
    updates = one_per_key(updates, keys)
    if cols is None:
        kept = target.join(updates.select(*keys).distinct(), keys, "left_anti")
        return kept.unionByName(updates, allowMissingColumns=True)
    renamed = updates.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in updates.columns if c not in keys],
                             F.lit(True).alias("__hit"))
    joined = target.withColumn("__old", F.lit(True)).join(renamed, keys, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in updates.columns:
            out.append(F.col(c))
        elif c in cols:
            out.append(F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__new_{c}")).alias(c))
    return joined.select(*out)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose key is new; the first of equal new keys wins by the remaining columns."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else rows.distinct()
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], assign: dict[str, str]) -> DataFrame:
    """UPDATE .. FROM: matched rows take the source value (also NULL), others keep theirs.

    Of several source rows of one key the one with the smallest values counts: rows of the target never multiply.
    """
    src = one_per_key(source.select(*keys, *[F.col(s).alias(f"__{t}") for t, s in assign.items()], F.lit(True).alias("__hit")), keys)
    out = target.join(src, keys, "left")
    for t in assign:
        new = F.col(f"__{t}")
        out = out.withColumn(t, F.when(F.col("__hit"), new).otherwise(F.col(t)) if t in target.columns else new)
    return out.drop("__hit", *[f"__{t}" for t in assign])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key, the first in the given order, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__r")).select(*keys, "__r.*")


def eav_pivot(properties: DataFrame, key: list[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Attribute rows to columns: ``wanted`` maps output -> (attribute name, value column)."""
    names = sorted({name for name, _ in wanted.values()})
    return properties.filter(F.col("name").isin(names)).groupBy(*key).agg(*[
        F.max(F.when(F.col("name") == name, F.col(value))).alias(out) for out, (name, value) in wanted.items()])


def same(left: list[str], right: list[str]) -> Column:
    """Equality of key columns in which NULL equals NULL, as in GROUP BY."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their group; a NULL key is a group of its own."""
    named = groups.withColumnsRenamed({k: f"__g_{k}" for k in keys})
    return rows.join(named, same(keys, [f"__g_{k}" for k in keys]), how).drop(*[f"__g_{k}" for k in keys])


#: distinct values of one group that are ordered in one task, and bins of a histogram
ORDERED_VALUES, BINS = 20_000, 4096


def median_with_support(df: DataFrame, keys: list[str], value: Column, min_count: int) -> DataFrame:
    """Exact median per group, kept only with enough samples; a NULL key is a group of its own.

    Equal values are counted first. A group with more than ``ORDERED_VALUES`` different values is narrowed by
    histograms: counts per bin tell which bin holds the middle, and only its values go on, in finer
    bins over the range that is left. What is left of a group is ordered in one task.
    NULL values count as samples but not for the median; a group without other values has the median NULL. NaN is the largest value.
    """
    counted = cut_lineage(df.groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("__n")))
    sizes = counted.groupBy(*keys).agg(
        F.sum("__n").alias("sample_count"), F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))).alias("__m"), F.count("__v").alias("__d")).filter(
        F.col("sample_count") >= min_count)
    # one or two ranks in the middle; each is sought on its own
    wanted = F.array_distinct(F.array(F.floor((F.col("__m") + 1) / 2), F.floor((F.col("__m") + 2) / 2)))
    ranks = sizes.filter("__m > 0").select(*keys, F.posexplode(wanted).alias("__t", "__k"))
    left = join_groups(counted.filter("__v IS NOT NULL"), cut_lineage(ranks), keys)
    own = [*keys, "__t"]
    group = Window.partitionBy(*own)
    if (sizes.agg(F.max("__d")).first()[0] or 0) > ORDERED_VALUES:
        number = F.col("__v").cast("double")
        finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
        left = cut_lineage(left)
        while True:
            most = left.groupBy(*own).agg(F.count("*").alias("d"), (F.max(finite) / BINS - F.min(finite) / BINS).alias("w")).filter(
                F.col("d") > ORDERED_VALUES).agg(F.max("w")).first()[0]
            if not most:
                break
            width = 2.0 ** math.ceil(math.log2(max(most, 2.0**-1022)))
            binned = left.withColumn("__b", F.when(F.isnan(number), F.lit(2**63 - 1)).otherwise(F.floor(number / width)))
            histogram = binned.groupBy(*own, "__b").agg(F.sum("__n").alias("__n"), F.first("__k").alias("__k"))
            upto = F.sum("__n").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
            middle = histogram.withColumn("__upto", upto).filter((F.col("__upto") >= F.col("__k")) & (F.col("__upto") - F.col("__n") < F.col("__k")))
            bins = cut_lineage(middle.select(*own, "__b", (F.col("__k") - F.col("__upto") + F.col("__n")).alias("__k")))
            left = cut_lineage(join_groups(binned.drop("__k"), bins, [*own, "__b"]).select(*own, "__v", "__n", "__k"))
    last = F.sum("__n").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    found = left.withColumn("__last", last).filter((F.col("__last") >= F.col("__k")) & (F.col("__last") - F.col("__n") < F.col("__k"))).groupBy(*keys).agg(
        F.min("__v").alias("__first"), F.max("__v").alias("__second"))
    return join_groups(sizes, found, keys, "left").select(
        *keys, (F.col("__first") + (F.col("__second") - F.col("__first")) * 0.5).alias("median"), "sample_count")


BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count up to the bound; the check behind every broadcast of a lookup table."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup table for broadcast when its size permits.

    Lookups have few keys, so a shuffle by them would send a huge table to a handful of tasks.
    Beyond the bound the join stays a shuffle join, whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def interval_or_nearest(rows: DataFrame, intervals: DataFrame, on: list[str], year: str, row_key: list[str] | None = None,
                        start: str = "start_year", end: str = "end_year") -> DataFrame:
    """The interval that holds the year, else the closest one (ties: earlier start, then end, then the rest).

    The choice depends on the key and the year alone, so it is made once per distinct pair and joined
    back; repeated rows stay repeated. Rows whose key is NULL or has no interval drop out, as in a join.
    A NULL year takes the earliest interval.
    """
    from ..session import cut_lineage

    payload = [c for c in intervals.columns if c not in on]
    pairs = rows.select(*on, F.col(year).alias("__year")).distinct()
    gap = F.greatest(F.col(start) - F.col("__year"), F.col("__year") - F.col(end), F.lit(0))
    best = cut_lineage(pairs.join(intervals, on).groupBy(*on, "__year").agg(F.min_by(
        F.struct(*payload), F.struct(gap.alias("g"), F.col(start).alias("s"), F.col(end).alias("e"), F.struct(*payload).alias("p"))).alias("__m")))
    named = best.withColumnsRenamed({k: f"__g_{k}" for k in on})
    found = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__g_{k}") for k in on]) & F.col(year).eqNullSafe(F.col("__year"))
    return rows.join(named, found).select(*rows.columns, "__m.*")


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str = "rank",
                weight: str | None = None) -> DataFrame:
    """Position of each row inside its group (or running sum of ``weight``), also for huge groups.

    Rows are range partitioned by (group, order), so a large group spreads over many tasks; each
    range is sorted on its own, and a small aggregate adds what the same group has in earlier ranges.
    The ranges are fixed by a checkpoint, because their bounds come from a sample. A NULL group is a
    group like any other.
    """
    from ..session import cut_lineage

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("__ord", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    fixed = cut_lineage(keyed.repartitionByRange(parts, *[F.col(g) for g in group], F.col("__ord")).withColumn(
        "__part", F.spark_partition_id()))
    size = F.sum(weight) if weight else F.count("*")
    inside = Window.partitionBy(*group, "__part").orderBy("__ord")
    here = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(inside)
    # one row per group and range: at most as many rows per group as there are ranges
    before = fixed.groupBy(*group, "__part").agg(size.alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(
        Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return join_groups(fixed.withColumn("__here", here), before, [*group, "__part"]).withColumn(
        name, F.col("__here") + F.col("__before")).drop("__here", "__before", "__part", "__ord")


def outside_range(c: Column, low) -> Column:
    """Rows to keep after a DELETE .. WHERE c < low: NULL stays."""
    return ~F.coalesce(c < low, F.lit(False))


def page(df: DataFrame, columns: list[str], order: list[str], limit: int = 100, offset: int = 0, equal: dict | None = None,
         above: dict | None = None, below: dict | None = None, tolerances: dict[str, float] | None = None) -> DataFrame:
    """One page of a filtered table in a stated order.

    ``equal``, ``above`` and ``below`` filter by column before the page is cut and reach the scan;
    ``tolerances`` maps line columns to a tolerance of simplification and is applied to the rows of the page alone.
    """
    from ..functions.text import simplify

    for names, test in ((equal, lambda c, v: c.eqNullSafe(F.lit(v))), (above, lambda c, v: c > F.lit(v)), (below, lambda c, v: c < F.lit(v))):
        for name, value in (names or {}).items():
            df = df.filter(test(F.col(name), value))
    out = df.orderBy(*order).offset(offset).limit(limit).select(*columns)
    return out.withColumns({c: simplify(c, t) for c, t in tolerances.items()}) if tolerances else out
