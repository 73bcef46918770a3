"""Running sums over any number of rows, without a task that takes a whole group.

Rows are dealt to ranges of the order column, bounded by approximate quantiles of
the table (one row of at most ``RANGES`` values). Sums of each group and range are
partial aggregates; their prefixes run over at most ``RANGES`` rows of a group, and
rows are ranked within their own range only. A hot group, or no group at all,
spreads over all ranges. Equal values of the order column share a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def ranged(df: DataFrame, order: str, ranges: int = RANGES, bounds_of: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__range``; the bounds may come from another table that has the column."""
    shares = [k / ranges for k in range(1, ranges)]
    bounds = (df if bounds_of is None else bounds_of).agg(F.percentile_approx(order, shares, 10_000).alias("__bounds"))
    # One row of less than ``ranges`` values.
    return df.crossJoin(F.broadcast(bounds)).withColumn("__range", F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col(order))), F.lit(0))).drop("__bounds")


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], ranges: int = RANGES, bounds_of: DataFrame | None = None) -> DataFrame:
    """``df`` with the running sum of each column of ``sums`` within its group, in ``order``, own row included."""
    df = ranged(df, order[0], ranges, bounds_of)
    keys = [*by, "__range"]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__total_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[F.coalesce(F.sum(f"__total_{k}").over(earlier), F.lit(0)).alias(f"__base_{k}") for k in sums])
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    joined = df.withColumns({f"__own_{k}": F.sum(c).over(own) for k, c in sums.items()}).join(base, same)
    kept = [c for c in df.columns if c != "__range"]
    return joined.select(*kept, *[(F.col(f"__base_{k}") + F.col(f"__own_{k}")).alias(k) for k in sums])
