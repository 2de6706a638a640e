"""Order-based helpers that never gather a table in one task: range buckets and their neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A null id sorts before every other id.
NULL_ID = -(2**63)


def range_bucket(df: DataFrame, key: str, buckets: int) -> Column:
    """A column expression that deals a long key into ranges of about equal row counts.

    One pass over the key column finds the bounds, of which there are at most `buckets`; a row is
    placed by two short searches, so that the cost a row is of the order of sqrt(buckets).
    """
    points = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(key, points, max(10_000, 20 * buckets))).first()[0] if points else None
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    coarse = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
    first = F.size(F.filter(coarse, lambda x: x <= F.col(key)))
    inside = F.size(F.filter(F.element_at(fine, first), lambda x: x <= F.col(key)))
    return F.when(first == 0, 0).otherwise((first - 1) * width + inside).cast("int")


def running_totals(parts: DataFrame, key: str, *sums: str) -> DataFrame:
    """Per-partition totals to exclusive prefix sums. parts has a row a partition, so one task does it."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return parts.select(
        key,
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(f"{c}_before") for c in sums],
        *[F.sum(c).over(whole).cast("long").alias(f"{c}_all") for c in sums],
    )
