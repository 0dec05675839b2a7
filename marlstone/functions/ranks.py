"""Ranks and prefix sums over groups of any size.

A window over a whole group puts the group into one task. Here every group is cut into buckets, rows are
numbered within their bucket, and the buckets' totals, a small table, are summed up before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def salt(*columns: str, buckets: int) -> Column:
    """A stable bucket number."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def bucketed_prefix_sums(df: DataFrame, group: list[str], buckets: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Add, for each of values, the sum over the rows before and including each, in the order (buckets, order) within group.

    group and buckets are columns of df; a bucket must fit one task, and the buckets of a group too (they are one
    row each). Null group keys are equal to each other; ties of order are broken arbitrarily but once only, since both
    passes read the same bucket.
    """
    keys = [*group, *buckets]
    v = df.withColumns({f"_v_{name}": value for name, value in values.items()})
    sums = v.groupBy(*keys).agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in values])
    earlier = W.partitionBy(*group).orderBy(*buckets).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in values])
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    within = v.withColumns({f"_w_{name}": F.coalesce(F.sum(f"_v_{name}").over(upto), F.lit(0)) for name in values})
    joined = within.join(before, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    added = joined.withColumns({name: F.col(f"_w_{name}") + F.col(f"_b_{name}") for name in values})
    return added.drop(*[f"_{x}_{name}" for x in "vwb" for name in values], *[f"_k_{c}" for c in keys])


def bucketed_prefix_sum(df: DataFrame, group: list[str], buckets: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """bucketed_prefix_sums of one value."""
    return bucketed_prefix_sums(df, group, buckets, order, {out: value})
