"""Grouped aggregates that stay balanced when one key holds a large share of the rows.

Every function here aggregates first (partial sums before the shuffle) and joins
the small result back, instead of pulling a whole group into one window task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.functions.scalars import ratio
from quadrat.operators.joins import beside


def with_group(df: DataFrame, keys: Iterable[str], aggregates: dict[str, Column]) -> DataFrame:
    """Attach group aggregates to every row of the group; without keys, of the table."""
    keys = list(keys)
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.join(totals, keys, "left") if keys else beside(df, totals, keys)


def share_of_group(df: DataFrame, keys: Iterable[str], value: str, name: str) -> DataFrame:
    """Value divided by the total of its group."""
    out = with_group(df, keys, {"__total": F.sum(value)})
    return out.withColumn(name, ratio(F.col(value), F.col("__total"))).drop("__total")


def profile(df: DataFrame, keys: Iterable[str], values: Iterable[str]) -> DataFrame:
    """Minimum, maximum, mean and sample deviation of several columns in one aggregate."""
    out = []
    for v in values:
        out += [
            F.min(v).alias(f"min_{v}"),
            F.max(v).alias(f"max_{v}"),
            F.avg(v).alias(f"mean_{v}"),
            F.stddev_samp(v).alias(f"sd_{v}"),
        ]
    return df.groupBy(*keys).agg(*out)


def status_counts(df: DataFrame, keys: Iterable[str], entity: str, conditions: dict[str, Column]) -> DataFrame:
    """Distinct entities per group for each condition; null where no entity qualifies.

    Rows fold to one per entity first, so the count needs no DISTINCT expansion
    and an entity with very many rows is reduced before the shuffle.
    """
    keys = list(keys)
    per_entity = df.groupBy(*keys, entity).agg(
        *[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()]
    )
    return per_entity.groupBy(*keys).agg(*[F.nullif(F.sum(n), F.lit(0)).alias(n) for n in conditions])


def distinct_per_group(df: DataFrame, keys: Iterable[str], value: str, name: str) -> DataFrame:
    """Distinct non-null values per group, deduplicated before the group is formed."""
    keys = list(keys)
    return df.groupBy(*keys, value).agg(F.lit(1)).groupBy(*keys).agg(F.count(value).alias(name))


def kth_row(df: DataFrame, keys: Iterable[str], order: Iterable[Column], k: int) -> DataFrame:
    """The k-th row of each group.

    ``row_number() <= k`` is also applied below the shuffle by Spark, so a hot
    group sends at most k rows per task; the equality is tested afterwards.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__k", F.row_number().over(window)).where(F.col("__k") <= k)
    return ranked.where(F.col("__k") == k).drop("__k")


def first_k_rows(df: DataFrame, keys: Iterable[str], order: Iterable[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each group with their rank."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def set_regions(df: DataFrame, keys: Iterable[str], element: str, group: str, name: str = "n") -> DataFrame:
    """Size of every disjoint region when elements are assigned to the groups they occur in."""
    keys = list(keys)
    seen = df.select(*keys, element, group).where(F.col(group).isNotNull()).distinct()
    signature = F.concat_ws(",", F.sort_array(F.collect_set(group)))
    return (
        seen.groupBy(*keys, element).agg(signature.alias("region")).groupBy(*keys, "region").agg(F.count("*").alias(name))
    )
