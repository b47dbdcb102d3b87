"""Joins with the semantics of name-matched tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.names import suffix_columns


def natural_join(left: DataFrame, right: DataFrame, how: str = "left", null_safe: bool = True) -> DataFrame:
    """Join on every column the two sides share; null keys match null keys.

    Null-safe equality is still a hash-partitioned equi-join for Spark.
    """
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("no shared column to join on")
    return keyed_join(left, right, shared, how, null_safe)


def keyed_join(
    left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join on named keys and keep one copy of each key."""
    keys = list(keys)
    if not null_safe:
        return left.join(right, keys, how)
    marked = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(marked[f"__r_{k}"]) for k in keys])
    joined = left.join(marked, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "full", "outer", "full_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__r_{k}")) for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])


def fold_join(tables: list[DataFrame], keys: Iterable[str], how: str = "full") -> DataFrame:
    """Join many partial tables on the same keys.

    All joins hash on ``keys``, so the running result is not shuffled again.
    """
    keys = list(keys)
    return reduce(lambda a, b: a.join(b, keys, how), tables)


def keep_members(df: DataFrame, members: DataFrame, on: str, member_column: str | None = None) -> DataFrame:
    """Rows whose key occurs in ``members``; null keys never do."""
    ids = members.select(F.col(member_column or on).alias(on)).where(F.col(on).isNotNull())
    return df.join(ids, on, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, on: str, member_column: str | None = None) -> DataFrame:
    """Rows whose key does not occur in ``members``; rows with a null key stay."""
    ids = members.select(F.col(member_column or on).alias(on)).where(F.col(on).isNotNull())
    return df.join(ids, on, "left_anti")


def annotate_pairs(
    pairs: DataFrame, dim: DataFrame, dim_id: str, id_a: str = "id_a", id_b: str = "id_b", suffix: str = "_compared"
) -> DataFrame:
    """Attach the dimension to both ends of a pair table, the second copy with a suffix."""
    first = dim.withColumnRenamed(dim_id, id_a)
    second = suffix_columns(dim.withColumnRenamed(dim_id, id_b), suffix, keep=[id_b])
    return pairs.join(first, id_a, "left").join(second, id_b, "left")


def beside(df: DataFrame, summary: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows next to the summary of their group; without keys the summary has one row, which is read as a scalar.

    A join on no column at all would be a product; a scalar subquery is not.
    """
    keys = list(keys)
    if keys:
        return df.join(summary, keys)
    one = summary.select(F.struct(*summary.columns)).scalar()
    return df.withColumn("__one", one).select(*df.columns, "__one.*")
