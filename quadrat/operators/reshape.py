"""Wide and long forms, tagged stacks, distinct rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Iterable[str], columns: Iterable[str], name: str, value: str) -> DataFrame:
    """One row per id and listed column."""
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(
    df: DataFrame, ids: Iterable[str], name: str, value: str, columns: list, prefix: str = "", fill=None
) -> DataFrame:
    """One column per declared value; the list is declared so no extra pass looks for it."""
    wide = df.groupBy(*ids).pivot(name, columns).agg(F.first(value, ignorenulls=True))
    wide = wide.select(*ids, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns])
    return wide if fill is None else wide.fillna(fill, subset=[f"{prefix}{c}" for c in columns])


def pairs_to_wide(pairs: DataFrame, ids: list, value: str, prefix: str = "distance_to_") -> DataFrame:
    """Square export of a pair table for a declared id list; the diagonal is zero."""
    both = pairs.select("id_a", "id_b", value).unionByName(
        pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), value)
    )
    return both.groupBy("id_a").pivot("id_b", ids).agg(F.first(value)).select(
        "id_a",
        *[
            F.when(F.col("id_a") == F.lit(i), F.lit(0.0)).otherwise(F.col(f"`{i}`")).alias(f"{prefix}{i}")
            for i in ids
        ],
    )


def wide_to_pairs(wide: DataFrame, id_column: str, value: str, prefix: str = "distance_to_") -> DataFrame:
    """Each unordered pair once from a square table whose column names carry the second id."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    id_type = wide.schema[id_column].dataType
    long = wide.unpivot([id_column], columns, "other", value)
    other = F.trim(F.substr(F.col("other"), F.lit(len(prefix) + 1))).cast(id_type)
    return long.select(F.col(id_column).alias("id_a"), other.alias("id_b"), value).where("id_a < id_b")


def stack_tagged(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack tables with a literal column that says which one a row came from."""
    tagged = [df.withColumn(tag, F.lit(key)) for key, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_distinct(tables: list[DataFrame]) -> DataFrame:
    """Same-schema tables stacked, repeated rows once."""
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def roll_up(df: DataFrame, keys: Iterable[str], levels: Iterable[str], aggregates: dict[str, Column]) -> DataFrame:
    """The same aggregate at every level of a hierarchy in one pass.

    Grouping sets aggregate each level on the map side before the one shuffle.
    """
    keys, levels = list(keys), list(levels)
    sets = [[*keys, level] for level in levels]
    named = [c.alias(n) for n, c in aggregates.items()]
    # a bit is 0 when the column takes part in the set, so the level is the one zero bit
    flags = [F.grouping(level) for level in levels]
    level_name = F.coalesce(*[F.when(flag == 0, F.lit(level)) for flag, level in zip(flags, levels, strict=True)])
    taxon = F.coalesce(*[F.when(flag == 0, F.col(level)) for flag, level in zip(flags, levels, strict=True)])
    out = df.groupingSets(sets, *keys, *levels).agg(level_name.alias("level"), taxon.alias("taxon"), *named)
    return out.select(*keys, "level", "taxon", *aggregates)
