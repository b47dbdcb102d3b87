"""Row numbers and ranks without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.session import cut_lineage


def number_rows(df: DataFrame, order: Iterable[Column | str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in a global order.

    Range-partitioned sort, then one offset per partition.  The sorted rows are
    checkpointed because both the offsets and the rows must come from the same
    partition bounds.  The broadcast offsets have one row per partition.
    """
    position = F.monotonically_increasing_id()
    placed = cut_lineage(df.orderBy(*order).withColumn("__position", position))
    part = F.shiftright("__position", 33)
    row_in_part = F.col("__position").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__offset") + row_in_part + 1).drop("__part", "__offset", "__position")


def hash_rank(
    df: DataFrame, keys: Iterable[str], digest: str, name: str, digits: Column, tie: Iterable[str] = ()
) -> DataFrame:
    """Rank by a hexadecimal digest inside each key, exact for any group size.

    A digest is uniform, so its leading hex digits cut every group into equal
    slices whatever the data looks like.  Slices are ranked on their own and
    shifted by the number of rows in the slices before them.
    """
    keys = list(keys)
    sliced = df.withColumn("__slice", F.substring(F.col(digest), F.lit(1), digits))
    sizes = sliced.groupBy(*keys, "__slice").agg(F.count("*").alias("__rows"))
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__slice", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(W.partitionBy(*keys, "__slice").orderBy(digest, *tie))
    ranked = sliced.withColumn("__inside", inside).join(offsets, [*keys, "__slice"])
    return ranked.withColumn(name, F.col("__inside") + F.col("__offset")).drop("__slice", "__inside", "__offset")


def slice_digits(rows: Column) -> Column:
    """Hex digits that cut ``rows`` rows into about sqrt(rows) slices."""
    return F.floor(F.log(F.greatest(rows, F.lit(1)).cast("double")) / F.log(F.lit(256.0))).cast("int")
