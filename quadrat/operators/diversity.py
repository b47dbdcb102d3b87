"""Diversity within a sample."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.scalars import ratio

RARE = 10
METRICS = ["richness", "chao1", "shannon", "simpson", "evenness"]


def alpha(cells: DataFrame, keys: Iterable[str], value: str) -> DataFrame:
    """Richness, Chao1, ACE, Shannon, Simpson and Pielou evenness in one aggregate.

    With x the counts and N their sum, Shannon is ln N - sum(x ln x)/N and Simpson
    1 - sum(x^2)/N^2, so proportions need not be joined back to the cells.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    rare = x <= RARE
    sums = cells.where(F.col(value) > 0).groupBy(*keys).agg(
        F.count("*").alias("richness"),
        F.sum(x).alias("n"),
        F.sum(x * F.log(x)).alias("xlogx"),
        F.sum(x * x).alias("xx"),
        F.count_if(x == 1).alias("f1"),
        F.count_if(x == 2).alias("f2"),
        F.count_if(x > RARE).alias("s_abund"),
        F.count_if(rare).alias("s_rare"),
        F.coalesce(F.sum(F.when(rare, x)), F.lit(0.0)).alias("n_rare"),
        F.coalesce(F.sum(F.when(rare, x * (x - 1))), F.lit(0.0)).alias("rare_pairs"),
    )
    col = F.col
    out = sums.withColumns(
        {
            "chao1": col("richness") + col("f1") * (col("f1") - 1) / (2.0 * (col("f2") + 1)),
            "shannon": F.log("n") - col("xlogx") / col("n"),
            "simpson": 1 - col("xx") / (col("n") * col("n")),
            "coverage": 1 - ratio(col("f1"), col("n_rare")),
        }
    )
    spread = F.try_divide(col("s_rare"), col("coverage")) * F.try_divide(
        col("rare_pairs"), col("n_rare") * (col("n_rare") - 1)
    )
    gamma = F.greatest(spread - 1, F.lit(0.0))
    ace = col("s_abund") + F.try_divide(col("s_rare"), col("coverage")) + F.try_divide(col("f1"), col("coverage")) * gamma
    out = out.withColumns(
        {
            "evenness": F.try_divide(col("shannon"), F.log(col("richness").cast("double"))),
            "ace": F.when(col("s_rare") == 0, col("s_abund").cast("double")).otherwise(ace),
        }
    )
    return out.select(*keys, "richness", "chao1", "ace", "shannon", "simpson", "evenness")


def alpha_long(alpha_table: DataFrame, keys: Iterable[str], metrics: Iterable[str] = METRICS) -> DataFrame:
    """One row per sample and metric."""
    keys, metrics = list(keys), list(metrics)
    doubles = alpha_table.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(keys, metrics, "metric", "value")


def replicate_summary(long: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Mean, median, deviation, minimum and maximum over replicates.

    A group holds one row per replicate, a number the caller sets, so the built-in median is safe.
    """
    return long.groupBy(*keys).agg(
        F.avg("value").alias("mean_value"),
        F.median("value").alias("median_value"),
        F.stddev_samp("value").alias("sd_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
