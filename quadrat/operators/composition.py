"""Sample-by-feature count tables in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.scalars import ratio, replace_first
from quadrat.functions.special import log_gamma
from quadrat.operators.grouping import share_of_group


def drop_empty(cells: DataFrame, feature: str, value: str) -> DataFrame:
    """Only features with a positive total."""
    kept = cells.groupBy(feature).agg(F.sum(value).alias("__total")).where("__total > 0").select(feature)
    return cells.join(kept, feature, "left_semi")


# Label forms of the sequenced samples and controls.
CONTROL_PREFIXES = "^(dogsample|water|x00)"
ENTITY_PREFIXES = "^[aej]"
CLOACAL_PREFIX = "^x00"
RUN_SUFFIX = "_mul.*"
CONTROL_SUFFIX = "._(mul|cou).*"


def decode_labels(df: DataFrame, label: str, entity: str = "entity", control: str = "control_type") -> DataFrame:
    """Entity id and kind of control from a sample label."""
    text = F.col(label)
    return df.withColumns(
        {
            entity: F.when(~text.rlike(CONTROL_PREFIXES), F.regexp_replace(text, RUN_SUFFIX, "")),
            control: F.when(text.rlike(ENTITY_PREFIXES), F.lit(None).cast("string"))
            .when(text.rlike(CLOACAL_PREFIX), F.when(~text.contains("_cou"), F.lit("cloacal")))
            .otherwise(F.regexp_replace(text, CONTROL_SUFFIX, "")),
        }
    )


def prevalence(cells: DataFrame, feature: str, value: str) -> DataFrame:
    """Number of samples with the feature, and the share held by its largest sample."""
    positive = cells.where(F.col(value) > 0)
    return positive.groupBy(feature).agg(
        F.count("*").alias("occurrence"),
        F.max(value).alias("max_reads"),
        F.sum(value).alias("total_reads"),
        (F.max(value) / F.sum(value)).alias("sparsity"),
    )


def prevalence_filter(
    cells: DataFrame, feature: str, value: str, more_than: int = 3, max_sparsity: float = 0.9
) -> DataFrame:
    """Drop features seen in too few samples or concentrated in one."""
    kept = prevalence(cells, feature, value).where((F.col("occurrence") > more_than) & (F.col("sparsity") <= max_sparsity))
    return cells.join(kept.select(feature), feature, "left_semi")


def clean_taxonomy(
    taxonomy: DataFrame, levels: list[str], label: str, keep: Column | None = None, underscore: str | None = None
) -> DataFrame:
    """Distinct features of the wanted group, missing levels labelled, first underscore of one level blanked."""
    out = taxonomy if keep is None else taxonomy.where(keep)
    changes = {c: F.coalesce(F.col(c), F.lit(label)) for c in levels}
    if underscore:
        changes[underscore] = F.coalesce(replace_first(F.col(underscore), "_", " "), F.lit(label))
    return out.withColumns(changes).distinct()


def depth(cells: DataFrame, sample: str, value: str, name: str = "depth") -> DataFrame:
    """Total count per sample."""
    return cells.groupBy(sample).agg(F.sum(value).alias(name))


def goods_coverage(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of reads not in singletons, in percent."""
    sums = cells.groupBy(*keys).agg(F.sum(value).alias("reads"), F.count_if(F.col(value) == 1).alias("singletons"))
    return sums.withColumn("goods", 100 * (1 - ratio(F.col("singletons"), F.col("reads"))))


def rarefaction_curve(cells: DataFrame, sample: str, value: str, step: int = 100) -> DataFrame:
    """Expected number of features at depths 1, 1 + step, ... and at the full depth.

    Features with the same count contribute the same term, so the table first
    shrinks to one row per sample and count.
    """
    positive = cells.where(F.col(value) > 0)
    totals = positive.groupBy(sample).agg(F.sum(value).alias("total"))
    spectrum = positive.groupBy(sample, F.col(value).alias("size")).agg(F.count("*").alias("features"))
    steps = F.array_distinct(F.concat(F.sequence(F.lit(1).cast("long"), F.col("total"), F.lit(step).cast("long")), F.array("total")))
    grid = spectrum.join(totals, sample).select("*", F.explode(steps).alias("depth"))
    total, size, n = (F.col(c).cast("double") for c in ("total", "size", "depth"))
    log_missed = log_gamma(total - size + 1) - log_gamma(total - size - n + 1) - log_gamma(total + 1) + log_gamma(total - n + 1)
    term = F.when(n > total - size, F.lit(1.0)).otherwise(1 - F.exp(log_missed))
    return grid.groupBy(sample, "depth").agg(F.sum(F.col("features") * term).alias("expected"))


def presence(cells: DataFrame, value: str, name: str = "present") -> DataFrame:
    """One where the feature occurs, else zero."""
    return cells.withColumn(name, (F.col(value) > 0).cast("int"))


def hellinger(cells: DataFrame, sample: str, value: str, name: str = "hellinger") -> DataFrame:
    """Square root of the relative abundance."""
    return share_of_group(cells, [sample], value, name).withColumn(name, F.sqrt(name))


def group_means(cells: DataFrame, members: DataFrame, sample: str, feature: str, group: str, value: str) -> DataFrame:
    """Mean and prevalence per group and feature, absent features counted as zero.

    Zeros are never written out: sums run over the rows that exist and are
    divided by the number of samples in the group.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("n_samples"))
    sums = (
        cells.join(members.select(sample, group), sample)
        .groupBy(feature, group)
        .agg(F.sum(value).alias("__sum"), F.count_if(F.col(value) > 0).alias("__present"))
    )
    out = sums.join(sizes, group)
    return out.select(
        feature,
        group,
        "n_samples",
        ratio(F.col("__sum"), F.col("n_samples")).alias("mean"),
        ratio(F.col("__present"), F.col("n_samples")).alias("fidelity"),
    )
