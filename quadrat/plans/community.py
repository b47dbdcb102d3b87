"""From a wide count table and the season's nests to community statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators import composition, diversity, inference, joins, mantel, pairs, panel, permutation, reshape, resample
from quadrat.plans import field_rules as rules
from quadrat.session import cut_lineage

NEST = "nest_id"


def swab_history(observed: DataFrame) -> dict[str, DataFrame]:
    """Observations of swabbed nests with the first three swabs, and the nests never swabbed."""
    first = panel.first_value(observed, NEST, "day_of_year", "num_host_egg", "num_host_egg_first_day")
    rows = observed.join(first, NEST, "left")
    swabbed = panel.entities_where(rows, NEST, F.col("host_swab") == "yes")
    kept = joins.keep_members(rows, swabbed, NEST)
    out = panel.with_kth_events(
        kept, NEST, "date", F.col("host_swab") == "yes", "num_host_egg", "num_eggs_", "_host_swab", "host_swab_order"
    )
    return {"swab_nests": out, "not_swabbed": joins.drop_members(rows, swabbed, NEST)}


def sequencing(counts: DataFrame, markers: tuple[str, ...] = ("mul1806", "cou1805")) -> dict[str, DataFrame]:
    """Kept features, their taxonomy and sequences, and long counts with decoded samples.

    ``counts`` is wide: taxonomy columns, sequences, and a column per sample whose
    name contains one of the run markers.
    """
    samples = [c for c in counts.columns if any(m in c for m in markers)]
    levels = [c for c in rules.TAXON_LEVELS if c in counts.columns]
    long = reshape.to_long(counts, levels, samples, "sample", "reads")
    key = F.concat_ws("-", *[F.coalesce(c, F.lit("NA")) for c in levels])
    long = composition.prevalence_filter(long.withColumn("__taxo", key), "__taxo", "reads").drop("__taxo")
    taxonomy = composition.clean_taxonomy(
        long.select(*levels).distinct(), levels, rules.UNKNOWN_TAXON, keep=F.col("kingdom") == "Bacteria", underscore="species"
    )
    cells = joins.keep_members(long.select("asv_name", "sample", "reads"), taxonomy, "asv_name").distinct()
    sequences = joins.keep_members(counts.select("asv_name", "asv_sequences"), taxonomy, "asv_name").distinct()
    return {
        "pilot_taxo": taxonomy,
        "pilot_asv_seq": sequences,
        "pilot_sample_asv": composition.decode_labels(cells, "sample", NEST, "control_type"),
    }


def cohort(samples: DataFrame, swabs: DataFrame, target: str, site: str) -> DataFrame:
    """Nests swabbed at an early egg, once per comparison they belong to.

    ``Site`` compares one host species over the sites, ``Species`` the species of one site.
    """
    early = panel.entities_where(swabs, NEST, (F.col("host_swab") == "yes") & (F.col("num_host_egg") < rules.MAX_COHORT_EGGS))
    nests = swabs.select(NEST, "host_species", "site").distinct()
    known = joins.keep_members(joins.keep_members(nests, early, NEST), samples, NEST)
    subsets = {
        "Site": known.where(F.col("host_species") == target).withColumn("group", F.col("site")),
        "Species": known.where(F.col("site") == site).withColumn("group", F.col("host_species")),
    }
    return reshape.stack_tagged(subsets, "comparison")


def community_statistics(
    cells: DataFrame, members: DataFrame, coordinates: DataFrame, groups: list[str], iterations: int = 100, permuted: int = 999
) -> dict[str, DataFrame]:
    """Diversity, distances and tests of one comparison.

    ``cells`` has ``nest_id, asv_name, reads``; ``members`` one row per nest with its
    ``group``; ``coordinates`` has ``nest_id, latitude, longitude``.  The draws and the
    pair table are written once because every later result reads them.
    """
    cells = composition.drop_empty(joins.keep_members(cells, members, NEST), "asv_name", "reads")
    depth = composition.depth(cells, NEST, "reads").agg(F.min("depth")).scalar()
    drawn = cut_lineage(resample.rarefy_draw(cells, NEST, "asv_name", "reads", depth, iterations))
    metrics = diversity.alpha_long(diversity.alpha(drawn, ["iter", NEST], "reads"), ["iter", NEST])
    alpha = diversity.replicate_summary(metrics, [NEST, "metric"]).join(members.select(NEST, "group"), NEST)
    mean = resample.replicate_mean(drawn, NEST, "asv_name", "reads", iterations)
    bray = cut_lineage(pairs.community_distance(drawn, NEST, "asv_name", "reads", "bray", replicate="iter"))
    geo = pairs.geographic_distance(coordinates.join(members.select(NEST), NEST, "left_semi"), NEST, "latitude", "longitude")
    centroid = inference.centroid_distances(bray, members, NEST, "group", "distance")
    return {
        "read_depth": composition.depth(cells, NEST, "reads"),
        "coverage": composition.goods_coverage(cells, [NEST], "reads"),
        "curve": composition.rarefaction_curve(cells, NEST, "reads"),
        "alpha": alpha,
        "alpha_t": inference.t_pooled(alpha, ["metric"], "group", "mean_value", tuple(groups)),
        "alpha_levene": inference.levene(alpha, ["metric"], "group", "mean_value"),
        "alpha_normality": inference.shapiro_wilk(alpha, ["metric", "group"], "mean_value"),
        "bray": bray,
        "mantel": mantel.mantel(bray, geo, members, NEST, "distance", "metres", "kendall", permuted),
        "dispersion": inference.one_way(centroid, [], "group", "z"),
        "permanova": permutation.permanova(bray, members, NEST, "group", "distance", permuted),
        "indicators": permutation.indicator_test(mean, members, NEST, "asv_name", "group", "mean_reads", groups, permuted),
    }
