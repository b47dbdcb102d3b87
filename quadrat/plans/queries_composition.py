"""Count-table operators: filters, coverage, transforms, roll-ups, diversity and rarefaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions.scalars import unite
from quadrat.operators import composition, diversity, grouping, resample
from quadrat.operators.reshape import roll_up
from quadrat.plans import views
from quadrat.plans.registry import query, rounded, rsql

ITERATIONS = 100
SEED = 11

# fewest reads of any sample: the depth all samples are drawn down to
_DEPTH_SQL = "select min(total) as dep from (select sum(reads) as total from reads group by sample)"


def min_depth_of(cells):
    """The fewest reads of any sample as a one-value subquery; nothing comes to the driver."""
    return composition.depth(cells, "sample", "reads").agg(F.min("depth")).scalar()


def rarefied(spark, d, iterations: int = ITERATIONS):
    cells = views.reads(spark, d)
    return resample.rarefy_draw(cells, "sample", "feature", "reads", min_depth_of(cells), iterations, SEED)


RARE_SQL = f"recursive {views.READS}, {resample.rarefy_sql('reads', _DEPTH_SQL, ITERATIONS, SEED)}"


# ---------------------------------------------------------------- filters and cohorts


@query(
    "prevalence_sparsity",
    f"""with cells as (select l_suppkey as sample, l_partkey as feature, count(*) as reads from lineitem group by 1, 2),
        p as (select feature, count(*) as occurrence, max(reads) / sum(reads) as sparsity from cells group by 1)
        select feature, occurrence, {rsql('sparsity')} as sparsity from p where occurrence > 3 and sparsity <= 0.25""",
)
def prevalence_sparsity(spark, d):
    from quadrat.sources.tables import load

    lines = load(spark, d, "lineitem")
    cells = lines.groupBy("l_suppkey", F.col("l_partkey").alias("feature")).agg(F.count("*").alias("reads"))
    kept = composition.prevalence(cells, "feature", "reads").where("occurrence > 3 and sparsity <= 0.25")
    return kept.select("feature", "occurrence", rounded("sparsity").alias("sparsity"))


@query(
    "prevalence_filter",
    f"""with {views.READS}, p as (select feature from reads group by 1 having count(*) > 3 and max(reads) / sum(reads) <= 0.02)
        select sample, feature, reads from reads where feature in (select feature from p)""",
)
def prevalence_filter(spark, d):
    cells = views.reads(spark, d)
    return composition.prevalence_filter(cells, "feature", "reads", 3, 0.02).select("sample", "feature", "reads")


@query(
    "taxonomy_clean",
    f"""with {views.TAXONOMY} select distinct feature, phylum, coalesce(regexp_replace(family, '/', ' '), 'Unknown') as family
        from taxonomy where phylum <> 'LARGE'""",
)
def taxonomy_clean(spark, d):
    taxa = views.taxonomy(spark, d).withColumn("family", F.replace("family", F.lit("/"), F.lit("_")))
    return composition.clean_taxonomy(
        taxa, ["phylum", "family"], "Unknown", keep=F.col("phylum") != "LARGE", underscore="family"
    )


@query(
    "cohort_subsets",
    f"""with {views.META}, cohort as (select * from meta where covariate < 8000)
        select 'Site' as comparison, sample, site, species from cohort where species = 'even'
        union all select 'Species', sample, site, species from cohort where site = 'ASIA'""",
)
def cohort_subsets(spark, d):
    from quadrat.operators.reshape import stack_tagged

    cohort = views.meta(spark, d).where("covariate < 8000").select("sample", "site", "species")
    subsets = {"Site": cohort.where("species = 'even'"), "Species": cohort.where("site = 'ASIA'")}
    return stack_tagged(subsets, "comparison")


@query(
    "read_depth",
    f"""with {views.READS}, {views.META} select m.sample, m.site || '_' || m.species as sample_group, cast(sum(reads) as bigint) as read_depth
        from meta m left join reads r on r.sample = m.sample group by 1, 2 order by read_depth desc, sample""",
)
def read_depth(spark, d):
    depth = composition.depth(views.reads(spark, d), "sample", "reads", "read_depth")
    labelled = views.meta(spark, d).select("sample", unite([F.col("site"), F.col("species")]).alias("sample_group"))
    return labelled.join(depth, "sample", "left").orderBy(F.col("read_depth").desc_nulls_last(), "sample")


@query(
    "goods_coverage",
    f"""with {views.READS} select sample, cast(sum(reads) as bigint) as reads, cast(sum(case when reads = 1 then 1 else 0 end) as bigint) as singletons,
               {rsql('100 * (1 - sum(case when reads = 1 then 1 else 0 end) / sum(reads)::double)')} as goods from reads group by 1""",
)
def goods_coverage(spark, d):
    out = composition.goods_coverage(views.reads(spark, d), ["sample"], "reads")
    return out.withColumn("goods", rounded("goods"))


@query("min_depth", f"with {views.READS} select cast(dep as bigint) as min_depth from ({_DEPTH_SQL})")
def min_depth(spark, d):
    return composition.depth(views.reads(spark, d), "sample", "reads").agg(F.min("depth").alias("min_depth"))


@query(
    "rarefaction_curve",
    f"""with {views.READS}, totals as (select sample, cast(sum(reads) as bigint) as total from reads group by 1),
        depths as (select distinct sample, total, depth from (
            select sample, total, unnest(range(1, total + 1, 100)) as depth from totals union all select sample, total, total from totals))
        select d.sample, d.depth, {rsql('''sum(case when d.depth > d.total - r.reads then 1 else 1 - exp(lgamma(d.total - r.reads + 1)
             - lgamma(d.total - r.reads - d.depth + 1) - lgamma(d.total + 1) + lgamma(d.total - d.depth + 1)) end)''', 5)} as expected
        from depths d join reads r on d.sample = r.sample group by 1, 2""",
)
def rarefaction_curve(spark, d):
    out = composition.rarefaction_curve(views.reads(spark, d), "sample", "reads", 100)
    return out.withColumn("expected", rounded("expected", 5))


# ---------------------------------------------------------------- transforms and roll-ups


@query(
    "relative_abundance",
    f"with {views.READS} select sample, feature, reads, {rsql('reads / sum(reads) over (partition by sample)')} as rel_abund from reads",
)
def relative_abundance(spark, d):
    out = grouping.share_of_group(views.reads(spark, d), ["sample"], "reads", "rel_abund")
    return out.withColumn("rel_abund", rounded("rel_abund"))


@query(
    "relative_abundance_check",
    f"""with {views.READS}, rel as (select sample, reads / sum(reads) over (partition by sample) as p from reads)
        select sample, {rsql('sum(p)')} as total from rel group by 1""",
)
def relative_abundance_check(spark, d):
    out = grouping.share_of_group(views.reads(spark, d), ["sample"], "reads", "rel_abund")
    return out.groupBy("sample").agg(rounded(F.sum("rel_abund")).alias("total"))


_TAXA = ["feature", "phylum", "family"]


def _with_taxonomy(spark, d, counts=None):
    cells = views.reads(spark, d) if counts is None else counts
    cells = grouping.share_of_group(cells, ["sample"], "reads", "rel_abund")
    cells = grouping.with_group(cells, ["sample"], {"total": F.sum("reads")})
    taxa = views.taxonomy(spark, d).withColumn("family", F.coalesce("family", F.lit("Unknown")))
    return cells.join(taxa, "feature")


@query(
    "hierarchy_rollup",
    f"with {views.READS}, {views.TAXONOMY}, full_rows as (select sample, r.feature, phylum, coalesce(family, 'Unknown') as family, reads, "
    "total from (select *, sum(reads) over (partition by sample) as total from reads) r join taxonomy t on r.feature = t.feature) "
    + " union all ".join(
        f"select sample, '{c}' as level, {c} as taxon, cast(sum(reads) as bigint) as reads, {rsql('sum(reads) / max(total)')} as rel_abund from full_rows group by 1, 3"
        for c in _TAXA
    ),
)
def hierarchy_rollup(spark, d):
    # whole reads are summed and divided once, so the order of a sum of fractions can't matter
    share = F.sum("reads") / F.max("total")
    return roll_up(_with_taxonomy(spark, d), ["sample"], _TAXA, {"reads": F.sum("reads"), "rel_abund": rounded(share)})


@query(
    "hierarchy_richness",
    f"""with {views.TAXONOMY} select count(distinct feature) as n_feature, count(distinct phylum) as n_phylum,
        count(distinct case when family <> 'Unknown' then family end) as n_family from (select feature, phylum, coalesce(family, 'Unknown') as family from taxonomy)""",
)
def hierarchy_richness(spark, d):
    taxa = views.taxonomy(spark, d).withColumn("family", F.coalesce("family", F.lit("Unknown")))
    long = taxa.unpivot([], _TAXA, "level", "taxon").where("taxon <> 'Unknown'").distinct()
    return long.agg(*[F.count_if(F.col("level") == c).alias(f"n_{c}") for c in _TAXA])


@query(
    "transform_pa",
    f"with {views.READS} select sample, feature, cast(reads - 1 > 0 as integer) as present from reads",
)
def transform_pa(spark, d):
    beyond_one = views.reads(spark, d).withColumn("reads", F.col("reads") - 1)
    return composition.presence(beyond_one, "reads").select("sample", "feature", "present")


@query(
    "transform_hellinger",
    f"with {views.READS} select sample, feature, {rsql('sqrt(reads / sum(reads) over (partition by sample))')} as hellinger from reads",
)
def transform_hellinger(spark, d):
    out = composition.hellinger(views.reads(spark, d), "sample", "reads")
    return out.select("sample", "feature", rounded("hellinger").alias("hellinger"))


@query(
    "group_mean_abundance",
    f"""with {views.READS}, {views.META}, sizes as (select site, count(*) as n from meta group by 1)
        select r.feature, m.site, any_value(s.n) as n_samples, {rsql('sum(reads) / any_value(s.n)::double')} as mean,
               {rsql('count(*) / any_value(s.n)::double')} as fidelity
        from reads r join meta m on r.sample = m.sample join sizes s on m.site = s.site group by 1, 2""",
)
def group_mean_abundance(spark, d):
    out = composition.group_means(views.reads(spark, d), views.meta(spark, d), "sample", "feature", "site", "reads")
    return out.withColumns({"mean": rounded("mean"), "fidelity": rounded("fidelity")})


# ---------------------------------------------------------------- alpha diversity

ALPHA_SQL = """select sample, {extra} count(*) as richness,
  count(*) + sum((reads = 1)::int) * (sum((reads = 1)::int) - 1) / (2.0::double * (sum((reads = 2)::int) + 1)) as chao1,
  -sum(p * ln(p)) as shannon, 1 - sum(p * p) as simpson,
  case when count(*) > 1 then -sum(p * ln(p)) / ln(count(*)) end as evenness,
  sum((reads > 10)::int) as s_abund, sum((reads <= 10)::int) as s_rare, sum(case when reads <= 10 then reads else 0 end) as n_rare,
  sum((reads = 1)::int) as f1, sum(case when reads <= 10 then reads * (reads - 1) else 0 end) as rare_pairs
  from (select *, reads / sum(reads) over (partition by {keys}) as p from {source}) group by {keys}"""
_ALPHA = f"{views.READS}, alpha as ({ALPHA_SQL.format(extra='', keys='sample', source='reads')})"


def _alpha(spark, d):
    return diversity.alpha(views.reads(spark, d), ["sample"], "reads")


@query("alpha_richness", f"with {_ALPHA} select sample, richness from alpha")
def alpha_richness(spark, d):
    return _alpha(spark, d).select("sample", "richness")


def _register_alpha(metric: str, expression: str) -> None:
    def run(spark, d):
        return _alpha(spark, d).select("sample", rounded(metric).alias(metric))

    query(f"alpha_{metric}", f"with {_ALPHA} select sample, {rsql(expression)} as {metric} from alpha")(run)


_ACE = """case when s_rare = 0 then s_abund when n_rare = f1 then null else s_abund + s_rare / (1 - f1 / n_rare::double)
  + f1 / (1 - f1 / n_rare::double) * greatest(s_rare / (1 - f1 / n_rare::double) * rare_pairs / (n_rare * (n_rare - 1))::double - 1, 0) end"""
for _metric in ("chao1", "shannon", "simpson", "evenness"):
    _register_alpha(_metric, _metric)
_register_alpha("ace", _ACE)


@query(
    "alpha_diversity",
    f"""with {_ALPHA}, {views.META} select m.sample, m.site, m.species, a.richness, {rsql('a.chao1')} as chao1, {rsql('a.shannon')} as shannon,
        {rsql('a.simpson')} as simpson, {rsql('a.evenness')} as evenness from meta m join alpha a on m.sample = a.sample""",
)
def alpha_diversity(spark, d):
    samples = views.meta(spark, d).select("sample", "site", "species")
    return samples.join(_alpha(spark, d), "sample").select(
        "sample", "site", "species", "richness", *[rounded(m).alias(m) for m in ("chao1", "shannon", "simpson", "evenness")]
    )


# ---------------------------------------------------------------- rarefaction


@query(
    "rarefy_once",
    f"with recursive {views.READS}, {resample.rarefy_sql('reads', _DEPTH_SQL, 1, SEED)} select sample, feature, reads from rare",
)
def rarefy_once(spark, d):
    return rarefied(spark, d, 1).select("sample", "feature", "reads")


@query("rarefy_iter", f"with {RARE_SQL} select iter, sample, feature, reads from rare")
def rarefy_iter(spark, d):
    return rarefied(spark, d)


@query(
    "rarefy_mean",
    f"with {RARE_SQL} select sample, feature, {rsql(f'sum(reads) / {ITERATIONS}.0')} as mean_reads from rare group by 1, 2",
)
def rarefy_mean(spark, d):
    out = resample.replicate_mean(rarefied(spark, d), "sample", "feature", "reads", ITERATIONS)
    return out.withColumn("mean_reads", rounded("mean_reads"))


@query(
    "rarefy_mean_distinct",
    f"""with {RARE_SQL}, v as (select sample, feature, reads, count(*) as times from rare group by 1, 2, 3)
        select sample, feature, {rsql(f'sum(reads) / (count(*) + case when sum(times) < {ITERATIONS} then 1 else 0 end)')} as mean_reads from v group by 1, 2""",
)
def rarefy_mean_distinct(spark, d):
    out = resample.replicate_mean(rarefied(spark, d), "sample", "feature", "reads", ITERATIONS, distinct_values=True)
    return out.withColumn("mean_reads", rounded("mean_reads"))


#: Draws of the digest form, which orders single reads: exact as well, but its work grows with reads x draws.
DIGEST_DRAWS = 3


@query(
    "rarefy_digest",
    f"with {views.READS}, {resample.rarefy_digest_sql('reads', _DEPTH_SQL, DIGEST_DRAWS, SEED)} select iter, sample, feature, reads from rare",
)
def rarefy_digest(spark, d):
    cells = views.reads(spark, d)
    return resample.rarefy(cells, "sample", "feature", "reads", min_depth_of(cells), DIGEST_DRAWS, SEED)


_REPLICATES = " union all ".join(
    f"select sample, '{m}' as metric, cast({m} as double) as value from alphas" for m in diversity.METRICS
)


@query(
    "alpha_replicates",
    f"""with {RARE_SQL}, {views.META}, alphas as ({ALPHA_SQL.format(extra='iter,', keys='sample, iter', source='rare')}),
        cohort as (select 'Site' as comparison, sample from meta where species = 'even' union all select 'Species', sample from meta where site = 'ASIA'),
        long as ({_REPLICATES})
        select comparison, long.sample, metric, {rsql('avg(value)')} as mean_value, {rsql('median(value)')} as median_value,
               {rsql('stddev_samp(value)')} as sd_value, {rsql('min(value)')} as min_value, {rsql('max(value)')} as max_value
        from long join cohort on long.sample = cohort.sample group by 1, 2, 3""",
)
def alpha_replicates(spark, d):
    from quadrat.functions.names import across
    from quadrat.operators.reshape import stack_tagged

    meta = views.meta(spark, d)
    cohort = stack_tagged(
        {"Site": meta.where("species = 'even'").select("sample"), "Species": meta.where("site = 'ASIA'").select("sample")},
        "comparison",
    )
    per_draw = diversity.alpha(rarefied(spark, d), ["iter", "sample"], "reads")
    long = diversity.alpha_long(per_draw, ["iter", "sample"]).join(cohort, "sample")
    out = diversity.replicate_summary(long, ["comparison", "sample", "metric"])
    return across(out, [c for c in out.columns if c.endswith("_value")], rounded)
