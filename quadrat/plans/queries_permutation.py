"""Permutation tests over the count table and its pair tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions.names import across
from quadrat.operators import composition, mantel, pairs, permutation, reshape
from quadrat.operators.resample import permutation_sql
from quadrat.plans import views
from quadrat.plans.queries_composition import ALPHA_SQL, _alpha, _with_taxonomy
from quadrat.plans.queries_distance import _METRIC_SQL, BRAY_SQL, GEO_SQL, bray, bray_pairs, geo, jaccard_sql
from quadrat.plans.registry import query, rounded, rsql
from quadrat.session import cut_lineage

SEED = 7
N_PERM = 999
GROUPS = ["even", "odd"]

# ---------------------------------------------------------------- indicator values

_IND = f"""{views.READS}, {views.META}, sizes as (select species, count(*) as n from meta group by 1),
means as (select feature, m.species, any_value(s.n) as n, sum(reads) / any_value(s.n)::double as mean, count(*) / any_value(s.n)::double as fidelity
  from reads r join meta m on r.sample = m.sample join sizes s on m.species = s.species group by 1, 2)"""


@query(
    "indval_stat",
    f"""with {_IND} select feature, species, {rsql('mean / sum(mean) over (partition by feature)')} as specificity, {rsql('fidelity')} as fidelity,
        {rsql('sqrt(mean / sum(mean) over (partition by feature) * fidelity)')} as stat from means""",
)
def indval_stat(spark, d):
    out = permutation.indicator_value(views.reads(spark, d), views.meta(spark, d), "sample", "feature", "species", "reads")
    return out.select("feature", "species", *[rounded(c).alias(c) for c in ("specificity", "fidelity", "stat")])


def _indicator_sql(value: str) -> str:
    return f"""{views.READS}, {views.META}, {views.TAXONOMY},
rel as (select r.sample, r.feature, t.phylum, coalesce(t.family, 'Unknown') as family, {value} as p
        from reads r join taxonomy t on r.feature = t.feature),
cells as (select sample, 'feature:' || feature as taxon, sum(p) as v from rel group by 1, 2
  union all select sample, 'phylum:' || phylum, sum(p) from rel group by 1, 2
  union all select sample, 'family:' || family, sum(p) from rel group by 1, 2),
labels as (select sample, species from meta),
{permutation_sql('labels', 'sample', ['species'], N_PERM, SEED)},
sizes as (select species, count(*) as n from labels group by 1),
per as (select p.perm, c.taxon, p.species, sum(c.v) / any_value(s.n) as mean, count(*) as seen, any_value(s.n) as n
        from cells c join perms p on c.sample = p.sample join sizes s on p.species = s.species group by 1, 2, 3),
best as (select perm, taxon, sqrt(max(mean * seen / n) / sum(mean)) as stat, arg_max(species, mean * seen / n) as who,
                sqrt(sum(seen) / (select count(*) from labels)) as stat_all from per group by 1, 2),
tested as (select o.taxon, o.who, o.stat, o.stat_all, (count(case when b.stat >= o.stat - 1e-9 then 1 end) + 1) / (count(*) + 1)::double as p
  from best o join best b on o.taxon = b.taxon and b.perm > 0 where o.perm = 0 group by 1, 2, 3, 4),
result as (select taxon, case when stat_all > stat + 1e-9 then null else who end as indicator_for,
                  case when stat_all > stat + 1e-9 then stat_all else stat end as stat, case when stat_all > stat + 1e-9 then null else p end as p_value from tested)"""


_IND_TEST = _indicator_sql("reads / sum(reads) over (partition by sample)")


def _levels(spark, d, value="rel_abund"):
    """Abundance of every taxon at every level, the level in front of the name."""
    rows = _with_taxonomy(spark, d, views.reads(spark, d))
    cells = reshape.roll_up(rows, ["sample"], ["feature", "phylum", "family"], {"v": F.sum(value)})
    return cells.select("sample", F.concat_ws(":", "level", "taxon").alias("taxon"), "v")


def _indicators(spark, d, all_groups=True, value="rel_abund"):
    return permutation.indicator_test(
        _levels(spark, d, value), views.meta(spark, d), "sample", "taxon", "species", "v", GROUPS, N_PERM, SEED, all_groups
    )


@query(
    "indval_perm",
    f"with {_IND_TEST} select taxon, indicator_for, {rsql('stat')} as stat, {rsql('p_value')} as p_value from result",
)
def indval_perm(spark, d):
    return across(_indicators(spark, d), ["stat", "p_value"], rounded)


@query(
    "indval_counts",
    f"with {_indicator_sql('reads')} select taxon, indicator_for, {rsql('stat')} as stat, {rsql('p_value')} as p_value from result",
)
def indval_counts(spark, d):
    """The same on counts instead of proportions."""
    return across(_indicators(spark, d, value="reads"), ["stat", "p_value"], rounded)


@query(
    "indval_report",
    f"""with {_IND_TEST}, g as (select c.taxon, m.species, sum(v) as s from cells c join labels m on c.sample = m.sample group by 1, 2)
        select split_part(r.taxon, ':', 1) as level, split_part(r.taxon, ':', 2) as taxon, who as indicator_for, {rsql('stat')} as stat, {rsql('p')} as p_value,
               {rsql("max(case when g.species = 'even' then s / (select n from sizes where species = 'even') end)", 5)} as even,
               {rsql("max(case when g.species = 'odd' then s / (select n from sizes where species = 'odd') end)", 5)} as odd
        from tested r join g on r.taxon = g.taxon where p <= 0.05 group by 1, 2, 3, r.stat, r.p""",
)
def indval_report(spark, d):
    cells, meta = _levels(spark, d), views.meta(spark, d)
    means = composition.group_means(cells, meta, "sample", "taxon", "species", "v")
    wide = reshape.to_wide(means, ["taxon"], "species", "mean", GROUPS)
    report = _indicators(spark, d, all_groups=False).where("p_value <= 0.05").join(wide, "taxon")
    parts = F.split("taxon", ":")
    return report.select(
        parts[0].alias("level"),
        parts[1].alias("taxon"),
        "indicator_for",
        rounded("stat").alias("stat"),
        rounded("p_value").alias("p_value"),
        rounded("even", 5).alias("even"),
        rounded("odd", 5).alias("odd"),
    )


# ---------------------------------------------------------------- centroids and dispersion

_PERMANOVA_STEPS = f"""{permutation_sql('labels', 'sample', ['site'], N_PERM, SEED)},
sizes as (select site, count(*) as n from labels group by 1),
shape as (select count(*) as k, cast(sum(n) as bigint) as n from sizes),
total as (select sum(distance * distance) / any_value(shape.n) as ss_total from bray, shape),
within as (select a.perm, sum(b.distance * b.distance / s.n) as ss_within from bray b join perms a on b.id_a = a.sample
  join perms c on b.id_b = c.sample and a.perm = c.perm and a.site = c.site join sizes s on a.site = s.site group by 1),
stats as (select perm, ss_total, ss_within, k - 1 as df1, n - k as df2, 1 - ss_within / ss_total as r2,
                 ((ss_total - ss_within) / (k - 1)) / (ss_within / (n - k)) as f from within, total, shape)"""
_PERMANOVA = f"{BRAY_SQL}, {views.META}, labels as (select sample, site from meta), {_PERMANOVA_STEPS}"


@query(
    "permanova",
    f"""with {_PERMANOVA} select o.df1, o.df2, {rsql('o.ss_total')} as ss_total, {rsql('o.ss_within')} as ss_within, {rsql('o.r2')} as r2, {rsql('o.f')} as f,
        count(*) as permutations, {rsql('(count(case when s.f >= o.f - 1e-9 * greatest(1, abs(o.f)) then 1 end) + 1) / (count(*) + 1)::double')} as p_value
        from stats o join stats s on s.perm > 0 where o.perm = 0 group by o.df1, o.df2, o.ss_total, o.ss_within, o.r2, o.f""",
)
def permanova(spark, d):
    out = permutation.permanova(bray_pairs(spark, d), views.meta(spark, d), "sample", "site", "distance", N_PERM, SEED)
    return across(out, ["ss_total", "ss_within", "r2", "f", "p_value"], rounded)


def _group_test_sql(distance: str, comparison: str, group: str, where: str) -> str:
    """Both tests of one comparison; the pair table is cut to its samples first."""
    return f"""select '{distance}' as distance, '{comparison}' as comparison, o.df1, o.df2, {rsql('o.r2')} as r2, {rsql('o.f')} as f, count(*) as permutations,
  {rsql('(count(case when s.f >= o.f - 1e-9 * greatest(1, abs(o.f)) then 1 end) + 1) / (count(*) + 1)::double')} as p_value,
  any_value(v.df1) as dispersion_df1, any_value(v.df2) as dispersion_df2, {rsql('any_value(v.f)')} as dispersion_f
from (with labels as (select sample, {group} as site from meta where {where}),
  bray as (select id_a, id_b, distance from {distance}_pairs where id_a in (select sample from labels) and id_b in (select sample from labels)),
  {_PERMANOVA_STEPS} select * from stats) o
join (with labels as (select sample, {group} as site from meta where {where}),
  bray as (select id_a, id_b, distance from {distance}_pairs where id_a in (select sample from labels) and id_b in (select sample from labels)),
  {_PERMANOVA_STEPS} select * from stats) s on s.perm > 0
join (with labels as (select sample, {group} as grp from meta where {where}), sizes as (select grp, count(*) as n from labels group by 1),
  ends as (select a.sample, b.distance * b.distance as d2 from {distance}_pairs b join labels a on a.sample in (b.id_a, b.id_b)
    join labels c on c.sample in (b.id_a, b.id_b) and c.sample <> a.sample and c.grp = a.grp),
  per as (select l.sample, l.grp, s.n, coalesce(sum(d2), 0) as r from labels l join sizes s using (grp) left join ends e on e.sample = l.sample group by 1, 2, 3),
  z as (select sample, grp, sqrt(abs(r / n - sum(r) over (partition by grp) / 2 / (n * n))) as z from per),
  g as (select grp, count(*) as n, avg(z) as m, var_pop(z) as v from z group by 1),
  w as (select *, sum(n * m) over () / sum(n) over () as grand from g)
  select count(*) - 1 as df1, cast(sum(n) as bigint) - count(*) as df2,
         (sum(n * (m - grand) * (m - grand)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as f from w) v on true
where o.perm = 0 group by o.df1, o.df2, o.r2, o.f"""


_COMPARED = [("Site", "site", "species = 'even'"), ("Species", "species", "site = 'ASIA'")]


@query(
    "group_tests",
    f"with {BRAY_SQL}, {jaccard_sql('reads')}, {views.META}, bray_pairs as (select * from bray), jaccard_pairs as (select * from jac) "
    + " union all ".join(f"select * from ({_group_test_sql(t, *c)})" for t in ("bray", "jaccard") for c in _COMPARED),
)
def group_tests(spark, d):
    """Dispersion and PERMANOVA of two dissimilarities, between the sites of one species and the species of one site."""
    reads, meta = views.reads(spark, d), views.meta(spark, d)
    tables = {k: pairs.CommunityPairs(reads, "sample", "feature", "reads", k) for k in ("bray", "jaccard")}
    comparisons = {name: (meta.where(where), group) for name, group, where in _COMPARED}
    out = permutation.group_tests(tables, comparisons, "sample", "distance", N_PERM, SEED).drop("dispersion_p_value")
    return across(out, ["r2", "f", "p_value", "dispersion_f"], rounded)


# ---------------------------------------------------------------- Mantel

MANTEL_PERM = 999


def _mantel_sql(x: str, x_value: str, y: str, y_value: str, count: int, statistic: str) -> str:
    return f"""ids as (select s_suppkey as sample, s_suppkey as target from supplier),
{permutation_sql('ids', 'sample', ['target'], count, SEED)},
moved as (select a.perm, least(a.target, b.target) as id_a, greatest(a.target, b.target) as id_b, x.{x_value} as x
  from {x} x join perms a on x.id_a = a.sample join perms b on x.id_b = b.sample and a.perm = b.perm),
both_sides as (select m.perm, m.x, y.{y_value} as y from moved m join {y} y on m.id_a = y.id_a and m.id_b = y.id_b),
{statistic}
select {rsql('o.s')} as statistic, count(*) as permutations,
       {rsql('(count(case when p.s >= o.s - 1e-9 then 1 end) + 1) / (count(*) + 1)::double')} as p_value
from stats o join stats p on p.perm > 0 where o.perm = 0 group by o.s"""


def _members(spark, d):
    return views.meta(spark, d).select("sample")


def _mantel(x, y, members, x_value, y_value, method, count):
    out = mantel.mantel(x, y, members, "sample", x_value, y_value, method, count, SEED)
    return out.select(rounded("statistic").alias("statistic"), "permutations", rounded("p_value").alias("p_value"))


@query(
    "mantel_pearson",
    f"with {BRAY_SQL}, {GEO_SQL}, "
    + _mantel_sql("bray", "distance", "geo", "metres", MANTEL_PERM, "stats as (select perm, corr(x, y) as s from both_sides group by 1)"),
)
def mantel_pearson(spark, d):
    return _mantel(bray_pairs(spark, d), geo(spark, d), _members(spark, d), "distance", "metres", "pearson", MANTEL_PERM)


_RANKED = """ranked as (select perm, rank() over (partition by perm order by x) + (count(*) over (partition by perm, x) - 1) / 2.0::double as x,
  rank() over (partition by perm order by y) + (count(*) over (partition by perm, y) - 1) / 2.0::double as y from both_sides),
stats as (select perm, corr(x, y) as s from ranked group by 1)"""


@query(
    "mantel_spearman",
    f"with {BRAY_SQL}, {GEO_SQL.replace('metres from gab', 'metres0 from gab')}, geo1 as (select id_a, id_b, round(metres0) as metres from geo), bray1 as (select id_a, id_b, round(distance, 9) as distance from bray), "
    + _mantel_sql("bray1", "distance", "geo1", "metres", MANTEL_PERM, _RANKED),
)
def mantel_spearman(spark, d):
    x = bray(spark, d).withColumn("distance", F.round("distance", 9))
    y = geo(spark, d).withColumn("metres", F.round("metres"))
    return _mantel(x, y, _members(spark, d), "distance", "metres", "spearman", MANTEL_PERM)



def _kendall_sql(keys: str) -> str:
    """tau-b by splitting y digit by digit: a pair is discordant where, in x order, a one stands before a zero."""
    return f"""ranked as (select {keys}, dense_rank() over (partition by {keys} order by x) as xr, dense_rank() over (partition by {keys} order by y) - 1 as yr from both_sides),
digits as (select unnest(range(0, (select cast(ceil(log2(max(yr) + 1)) as bigint) + 1 from ranked))) as d),
falling as (select {keys}, sum(case when one = 0 then ones else 0 end) as dis from
  (select {keys}, (yr >> d) & 1 as one, sum((yr >> d) & 1) over (partition by {keys}, d, yr >> (d + 1) order by xr, yr rows unbounded preceding) as ones from ranked, digits) group by all),
x_ties as (select {keys}, sum(c * (c - 1) / 2) as tx from (select {keys}, xr, count(*) as c from ranked group by all) group by all),
y_ties as (select {keys}, sum(c * (c - 1) / 2) as ty, sum(c) as n from (select {keys}, yr, count(*) as c from ranked group by all) group by all),
both_ties as (select {keys}, sum(c * (c - 1) / 2) as txy from (select {keys}, xr, yr, count(*) as c from ranked group by all) group by all),
stats as (select {keys}, (n * (n - 1) / 2 - tx - ty + txy - 2 * dis) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) as s
  from falling join x_ties using ({keys}) join y_ties using ({keys}) join both_ties using ({keys}))"""

@query(
    "mantel_kendall",
    f"with {_METRIC_SQL}, {GEO_SQL.replace('metres from gab', 'metres0 from gab')}, geo1 as (select id_a, id_b, round(metres0) as metres from geo), metric1 as (select id_a, id_b, round(distance, 9) as distance from metric), "
    + _mantel_sql("metric1", "distance", "geo1", "metres", MANTEL_PERM, _kendall_sql("perm")),
)
def mantel_kendall(spark, d):
    x = pairs.scalar_distance(_alpha(spark, d), "sample", "shannon").withColumn("distance", F.round("distance", 9))
    y = geo(spark, d).withColumn("metres", F.round("metres"))
    return _mantel(x, y, _members(spark, d), "distance", "metres", "kendall", MANTEL_PERM)


METRICS = ["richness", "chao1", "shannon", "simpson", "evenness"]
_METRICS_SQL = f"""{views.READS}, alpha as ({ALPHA_SQL.format(extra='', keys='sample', source='reads')}), {views.META},
chosen as (select 'site' as comparison, sample from meta where species = 'even' union all select 'species', sample from meta where site = 'ASIA'),
long as (unpivot (select sample, {', '.join(f'cast({m} as double) as {m}' for m in METRICS)} from alpha) on {', '.join(METRICS)} into name distance value v)"""


@query(
    "mantel_table",
    f"""with {_METRICS_SQL}, {GEO_SQL.replace('metres from gab', 'metres0 from gab')},
geo1 as (select id_a, id_b, round(metres0) as metres from geo),
between as (select c.comparison, a.distance, a.sample as id_a, b.sample as id_b, round(abs(a.v - b.v) / nullif(a.v + b.v, 0), 9) as x
  from long a join long b on a.distance = b.distance and a.sample < b.sample
  join chosen c on c.sample = a.sample join chosen e on e.sample = b.sample and e.comparison = c.comparison),
site_ids as (select sample, sample as target from chosen where comparison = 'site'),
species_ids as (select sample, sample as target from chosen where comparison = 'species'),
{permutation_sql('site_ids', 'sample', ['target'], MANTEL_PERM, SEED, 'sp')},
{permutation_sql('species_ids', 'sample', ['target'], MANTEL_PERM, SEED, 'pp')},
perms as (select 'site' as comparison, * from sp union all select 'species', * from pp),
moved as (select x.comparison, x.distance, a.perm, least(a.target, b.target) as id_a, greatest(a.target, b.target) as id_b, x.x
  from between x join perms a on x.id_a = a.sample and a.comparison = x.comparison
  join perms b on x.id_b = b.sample and b.comparison = x.comparison and a.perm = b.perm where x.x is not null),
both_sides as (select m.comparison, m.distance, m.perm, m.x, y.metres as y from moved m join geo1 y on m.id_a = y.id_a and m.id_b = y.id_b),
{_kendall_sql('comparison, distance, perm')}
select o.comparison, o.distance, {rsql('o.s')} as statistic, count(*) as permutations,
       {rsql('(count(case when p.s >= o.s - 1e-9 then 1 end) + 1) / (count(*) + 1)::double')} as p_value
from stats o join stats p on p.comparison = o.comparison and p.distance = o.distance and p.perm > 0 where o.perm = 0 group by o.comparison, o.distance, o.s""",
)
def mantel_table(spark, d):
    """Five alpha metrics against geography, between the sites of one species and between the species of one site."""
    alpha, meta = cut_lineage(_alpha(spark, d)), views.meta(spark, d)
    y = geo(spark, d).withColumn("metres", F.round("metres"))
    tables = {m: (pairs.scalar_distance(alpha, "sample", m).withColumn("distance", F.round("distance", 9)), "distance") for m in METRICS}
    comparisons = {"site": meta.where("species = 'even'").select("sample"), "species": meta.where("site = 'ASIA'").select("sample")}
    out = mantel.mantel_table(tables, y, "metres", comparisons, "sample", "kendall", MANTEL_PERM, SEED)
    return across(out, ["statistic", "p_value"], rounded)


# ---------------------------------------------------------------- redundancy analysis

RDA_PERM = 999
TERMS = ["grp", "covariate", "interaction"]

# Gram-Schmidt in SQL: each regressor centred and made orthogonal to those before it
def _rda_sql(reads: str) -> str:
    return f"""{views.READS}, {views.META},
x0 as (select sample, case when species = 'even' then 1.0::double else 0 end as grp, covariate / 1000 as covariate,
              case when species = 'even' then covariate / 1000 else 0 end as interaction from meta where covariate is not null),
x1 as (select sample, grp - avg(grp) over () as grp, covariate - avg(covariate) over () as covariate, interaction - avg(interaction) over () as interaction from x0),
x2 as (select sample, grp, covariate - sum(covariate * grp) over () / sum(grp * grp) over () * grp as covariate, interaction from x1),
x3 as (select sample, grp, covariate, interaction - sum(interaction * grp) over () / sum(grp * grp) over () * grp
              - sum(interaction * covariate) over () / sum(covariate * covariate) over () * covariate as interaction from x2),
hel as (select r.sample, feature, sqrt({reads} / sum({reads}) over (partition by r.sample)) as v from reads r where sample in (select sample from x0)),
n as (select count(*) as n from x0),
tot as (select sum(yy - y * y / n) as ss_total from (select feature, sum(v * v) as yy, sum(v) as y from hel group by 1), n),
norms as (select sum(grp * grp) as grp, sum(covariate * covariate) as covariate, sum(interaction * interaction) as interaction from x3)"""


_RDA = _rda_sql("reads")
_RDA_STATS = """prod as (select p.perm, h.feature, sum(p.grp * v) as grp, sum(p.covariate * v) as covariate, sum(p.interaction * v) as interaction
  from hel h join perms p on h.sample = p.sample group by 1, 2),
ss as (select perm, sum(p.grp * p.grp) / any_value(n.grp) as grp, sum(p.covariate * p.covariate) / any_value(n.covariate) as covariate,
              sum(p.interaction * p.interaction) / any_value(n.interaction) as interaction from prod p, norms n group by 1),
long as (select perm, 'grp' as term, grp as ss, 1 as df, grp + covariate + interaction as fit from ss
  union all select perm, 'covariate', covariate, 1, grp + covariate + interaction from ss
  union all select perm, 'interaction', interaction, 1, grp + covariate + interaction from ss
  union all select perm, 'model', grp + covariate + interaction, 3, grp + covariate + interaction from ss),
stats as (select perm, term, df, n - 4 as df_residual, ss / (n - 1) as variance, ss_total / (n - 1) as total_variance, ss / ss_total as r2,
                 case when term = 'model' then 1 - (1 - ss / ss_total) * (n - 1) / (n - 4) end as r2_adjusted,
                 (ss / df) / ((ss_total - fit) / (n - 4)) as f from long, tot, n)"""
_RDA_COLUMNS = "df, df_residual, " + ", ".join(f"{rsql(c, 7)} as {c}" for c in ("variance", "total_variance", "r2", "r2_adjusted", "f"))


def _regressors(spark, d):
    """Complete samples with a group dummy, a covariate and their product."""
    even = (F.col("species") == "even").cast("double")
    meta = views.meta(spark, d).where("covariate is not null")
    return meta.select(
        "sample",
        even.alias("grp"),
        (F.col("covariate") / 1000).alias("covariate"),
        (even * F.col("covariate") / 1000).alias("interaction"),
    )


def _redundancy(spark, d, count, presence=False):
    reads = composition.presence(views.reads(spark, d), "reads", "reads") if presence else views.reads(spark, d)
    response = composition.hellinger(reads, "sample", "reads")
    out = permutation.redundancy(response, _regressors(spark, d), "sample", "feature", "hellinger", TERMS, count, SEED)
    return across(out, ["variance", "total_variance", "r2", "r2_adjusted", "f"], lambda c: rounded(c, 7))


@query(
    "rda_variance",
    f"with {_RDA}, perms as (select 0 as perm, * from x3), {_RDA_STATS} select term, {_RDA_COLUMNS} from stats",
)
def rda_variance(spark, d):
    return _redundancy(spark, d, 0)


def _rda_test_sql(reads: str) -> str:
    return f"""with {_rda_sql(reads)}, {permutation_sql('x3', 'sample', TERMS, RDA_PERM, SEED)}, {_RDA_STATS},
        p as (select o.term, {rsql('(count(case when s.f >= o.f - 1e-9 * greatest(1, abs(o.f)) then 1 end) + 1) / (count(*) + 1)::double')} as p_value
              from stats o join stats s on o.term = s.term and s.perm > 0 where o.perm = 0 group by 1)
        select stats.term, {_RDA_COLUMNS}, p_value from stats join p on stats.term = p.term where perm = 0"""


@query("rda_perm", _rda_test_sql("reads"))
def rda_perm(spark, d):
    return _redundancy(spark, d, RDA_PERM).withColumn("p_value", rounded("p_value"))


@query("rda_presence", _rda_test_sql("1.0::double"))
def rda_presence(spark, d):
    """The same test on presence instead of counts."""
    return _redundancy(spark, d, RDA_PERM, presence=True).withColumn("p_value", rounded("p_value"))


@query("rda_axis_test")
def rda_axis_test(spark, d):
    """F and p of each axis, the axes before it as conditions."""
    response = composition.hellinger(views.reads(spark, d), "sample", "reads")
    return permutation.axis_tests(response, _regressors(spark, d), "sample", "feature", "hellinger", TERMS, RDA_PERM, SEED)


@query(
    "rda_coefficients",
    f"""with {_RDA} select feature, {', '.join(f"{rsql(f'sum(x3.{t} * v) / any_value(norms.{t})', 7)} as {t}" for t in TERMS)}
        from hel join x3 on hel.sample = x3.sample, norms group by 1""",
)
def rda_coefficients(spark, d):
    response = composition.hellinger(views.reads(spark, d), "sample", "reads")
    out = permutation.coefficients(response, _regressors(spark, d), "sample", "feature", "hellinger", TERMS)
    return across(out, TERMS, lambda c: rounded(c, 7))
