"""Parametric tests; the fact table gives many rows per group, the count table realistic metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions.names import across
from quadrat.operators import diversity, inference
from quadrat.operators.reshape import to_long
from quadrat.plans import views
from quadrat.plans.queries_composition import _alpha
from quadrat.plans.queries_distance import BRAY_SQL, bray_pairs
from quadrat.plans.registry import query, rounded, rsql
from quadrat.sources.tables import load

_LONG_SQL = """long as (select l_linestatus as grp, l_quantity as x, metric, y from
  (unpivot (select l_linestatus, l_quantity, l_extendedprice / 1000 as price, l_discount * 100 as discount, l_tax * 100 as tax from lineitem)
   on price, discount, tax into name metric value y))"""


def _long(spark, d):
    """Three measures per line with a two-level group and a covariate."""
    lines = load(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("grp"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        (F.col("l_discount") * 100).alias("discount"),
        (F.col("l_tax") * 100).alias("tax"),
    )
    return to_long(lines, ["grp", "x"], ["price", "discount", "tax"], "metric", "y")


LEVELS = ("O", "F")

_TWO = """two as (select metric, count(case when grp = 'O' then y end) as n1, count(case when grp = 'F' then y end) as n2,
  avg(case when grp = 'O' then y end) as mean1, avg(case when grp = 'F' then y end) as mean2,
  var_samp(case when grp = 'O' then y end) as var1, var_samp(case when grp = 'F' then y end) as var2 from long group by 1)"""


@query(
    "var_ratio",
    f"with {_LONG_SQL}, {_TWO} select metric, {rsql('var1 / var2')} as f, n1 - 1 as df1, n2 - 1 as df2 from two",
)
def var_ratio(spark, d):
    out = inference.variance_ratio(_long(spark, d), ["metric"], "grp", "y", LEVELS)
    return out.select("metric", rounded("f").alias("f"), "df1", "df2")


@query(
    "t_test_pooled",
    f"""with {_LONG_SQL}, {_TWO} select metric, {rsql('mean1')} as mean1, {rsql('mean2')} as mean2, n1 + n2 - 2 as df,
        {rsql('(mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1.0::double / n1 + 1.0::double / n2))')} as t from two""",
)
def t_test_pooled(spark, d):
    out = inference.t_pooled(_long(spark, d), ["metric"], "grp", "y", LEVELS)
    return across(out.drop("p_value"), ["mean1", "mean2", "t"], rounded)


_F_SQL = """select {keys} count(*) - 1 as df1, cast(sum(n) as bigint) - count(*) as df2, sum(n * pow(m - grand, 2)) as ss_between, sum(n * v) as ss_within
  from (select *, sum(n * m) over ({over}) / sum(n) over ({over}) as grand from {groups}) {group_by}"""


@query(
    "levene",
    f"""with {_LONG_SQL}, med as (select metric, grp, median(y) as md from long group by 1, 2),
        g as (select l.metric, l.grp, count(*) as n, avg(abs(y - md)) as m, var_pop(abs(y - md)) as v from long l join med
              on l.metric = med.metric and l.grp = med.grp group by 1, 2),
        s as ({_F_SQL.format(keys='metric,', over='partition by metric', groups='g', group_by='group by metric')})
        select metric, df1, df2, {rsql('ss_between', 4)} as ss_between, {rsql('ss_within', 2)} as ss_within,
               {rsql('(ss_between / df1) / (ss_within / df2)')} as f from s""",
)
def levene(spark, d):
    out = inference.levene(_long(spark, d), ["metric"], "grp", "y").drop("p_value")
    return out.withColumns(
        {"ss_between": rounded("ss_between", 4), "ss_within": rounded("ss_within", 2), "f": rounded("f")}
    )


_MOMENTS = """mom as (select metric, grp, count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) * count(*) as sxx,
  var_pop(y) * count(*) as syy, covar_pop(y, x) * count(*) as sxy from long group by 1, 2)"""
_LM = f"""{_LONG_SQL}, {_MOMENTS},
fit as (select metric, sum(sxx) as wxx, sum(sxy) / sum(sxx) as slope, sum(syy) - sum(sxy) * sum(sxy) / sum(sxx) as rss,
        sum(n) - count(*) - 1 as df from mom group by 1),
lm as (select l.metric, l.grp, l.x, l.y, my + slope * (x - mx) as fitted, y - (my + slope * (x - mx)) as resid,
         (y - (my + slope * (x - mx))) / sqrt(rss / df * (1 - 1.0::double / n - (x - mx) * (x - mx) / wxx)) as std_resid
       from long l join mom on l.metric = mom.metric and l.grp = mom.grp join fit on l.metric = fit.metric)"""


@query(
    "lm_residuals",
    f"with {_LM} select metric, grp, x, {rsql('fitted', 4)} as fitted, {rsql('resid', 4)} as resid, {rsql('std_resid', 5)} as std_resid from lm",
)
def lm_residuals(spark, d):
    model = inference.linear_model(_long(spark, d), ["metric"], "grp", "x", "y")
    return model.select(
        "metric",
        "grp",
        "x",
        rounded("fitted", 4).alias("fitted"),
        rounded("resid", 4).alias("resid"),
        rounded("std_resid", 5).alias("std_resid"),
    )


@query(
    "outliers_std_resid",
    f"with {_LM} select metric, grp, x, {rsql('std_resid', 5)} as std_resid from lm where abs(std_resid) > 1.72",
)
def outliers_std_resid(spark, d):
    model = inference.linear_model(_long(spark, d), ["metric"], "grp", "x", "y")
    return inference.outliers(model, 1.72).select("metric", "grp", "x", rounded("std_resid", 5).alias("std_resid"))


@query(
    "ancova",
    f"""with {_LONG_SQL}, {_MOMENTS},
        c as (select *, sum(n * mx) over (partition by metric) / sum(n) over (partition by metric) as gx,
                     sum(n * my) over (partition by metric) / sum(n) over (partition by metric) as gy from mom),
        s as (select metric, cast(sum(n) as bigint) as n, count(*) as k, sum(sxx) as wxx, sum(sxy) as wxy, sum(syy) as wyy,
                     sum(syy - sxy * sxy / sxx) as sep, sum(sxx + n * (mx - gx) * (mx - gx)) as txx,
                     sum(sxy + n * (mx - gx) * (my - gy)) as txy, sum(syy + n * (my - gy) * (my - gy)) as tyy from c group by 1),
        r as (select *, wyy - wxy * wxy / wxx as par, tyy - txy * txy / txx as com from s),
        e as (select metric, n - 2 * k as dfd, sep, 'group' as effect, com - par as ss, k - 1 as dfn from r
              union all select metric, n - 2 * k, sep, 'covariate', wyy - par, 1 from r
              union all select metric, n - 2 * k, sep, 'group:covariate', par - sep, k - 1 from r)
        select metric, effect, dfn, dfd, {rsql('ss', 3)} as ss, {rsql('sep', 1)} as ss_error, {rsql('(ss / dfn) / (sep / dfd)', 5)} as f,
               {rsql('ss / (ss + sep)', 8)} as ges from e""",
)
def ancova(spark, d):
    out = inference.ancova(_long(spark, d), ["metric"], "grp", "x", "y").drop("p_value")
    return out.withColumns(
        {"ss": rounded("ss", 3), "ss_error": rounded("ss_error", 1), "f": rounded("f", 5), "ges": rounded("ges", 8)}
    )


@query(
    "trend_by_group",
    f"""with {_LONG_SQL} select metric, grp, {rsql('regr_slope(y, x)', 8)} as slope, {rsql('regr_intercept(y, x)')} as intercept,
        {rsql('corr(y, x)', 8)} as r, {rsql('regr_r2(y, x)', 8)} as r2, count(*) as n from long group by 1, 2""",
)
def trend_by_group(spark, d):
    out = inference.trend(_long(spark, d), ["metric", "grp"], "x", "y")
    return out.withColumns(
        {"slope": rounded("slope", 8), "intercept": rounded("intercept"), "r": rounded("r", 8), "r2": rounded("r2", 8)}
    )


def _metrics(spark, d):
    """Alpha metrics per sample with the sample's group and covariate."""
    long = diversity.alpha_long(_alpha(spark, d), ["sample"])
    return long.join(views.meta(spark, d), "sample")


@query("shapiro_w")
def shapiro_w(spark, d):
    return inference.shapiro_wilk(_metrics(spark, d), ["metric", "species"], "value")


@query("shapiro_residuals")
def shapiro_residuals(spark, d):
    model = inference.linear_model(_metrics(spark, d), ["metric"], "species", "covariate", "value")
    return inference.shapiro_wilk(model, ["metric"], "std_resid")


@query("test_p_values")
def test_p_values(spark, d):
    """Tail probabilities of all parametric tests on the alpha metrics."""
    metrics = _metrics(spark, d)
    by, levels = ["metric"], ("even", "odd")
    tables = {
        "variance": inference.variance_ratio(metrics, by, "species", "value", levels),
        "t": inference.t_pooled(metrics, by, "species", "value", levels),
        "levene": inference.levene(metrics, by, "species", "value"),
        "trend": inference.trend_p(inference.trend(metrics, by, "covariate", "value")),
        "ancova": inference.ancova(metrics, by, "species", "covariate", "value").withColumn(
            "metric", F.concat_ws(" ", "metric", "effect")
        ),
    }
    from quadrat.operators.reshape import stack_tagged

    return stack_tagged({k: t.select("metric", "p_value") for k, t in tables.items()}, "test")


_DISPERSION = f"""{BRAY_SQL}, {views.META}, sizes as (select species, count(*) as n from meta group by 1),
ends as (select b.id_a as sample, x.species, b.distance * b.distance as d2 from bray b join meta x on b.id_a = x.sample join meta y on b.id_b = y.sample and x.species = y.species
  union all select b.id_b, x.species, b.distance * b.distance from bray b join meta x on b.id_a = x.sample join meta y on b.id_b = y.sample and x.species = y.species),
row_sums as (select m.sample, m.species, coalesce(sum(d2), 0) as s from meta m left join ends e on m.sample = e.sample group by 1, 2),
z as (select r.sample, r.species, sqrt(abs(s / n - sum(s) over (partition by r.species) / 2 / (n * n))) as z from row_sums r join sizes on r.species = sizes.species)"""


def _dispersion(spark, d):
    return inference.centroid_distances(bray_pairs(spark, d), views.meta(spark, d), "sample", "species", "distance")


@query("centroid_distance", f"with {_DISPERSION} select sample, species, {rsql('z')} as z from z")
def centroid_distance(spark, d):
    return _dispersion(spark, d).withColumn("z", rounded("z"))


@query(
    "dispersion",
    f"""with {_DISPERSION}, g as (select species as grp, count(*) as n, avg(z) as m, var_pop(z) as v from z group by 1),
        s as ({_F_SQL.format(keys='', over='', groups='g', group_by='')}),
        t as (select max(case when grp = 'even' then m end) - max(case when grp = 'odd' then m end) as diff,
                     sqrt(sum(n * v) / (sum(n) - 2) * sum(1.0::double / n)) as se from g)
        select df1, df2, {rsql('ss_between', 8)} as ss_between, {rsql('ss_within', 8)} as ss_within,
               {rsql('(ss_between / df1) / (ss_within / df2)')} as f, {rsql('diff', 8)} as diff, {rsql('diff / se')} as t from s, t""",
)
def dispersion(spark, d):
    z = _dispersion(spark, d).withColumn("of", F.lit("bray"))
    f = inference.one_way(z, ["of"], "species", "z").drop("p_value")
    # with two groups Tukey's honest difference is the pooled t test
    t = inference.t_pooled(z, ["of"], "species", "z", ("even", "odd"))
    both = f.join(t.select("of", (F.col("mean1") - F.col("mean2")).alias("diff"), "t"), "of").drop("of")
    return both.withColumns(
        {c: rounded(c, 8) for c in ("ss_between", "ss_within", "diff")} | {c: rounded(c) for c in ("f", "t")}
    )
