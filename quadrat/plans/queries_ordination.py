"""Ordination and clustering over the count table and the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions.names import across
from quadrat.operators import ordination
from quadrat.plans import views
from quadrat.plans.queries_distance import BRAY_SQL, bray_pairs
from quadrat.plans.queries_permutation import TERMS, _regressors
from quadrat.plans.registry import query, rounded, rsql
from quadrat.sources.tables import load

_GOWER = f"""{BRAY_SQL}, ids as (select s_suppkey as sample from supplier), n as (select count(*) as n from ids),
ends as (select id_a as sample, distance from bray union all select id_b, distance from bray),
means as (select ids.sample, coalesce(sum(distance), 0) / any_value(n.n) as m from ids join n on true left join ends on ids.sample = ends.sample group by 1),
grand as (select avg(m) as g from means)"""


def _root(spark, d):
    return bray_pairs(spark, d).root()


def _members(spark, d):
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"))


@query(
    "gower_center",
    f"""with {_GOWER} select id_a, id_b, {rsql('-0.5 * (distance - a.m - b.m + g)', 8)} as g from bray join means a on id_a = a.sample
        join means b on id_b = b.sample, grand
        union all select sample, sample, {rsql('-0.5 * (g - 2 * m)', 8)} from means, grand""",
)
def gower_center(spark, d):
    out = ordination.gower_center(_root(spark, d), _members(spark, d), "sample", "root")
    return out.withColumn("g", rounded("g", 8))


def _scores(spark, d):
    scores, _, _ = ordination.pcoa(_root(spark, d), _members(spark, d), "sample", "root", axes=2)
    return scores


@query("pcoa")
def pcoa(spark, d):
    return _scores(spark, d)


@query("kmeans")
def kmeans(spark, d):
    return ordination.kmeans(_scores(spark, d), ["axis1", "axis2"], k=2)


@query("group_hull_scores")
def group_hull_scores(spark, d):
    scores = _scores(spark, d).join(views.meta(spark, d).select("sample", "site"), "sample")
    return ordination.group_hull(scores, "site", "sample", "axis1", "axis2")


# ---------------------------------------------------------------- clustering with fixed centres

_CENTERS = """centers as (select label, array_agg(c order by i) as v from (
  select label, i, avg(x) as c from (select label, unnest(range(1, 65)) as i, unnest(embedding)::double as x from embeddings) group by 1, 2) group by 1),
ranked as (select e.vec_id, e.label as own, c.label, list_sum(list_transform(list_zip(e.embedding::double[], c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d2
  from embeddings e, centers c),
near as (select vec_id, any_value(own) as own, arg_min(label, d2) as label, sqrt(min(d2)) as distance from ranked group by 1)"""


def _vectors(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _assigned(spark, d):
    """Every vector with the nearest of the label means; the number of labels is small and fixed."""
    vectors = _vectors(spark, d)
    means = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centers = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    centers = centers.select("label", F.col("s.x").alias("v"))
    return ordination.nearest_center(vectors.select("vec_id", "v"), "vec_id", "v", centers, "label")


@query("kmeans_assign", f"with {_CENTERS} select vec_id, label, {rsql('distance')} as distance from near")
def kmeans_assign(spark, d):
    return _assigned(spark, d).withColumn("distance", rounded("distance"))


@query("cluster_crosstab", f"with {_CENTERS} select own, label as cluster, count(*) as n from near group by 1, 2")
def cluster_crosstab(spark, d):
    own = _vectors(spark, d).select("vec_id", F.col("label").alias("own"))
    near = _assigned(spark, d).select("vec_id", F.col("label").alias("cluster"))
    return own.join(near, "vec_id").groupBy("own", "cluster").agg(F.count("*").alias("n"))


@query(
    "group_centroid",
    f"""select label, {', '.join(rsql(f'avg(embedding[{i}]::double)') + f' as axis{i}' for i in (1, 2, 3))} from embeddings group by 1""",
)
def group_centroid(spark, d):
    axes = ["axis1", "axis2", "axis3"]
    scores = _vectors(spark, d).select("label", *[F.col("v")[i].alias(a) for i, a in enumerate(axes)])
    return across(ordination.group_centroid(scores, "label", axes), axes, rounded)


@query("group_hull")
def group_hull(spark, d):
    lines = load(spark, d, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_extendedprice", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net")
    )
    return ordination.group_hull(lines, "l_returnflag", "l_orderkey", "l_extendedprice", "net")


# ---------------------------------------------------------------- axes of the constrained ordination


@query("rda_axes")
def rda_axes(spark, d):
    from quadrat.operators import composition, permutation

    response = composition.hellinger(views.reads(spark, d), "sample", "reads")
    return permutation.constrained_axes(response, _regressors(spark, d), "sample", "feature", "hellinger", TERMS)
