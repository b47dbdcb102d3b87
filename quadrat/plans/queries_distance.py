"""Pair tables: community, metric and geographic distances, annotation and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions.special import geodesic, geodesic_sql
from quadrat.operators import joins, pairs, reshape
from quadrat.operators.quantiles import exact_quantiles
from quadrat.plans import views
from quadrat.plans.queries_composition import ALPHA_SQL, RARE_SQL, _alpha, rarefied
from quadrat.plans.registry import query, rounded, rsql
from quadrat.session import written
from quadrat.sources.tables import load


def bray_sql(source: str, name: str = "bray", extra: str = "") -> str:
    """Bray-Curtis of every pair in plain SQL; ``extra`` is a replicate column."""
    keys = f"{extra}, " if extra else ""
    same = f" and a.{extra} = b.{extra}" if extra else ""
    pick = f"a.{extra}, " if extra else ""
    group = "1, 2, 3" if extra else "1, 2"
    return f"""{name}_tot as (select {keys}sample, sum(reads) as t from {source} group by all),
{name}_shared as (select {pick}a.sample as id_a, b.sample as id_b, sum(least(a.reads, b.reads)) as s
  from {source} a join {source} b on a.feature = b.feature and a.sample < b.sample{same} group by {group}),
{name} as (select {pick}a.sample as id_a, b.sample as id_b, 1 - 2 * coalesce(s.s, 0) / (a.t + b.t)::double as distance
  from {name}_tot a join {name}_tot b on a.sample < b.sample{same}
  left join {name}_shared s on s.id_a = a.sample and s.id_b = b.sample{' and s.' + extra + ' = a.' + extra if extra else ''})"""


def jaccard_sql(source: str, name: str = "jac", extra: str = "") -> str:
    """Jaccard of every pair in plain SQL."""
    keys = f"{extra}, " if extra else ""
    same = f" and a.{extra} = b.{extra}" if extra else ""
    pick = f"a.{extra}, " if extra else ""
    group = "1, 2, 3" if extra else "1, 2"
    return f"""{name}_tot as (select {keys}sample, count(*) as t from {source} group by all),
{name}_shared as (select {pick}a.sample as id_a, b.sample as id_b, count(*) as s
  from {source} a join {source} b on a.feature = b.feature and a.sample < b.sample{same} group by {group}),
{name} as (select {pick}a.sample as id_a, b.sample as id_b, 1 - coalesce(s.s, 0) / (a.t + b.t - coalesce(s.s, 0))::double as distance
  from {name}_tot a join {name}_tot b on a.sample < b.sample{same}
  left join {name}_shared s on s.id_a = a.sample and s.id_b = b.sample{' and s.' + extra + ' = a.' + extra if extra else ''})"""


BRAY_SQL = f"{views.READS}, {bray_sql('reads')}"

GEO_SQL = f"""{views.COORDS}, ends as (select a.id as id_a, b.id as id_b, a.lat as lat_a, -a.lon_west as lon_a, b.lat as lat_b, -b.lon_west as lon_b
  from coords a join coords b on a.id < b.id), {geodesic_sql('ends')}"""


def bray_pairs(spark, d):
    """Bray-Curtis of every pair for steps that take what they need from the tiles."""
    return pairs.CommunityPairs(views.reads(spark, d), "sample", "feature", "reads", "bray")


def bray(spark, d):
    return bray_pairs(spark, d).table()


def geo(spark, d):
    west = views.coords(spark, d).withColumn("lon", -F.col("lon_west"))
    return pairs.geographic_distance(west, "id", "lat", "lon")


@query("pairwise_bray", f"with {BRAY_SQL} select id_a, id_b, {rsql('distance')} as distance from bray")
def pairwise_bray(spark, d):
    return bray(spark, d).withColumn("distance", rounded("distance"))


@query("pairwise_jaccard", f"with {views.READS}, {jaccard_sql('reads')} select id_a, id_b, {rsql('distance')} as distance from jac")
def pairwise_jaccard(spark, d):
    out = pairs.community_distance(views.reads(spark, d), "sample", "feature", "reads", "jaccard")
    return out.withColumn("distance", rounded("distance"))


def _averaged(spark, d, kind):
    out = pairs.community_distance(
        rarefied(spark, d), "sample", "feature", "reads", kind, replicate="iter"
    )
    return out.withColumn("distance", rounded("distance"))


@query(
    "pairwise_bray_rarefied",
    f"with {RARE_SQL}, {bray_sql('rare', extra='iter')} select id_a, id_b, {rsql('avg(distance)')} as distance from bray group by 1, 2",
)
def pairwise_bray_rarefied(spark, d):
    return _averaged(spark, d, "bray")


@query(
    "pairwise_jaccard_rarefied",
    f"with {RARE_SQL}, {jaccard_sql('rare', extra='iter')} select id_a, id_b, {rsql('avg(distance)')} as distance from jac group by 1, 2",
)
def pairwise_jaccard_rarefied(spark, d):
    return _averaged(spark, d, "jaccard")


_METRIC_SQL = f"""{views.READS}, alpha as ({ALPHA_SQL.format(extra='', keys='sample', source='reads')}),
metric as (select a.sample as id_a, b.sample as id_b, abs(a.shannon - b.shannon) / nullif(a.shannon + b.shannon, 0) as distance
  from alpha a join alpha b on a.sample < b.sample)"""


@query("pairwise_metric", f"with {_METRIC_SQL} select id_a, id_b, {rsql('distance', 8)} as distance from metric")
def pairwise_metric(spark, d):
    out = pairs.scalar_distance(_alpha(spark, d), "sample", "shannon")
    return out.withColumn("distance", rounded("distance", 8))


@query("pairwise_geo", f"with {GEO_SQL} select id_a, id_b, {rsql('metres', 3)} as metres from geo")
def pairwise_geo(spark, d):
    return geo(spark, d).withColumn("metres", rounded("metres", 3))


@query(
    "pair_annotate",
    f"""with {BRAY_SQL}, {GEO_SQL}, {views.META}
        select b.id_a, b.id_b, {rsql('b.distance')} as distance, {rsql('sqrt(b.distance)')} as root_distance, {rsql('g.metres', 3)} as metres,
               x.site, x.species, y.site as site_compared, y.species as species_compared,
               case when x.species = y.species then 'same-' || x.species else 'different' end as relation
        from bray b join geo g on b.id_a = g.id_a and b.id_b = g.id_b
        left join meta x on b.id_a = x.sample left join meta y on b.id_b = y.sample""",
)
def pair_annotate(spark, d):
    # both ends' coordinates and labels come with the pairs, so pairs meet nothing afterwards
    places = views.coords(spark, d).select(F.col("id").alias("sample"), "lat", (-F.col("lon_west")).alias("lon"))
    labels = views.meta(spark, d).select("sample", "site", "species")
    out = bray_pairs(spark, d).table(about=written(places.join(labels, "sample", "left")), key="sample")
    out = out.withColumn("metres", geodesic("lat_a", "lon_a", "lat_b", "lon_b"))
    return out.select(
        "id_a",
        "id_b",
        rounded("distance").alias("distance"),
        rounded(F.sqrt("distance")).alias("root_distance"),
        rounded("metres", 3).alias("metres"),
        F.col("site_a").alias("site"),
        F.col("species_a").alias("species"),
        F.col("site_b").alias("site_compared"),
        F.col("species_b").alias("species_compared"),
        pairs.relation(F.col("species_a"), F.col("species_b")).alias("relation"),
    )


@query(
    "pair_time_decay",
    f"""with {BRAY_SQL}, {views.META}
        select cast(abs(x.day - y.day) as integer) as days_apart, count(*) as n_pairs, {rsql('median(b.distance)')} as median_distance
        from bray b join meta x on b.id_a = x.sample join meta y on b.id_b = y.sample where x.species = y.species group by 1""",
)
def pair_time_decay(spark, d):
    labels = views.meta(spark, d).select("sample", "species", "day")
    alike = bray_pairs(spark, d).table(about=written(labels), key="sample").where("species_a = species_b")
    lagged = alike.select(F.abs(F.datediff("day_a", "day_b")).alias("days_apart"), "distance")
    # equal distances are counted once, before they are shuffled; the pairs are made a single time
    counted = written(lagged.groupBy("days_apart", "distance").agg(F.count("*").alias("n")))
    sizes = counted.groupBy("days_apart").agg(F.sum("n").alias("n_pairs"))
    medians = exact_quantiles(counted, ["days_apart"], "distance", {"median_distance": 0.5}, weight="n")
    return sizes.join(medians, "days_apart").withColumn("median_distance", rounded("median_distance"))


# ---------------------------------------------------------------- square export and import

NATIONS = list(range(25))
_NATION_SQL = """nat as (select c_nationkey as nation, avg(c_acctbal) as balance from customer group by 1),
np as (select a.nation as id_a, b.nation as id_b, abs(a.balance - b.balance) / nullif(a.balance + b.balance, 0) as distance
  from nat a join nat b on a.nation < b.nation)"""


def _nation_pairs(spark, d):
    nations = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("balance"))
    return pairs.scalar_distance(nations, "nation", "balance")


def _nation_wide(spark, d):
    return reshape.pairs_to_wide(_nation_pairs(spark, d), NATIONS, "distance")


@query(
    "pair_pivot",
    f"with {_NATION_SQL}, s as (select id_a, id_b, distance from np union all select id_b, id_a, distance from np) select id_a, "
    + ", ".join(
        f"case when id_a = {n} then 0 else {rsql(f'max(case when id_b = {n} then distance end)')} end as distance_to_{n}" for n in NATIONS
    )
    + " from s group by 1",
)
def pair_pivot(spark, d):
    wide = _nation_wide(spark, d)
    return wide.select("id_a", *[rounded(c).alias(c) for c in wide.columns if c != "id_a"])


@query(
    "pair_unpivot",
    f"with {_NATION_SQL} select id_a, id_b, {rsql('distance')} as distance from np where id_a in (select n_nationkey from nation where n_regionkey <> 3) and id_b in (select n_nationkey from nation where n_regionkey <> 3)",
)
def pair_unpivot(spark, d):
    near = load(spark, d, "nation").where("n_regionkey <> 3")
    long = reshape.wide_to_pairs(_nation_wide(spark, d), "id_a", "distance")
    both = joins.keep_members(joins.keep_members(long, near, "id_a", "n_nationkey"), near, "id_b", "n_nationkey")
    return both.select("id_a", "id_b", rounded("distance").alias("distance"))
