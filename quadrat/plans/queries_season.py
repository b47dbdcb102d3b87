"""The whole season and the community statistics, run over the visit log and count table of the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions.scalars import recode
from quadrat.plans import community, field_season, views
from quadrat.plans.registry import query

_CODES = {"AUTOMOBILE": "AMRO", "BUILDING": "GRCA", "FURNITURE": "YEWA", "HOUSEHOLD": "RWBL", "MACHINERY": "MODO"}


def _nests(spark, d):
    """The entity dimension with nest codes: the id's first letter follows the site."""
    site = F.col("site")
    letter = F.when(site.startswith("A"), "a").when(site.startswith("E"), "e").otherwise("j")
    return views.dim(spark, d).select(
        F.concat(letter, F.col("entity")).alias("nest_id"),
        F.col("entity").cast("int").alias("master_number"),
        recode(F.col("species"), _CODES).alias("host_species"),
        F.lower("name").alias("tree_species"),
        "entity",
    )


def _log(spark, d):
    log = views.visits(spark, d).join(_nests(spark, d).select("entity", "nest_id"), "entity")
    return log.select(
        "nest_id",
        (F.month("date") * 100 + F.day("date")).alias("date"),
        F.lit("1899-12-31 12:00:00").alias("time"),
        F.lit("Yes").alias("adult"),
        F.when(F.col("eggs") > 0, "Laying").otherwise("Building").alias("stage"),
        F.col("eggs").alias("num_host_egg"),
        F.col("guest").alias("num_bhco_egg"),
        F.lit("n").alias("new_parasitism"),
        F.lit("na").alias("bhco_swab"),
        F.when(F.col("swab"), "Yes").otherwise("n").alias("host_swab"),
        F.when(F.col("predated"), "yes (see notes)").otherwise("no").alias("predated"),
        F.col("hatch").alias("num_host_hatch"),
        F.greatest(F.col("guest") - 1, F.lit(0)).alias("num_bhco_hatch"),
        F.col("note").alias("notes"),
    )


def _season(spark, d):
    return field_season.field_season(_nests(spark, d).drop("entity"), _log(spark, d), 2024)


_SITE = "case when nest_id in ('e6') then 'dwf' when nest_id in ('a1', 'a2', 'j2') then 'pcc' when nest_id in ('j6', 'e5', 'a4') then 'outside study area' when nest_id like 'a%' or nest_id like 'j%' then 'dwf' when nest_id like 'e%' then 'pcc' end"


@query(
    "season_nest_list",
    f"""with {views.DIM}, {views.VISITS}, nests as (
          select entity, (case when site like 'A%' then 'a' when site like 'E%' then 'e' else 'j' end) || entity as nest_id, lower(name) as tree_species,
                 case species when 'AUTOMOBILE' then 'AMRO' when 'BUILDING' then 'GRCA' when 'FURNITURE' then 'YEWA' when 'HOUSEHOLD' then 'RWBL' when 'MACHINERY' then 'MODO' end as host_species
          from dim),
        out as (select n.nest_id from visits v join nests n on v.entity = n.entity
                where regexp_matches(note, '(?i)old nest|(?i)outside search area|(?i)ladder')),
        kept as (select nest_id, host_species, tree_species, {_SITE} as site, 'yes' as target_species from nests
                 where host_species <> 'MODO' and {_SITE} <> 'outside study area' and nest_id not in (select nest_id from out))
        select cast(row_number() over (order by nest_id) as bigint) as master_number, * from kept""",
)
def season_nest_list(spark, d):
    return _season(spark, d)["master_nest_list"]


@query("season_observations")
def season_observations(spark, d):
    return _season(spark, d)["nest_observations"]


@query("season_summary")
def season_summary(spark, d):
    return _season(spark, d)["summary_table"]


@query("season_swabs")
def season_swabs(spark, d):
    return community.swab_history(_season(spark, d)["nest_observations"])["swab_nests"]
