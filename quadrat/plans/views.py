"""Domain views over the test tables: as DataFrames, and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.sources.tables import load


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Counts per sample and feature: supplier by brand and type of the parts it shipped.

    Lines are counted per supplier and part before the join, so a part or
    supplier with very many lines meets the part table as few rows.
    """
    lines = load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    part = load(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("feature"))
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy(F.col("l_suppkey").alias("sample"), "feature")
        .agg(F.sum("n").alias("reads"))
    )


READS = """reads as (
  select l_suppkey as sample, p_brand || ' ' || p_type as feature, count(*) as reads
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


def meta(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample: where it was taken, which of two groups it is in, a covariate and a date."""
    supplier, nation, region = (load(spark, d, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_suppkey").alias("sample"),
            F.col("r_name").alias("site"),
            F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("species"),
            F.col("s_acctbal").alias("covariate"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") * 7 % 90).cast("int")).alias("day"),
        )
    )


META = """meta as (
  select s_suppkey as sample, r_name as site, case when n_nationkey % 2 = 0 then 'even' else 'odd' end as species,
         s_acctbal as covariate, date '2024-01-01' + cast(s_suppkey * 7 % 90 as integer) as day
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Feature with its two upper levels; brand 13 stands for features without a known order."""
    return (
        load(spark, d, "part")
        .select("p_brand", "p_type")
        .distinct()
        .select(
            F.concat_ws(" ", "p_brand", "p_type").alias("feature"),
            F.col("p_type").alias("phylum"),
            F.when(F.col("p_brand") != "Brand#13", F.concat_ws("/", "p_type", F.substring("p_brand", 1, 7))).alias(
                "family"
            ),
        )
    )


TAXONOMY = """taxonomy as (
  select distinct p_brand || ' ' || p_type as feature, p_type as phylum,
         case when p_brand <> 'Brand#13' then p_type || '/' || substr(p_brand, 1, 7) end as family
  from part)"""


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Visit log: one row per entity and day with counts, flags and a note."""
    events = load(spark, d, "events").select(
        F.col("user_id").alias("entity"), F.to_date("ts").alias("date"), "event_type", "value"
    )
    kind = F.col("event_type")
    return events.groupBy("entity", "date").agg(
        F.count_if(kind == "view").alias("eggs"),
        F.count_if(kind == "purchase").alias("hatch"),
        F.count_if(kind == "signup").alias("guest"),
        F.max(kind == "click").alias("swab"),
        F.max((kind == "error") & (F.col("value") > 100)).alias("predated"),
        F.concat_ws(" ", F.sort_array(F.collect_set("event_type"))).alias("note"),
    )


VISITS = """visits as (
  select user_id as entity, cast(ts as date) as date,
         cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as eggs,
         cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as hatch,
         cast(sum(case when event_type = 'signup' then 1 else 0 end) as bigint) as guest,
         bool_or(event_type = 'click') as swab,
         bool_or(event_type = 'error' and value > 100) as predated,
         string_agg(distinct event_type, ' ' order by event_type) as note
  from events group by 1, 2)"""

PANEL = (
    VISITS
    + """,
span as (select entity, min(date) as lo, max(date) as hi from visits group by 1),
calendar as (select entity, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from span),
panel as (
  select c.entity, c.date, v.eggs, v.hatch, v.guest, v.swab, v.predated, v.note, v.entity is not null as observed,
         case when v.entity is null then 'not monitored on this date' end as gap_note,
         cast(dayofyear(c.date) as integer) as doy
  from calendar c left join visits v on c.entity = v.entity and c.date = v.date)"""
)


def dim(spark: SparkSession, d: str) -> DataFrame:
    """Entity dimension."""
    customer, nation, region = (load(spark, d, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("c_custkey").alias("entity"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("species"),
            F.col("r_name").alias("site"),
        )
    )


DIM = """dim as (
  select c_custkey as entity, c_name as name, c_mktsegment as species, r_name as site
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def coords(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates by arithmetic on the key; longitude is stored positive to the west."""
    return load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"),
        (45.0 + (F.col("s_suppkey") * 37 % 1000) / 100.0).alias("lat"),
        (95.0 + (F.col("s_suppkey") * 53 % 1000) / 100.0).alias("lon_west"),
    )


COORDS = """coords as (
  select s_suppkey as id, 45.0::double + (s_suppkey * 37 % 1000) / 100.0::double as lat,
         95.0::double + (s_suppkey * 53 % 1000) / 100.0::double as lon_west
  from supplier)"""
