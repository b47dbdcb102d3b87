"""Panel operators over the visit log derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import scalars
from quadrat.operators import joins, panel, rank
from quadrat.plans import views
from quadrat.plans.registry import query, rounded, rsql
from quadrat.sources.tables import literal_table

GAP = "not monitored on this date"

# SQL shared by the queries that look at neighbouring days
_NEAR = (
    views.PANEL
    + """,
near as (
  select *, lag(eggs) over w as prev_eggs, lead(eggs) over w as next_eggs,
         lag(hatch) over w as prev_hatch, lead(hatch) over w as next_hatch, lag(guest) over w as prev_guest,
         date = min(date) over (partition by entity) as first_day, date = max(date) over (partition by entity) as last_day
  from panel window w as (partition by entity order by date)),
tops as (select entity, max(eggs) as max_egg, max(hatch) as max_hatch,
                min(case when eggs >= 1 then doy end) as first_egg_doy, min(case when hatch >= 1 then doy end) as first_hatch_found_doy
         from near group by 1),
seen as (
  select n.entity, any_value(t.max_egg) as max_egg, any_value(t.max_hatch) as max_hatch,
         any_value(t.first_egg_doy) as first_egg_doy, any_value(t.first_hatch_found_doy) as first_hatch_found_doy,
         coalesce(bool_or(n.doy = t.first_egg_doy and n.eggs = 1 and n.prev_eggs = 0), false) as first_egg_witnessed,
         coalesce(bool_or(n.doy = t.first_hatch_found_doy and n.hatch >= 1 and n.prev_hatch = 0), false) as first_hatch_witnessed,
         max(case when n.doy = t.first_hatch_found_doy and n.hatch >= 1 then n.prev_eggs end) as eggs_before_found,
         bool_or(n.note like '%error%') as has_duds, max(case when n.last_day then n.eggs end) as last_count
  from near n join tops t on n.entity = t.entity group by 1),
facts as (
  select *, case when first_hatch_witnessed then first_hatch_found_doy end as first_hatch_doy,
         case when first_hatch_witnessed then eggs_before_found end as egg_before_hatch,
         case when has_duds then last_count else 0 end as num_duds
  from seen)"""
)


def _panel(spark, d):
    return panel.densify(views.visits(spark, d), "entity", "date", GAP)


def _near(spark, d):
    marked = panel.mark_ends(_panel(spark, d), "entity", "date")
    return panel.with_neighbours(marked, "entity", "date", ["eggs", "hatch", "guest"])


def _facts(spark, d):
    return panel.event_facts(_near(spark, d), "entity", "doy", "eggs", "hatch")


def _duds(spark, d):
    near = _near(spark, d)
    facts = near.groupBy("entity").agg(
        F.max(F.coalesce(F.col("note").rlike("(?i)error"), F.lit(False))).alias("has_duds"),
        F.max(F.when(F.col("last_day"), F.col("eggs"))).alias("last_count"),
    )
    return near, facts.withColumn("num_duds", panel.final_count(F.col("last_count"), F.col("has_duds")))


@query(
    "exclude_by_evidence",
    f"""with {views.VISITS}, out as (select entity from visits where regexp_matches(note, 'click.*signup.*view') and eggs >= 3)
        select entity, date, eggs from visits where entity not in (select entity from out)""",
)
def exclude_by_evidence(spark, d):
    log = views.visits(spark, d)
    evidence = F.col("note").rlike("click.*signup.*view") & (F.col("eggs") >= 3)
    (kept,) = panel.exclude_by_evidence([log], log, "entity", evidence)
    return kept.select("entity", "date", "eggs")


@query(
    "eligible_entities",
    f"""with {views.DIM}, sited as (
          select entity, name, species, case entity when 11 then 'outside' when 5 then 'east' else
                 case when regexp_matches(site, '^A') then 'east' when regexp_matches(site, '^E') then 'west' end end as area from dim)
        select row_number() over (order by entity) as master_number, entity, name, species, area from sited
        where area in ('east', 'west') and species in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
              and entity not in (select user_id from events where event_type = 'error' and value > 250)""",
)
def eligible_entities(spark, d):
    dim = views.dim(spark, d)
    by_prefix = [("^A", "east"), ("^E", "west")]
    area = scalars.first_match(
        [(F.col("entity") == 11, "outside"), (F.col("entity") == 5, "east")],
        panel.assign_site(F.col("site"), by_prefix, []),
    )
    from quadrat.sources.tables import load

    failed = panel.entities_where(
        load(spark, d, "events"), "user_id", (F.col("event_type") == "error") & (F.col("value") > 250)
    )
    kept = dim.withColumn("area", area).where(
        F.col("area").isin("east", "west") & F.col("species").isin("BUILDING", "MACHINERY", "HOUSEHOLD")
    )
    kept = joins.drop_members(kept, failed, "entity", "user_id").select("entity", "name", "species", "area")
    return rank.number_rows(kept, ["entity"], "master_number")


@query(
    "calendar_densify",
    f"""with {views.PANEL} select entity, date, eggs, hatch, note, observed, gap_note, doy from panel""",
)
def calendar_densify(spark, d):
    return _panel(spark, d).select("entity", "date", "eggs", "hatch", "note", "observed", "gap_note", "doy")


@query(
    "first_last_flag",
    f"""with {_NEAR} select entity, date, first_day, last_day from near""",
)
def first_last_flag(spark, d):
    return panel.mark_ends(_panel(spark, d), "entity", "date").select("entity", "date", "first_day", "last_day")


@query(
    "prev_next_day",
    f"""with {_NEAR} select entity, date, eggs, prev_eggs, next_eggs, prev_hatch, next_hatch from near""",
)
def prev_next_day(spark, d):
    return _near(spark, d).select("entity", "date", "eggs", "prev_eggs", "next_eggs", "prev_hatch", "next_hatch")


@query(
    "event_day_count",
    f"""with {views.VISITS} select entity, count(distinct case when swab then date end) as swab_days from visits group by 1""",
)
def event_day_count(spark, d):
    return panel.event_days(views.visits(spark, d), "entity", "date", F.col("swab"), "swab_days")


_OVERRIDES = [(3, 9, "one removed before the first visit"), (17, 7, "two lost during laying")]


@query(
    "max_with_override",
    f"""with {views.VISITS}, fix(entity, value, note) as (values (3, 9, 'one removed before the first visit'), (17, 7, 'two lost during laying')),
        top as (select entity, max(eggs) as m from visits group by 1)
        select top.entity, coalesce(fix.value::bigint, top.m) as max_egg, fix.note as max_egg_note
        from top left join fix on top.entity = fix.entity""",
)
def max_with_override(spark, d):
    fixes = literal_table(spark, _OVERRIDES, "entity long, value long, note string")
    return panel.max_with_override(views.visits(spark, d), "entity", "eggs", fixes, "max_egg")


@query(
    "entity_proportion",
    f"""with {views.VISITS}, top as (select entity, max(eggs) as e, max(hatch) as h, entity in (4, 9) as unknown from visits group by 1)
        select entity, case when not unknown then {rsql('h / nullif(e, 0)::double')} end as share from top""",
)
def entity_proportion(spark, d):
    top = views.visits(spark, d).groupBy("entity").agg(F.max("eggs").alias("e"), F.max("hatch").alias("h"))
    share = panel.proportion(F.col("h"), F.col("e"), F.col("entity").isin(4, 9))
    return top.select("entity", rounded(share).alias("share"))


@query(
    "outcome_class",
    f"""with {views.VISITS}, top as (select entity, max(eggs) as e, max(hatch) as h from visits group by 1)
        select entity, case when e = 0 then null when entity in (4, 9) then null when h = e then 'complete sucess'
                            when h = 0 then 'total failure' when h < e then 'partial sucess' end as outcome from top""",
)
def outcome_class(spark, d):
    rows = views.visits(spark, d)
    top = rows.groupBy("entity").agg(F.max("eggs").alias("e"), F.max("hatch").alias("h"))
    share = panel.proportion(F.col("h"), F.col("e"))
    return top.select("entity", panel.outcome(F.col("e"), share, F.col("entity").isin(4, 9)).alias("outcome"))


@query(
    "note_accumulate",
    f"""with {views.PANEL} select entity, date, nullif(concat_ws(', ', gap_note, case when eggs = 0 then 'no eggs' end,
             case when predated then 'predated' end), '') as notes from panel""",
)
def note_accumulate(spark, d):
    notes = panel.audit_note(
        F.col("gap_note"), F.when(F.col("eggs") == 0, "no eggs"), F.when(F.col("predated"), "predated")
    )
    return _panel(spark, d).select("entity", "date", notes.alias("notes"))


@query(
    "first_event_day",
    f"""with {_NEAR} select n.entity, n.date, t.first_egg_doy as first_doy, coalesce(n.eggs >= 1 and n.doy = t.first_egg_doy, false) as first_doy_found
        from near n join tops t on n.entity = t.entity""",
)
def first_event_day(spark, d):
    return panel.first_event(_panel(spark, d), "entity", "doy", "eggs", "first_doy").select(
        "entity", "date", "first_doy", "first_doy_found"
    )


@query(
    "event_witnessed",
    f"""with {_NEAR} select entity, first_egg_doy, first_egg_witnessed, first_hatch_witnessed, first_hatch_doy,
              make_date(2024, 1, 1) + (first_hatch_doy - 1) as first_hatch_date from facts""",
)
def event_witnessed(spark, d):
    return _facts(spark, d).select(
        "entity",
        "first_egg_doy",
        "first_egg_witnessed",
        "first_hatch_witnessed",
        "first_hatch_doy",
        scalars.date_of_day(F.col("first_hatch_doy"), 2024).alias("first_hatch_date"),
    )


@query(
    "change_direction",
    f"""with {_NEAR} select entity, date, eggs < next_eggs as rising, eggs > next_eggs as falling from near""",
)
def change_direction(spark, d):
    rising, falling = panel.direction(F.col("eggs"), F.col("next_eggs"))
    return _near(spark, d).select("entity", "date", rising.alias("rising"), falling.alias("falling"))


@query(
    "final_day_count",
    f"""with {_NEAR} select entity, has_duds, cast(num_duds as bigint) as num_duds from facts""",
)
def final_day_count(spark, d):
    _, duds = _duds(spark, d)
    return duds.select("entity", "has_duds", F.col("num_duds").cast("long").alias("num_duds"))


@query(
    "success_ratio",
    f"""with {_NEAR} select entity, max_hatch, egg_before_hatch, {rsql('max_hatch / nullif(egg_before_hatch, 0)::double')} as success from facts""",
)
def success_ratio(spark, d):
    return _facts(spark, d).select(
        "entity",
        "max_hatch",
        "egg_before_hatch",
        rounded(scalars.ratio(F.col("max_hatch"), F.col("egg_before_hatch"))).alias("success"),
    )


# incubation days by species of the test dimension; the fifth species has none
_INCUBATION = {"AUTOMOBILE": 12, "BUILDING": 13, "FURNITURE": 11, "MACHINERY": 12}

_START = f"""{_NEAR}, {views.DIM},
days as (select entity, case species when 'AUTOMOBILE' then 12 when 'BUILDING' then 13 when 'FURNITURE' then 11
                                     when 'MACHINERY' then 12 end as incubation from dim),
ruled as (
  select n.entity, n.eggs, n.first_day, f.*, d.incubation,
         case when f.first_egg_witnessed then 1
              when n.eggs >= 1 and n.doy = f.first_egg_doy and n.eggs < n.next_eggs then 2
              when n.eggs >= 1 and n.doy = f.first_egg_doy and n.eggs >= n.next_eggs and n.first_day and f.first_hatch_witnessed then 3
              when n.eggs >= 1 and n.doy = f.first_egg_doy and n.next_eggs is null and f.first_hatch_witnessed then 4 end as rule
  from near n join facts f on n.entity = f.entity left join days d on n.entity = d.entity),
valued as (
  select *, case rule when 1 then first_egg_doy when 2 then first_egg_doy - (eggs - 1)
                      when 3 then first_hatch_doy - incubation - (eggs - 1) when 4 then first_hatch_doy - incubation - (eggs - 1) end as value
  from ruled),
start as (
  select entity, min(rule) as start_rule, cast(min(value) as integer) as start_doy,
         bool_or(case when value is null then null when rule = 1 then false when rule in (2, 3) then true when rule = 4 and first_day then true end) as start_estimated
  from valued group by 1)"""


def _start(spark, d):
    days = views.dim(spark, d).select(
        "entity", scalars.first_match([(F.col("species") == s, n) for s, n in _INCUBATION.items()]).alias("incubation")
    )
    return panel.start_estimate(_facts(spark, d).join(days, "entity", "left"), F.col("incubation"))


@query(
    "start_date_estimate",
    f"""with {_START} select entity, start_rule, start_doy, start_estimated from start""",
)
def start_date_estimate(spark, d):
    return _start(spark, d).select("entity", "start_rule", "start_doy", "start_estimated")


_COMPLETION = """finish as (
  select n.entity, min(n.doy) as completion_doy from near n join facts f on n.entity = f.entity
  where n.hatch >= 1 and ((n.eggs = 0 and n.prev_eggs > 0)
        or (f.has_duds and n.prev_eggs > f.num_duds and n.eggs = f.num_duds and n.next_eggs = f.num_duds)) group by 1)"""


@query("completion_day", f"with {_NEAR}, {_COMPLETION} select entity, completion_doy from finish")
def completion_day(spark, d):
    near, duds = _duds(spark, d)
    return panel.completion(near, duds, "entity", "doy", "eggs", "hatch", "completion_doy")


@query(
    "entity_effect_flags",
    f"""with {views.PANEL} select entity, coalesce(bool_or(predated or regexp_matches(note, '(?i)error.*view')), false) as predation_weather,
              coalesce(bool_or(guest > 3), false) as parasitism, coalesce(bool_or(regexp_matches(note, '^signup$')), false) as deserted
        from panel group by 1""",
)
def entity_effect_flags(spark, d):
    note = F.col("note")
    return panel.entity_flags(
        _panel(spark, d),
        "entity",
        {
            "predation_weather": F.col("predated") | note.rlike("(?i)error.*view"),
            "parasitism": F.col("guest") > 3,
            "deserted": note.rlike("^signup$"),
        },
    )


@query(
    "durations",
    f"""with {_START}, {_COMPLETION}
        select s.entity, cast(f.completion_doy - s.start_doy as integer) as time_to_hatch, cast(f.completion_doy - x.first_hatch_doy as integer) as hatching_period
        from start s left join finish f on s.entity = f.entity join facts x on s.entity = x.entity""",
)
def durations(spark, d):
    start = _start(spark, d).select("entity", "start_doy", "first_hatch_doy")
    return start.join(completion_day(spark, d), "entity", "left").select(
        "entity",
        (F.col("completion_doy") - F.col("start_doy")).alias("time_to_hatch"),
        (F.col("completion_doy") - F.col("first_hatch_doy")).alias("hatching_period"),
    )


@query(
    "fact_dim_full",
    f"""with {views.PANEL}, {views.DIM} select coalesce(p.entity, dim.entity) as entity, p.date, p.eggs, p.observed, dim.name, dim.species, dim.site
        from panel p full join dim on p.entity = dim.entity""",
)
def fact_dim_full(spark, d):
    facts = _panel(spark, d).select("entity", "date", "eggs", "observed")
    return joins.natural_join(facts, views.dim(spark, d), "full")


@query(
    "kth_event_pivot",
    f"""with {views.VISITS}, hits as (select *, row_number() over (partition by entity order by date) as k from visits where swab and hatch > 0)
        select v.entity, v.date, v.eggs, f.eggs_first_swab, f.eggs_second_swab, f.eggs_third_swab,
               case h.k when 1 then 'first' when 2 then 'second' when 3 then 'third' end as ordinal
        from visits v left join (select entity, max(case when k = 1 then eggs end) as eggs_first_swab,
               max(case when k = 2 then eggs end) as eggs_second_swab, max(case when k = 3 then eggs end) as eggs_third_swab
             from hits where k <= 3 group by 1) f on v.entity = f.entity
        left join hits h on v.entity = h.entity and v.date = h.date and h.k <= 3""",
)
def kth_event_pivot(spark, d):
    log = views.visits(spark, d)
    hit = F.col("swab") & (F.col("hatch") > 0)
    out = panel.with_kth_events(log, "entity", "date", hit, "eggs", "eggs_", "_swab")
    return out.select("entity", "date", "eggs", *[f"eggs_{o}_swab" for o in panel.ORDINALS], "ordinal")


@query(
    "first_value",
    f"""with {views.VISITS} select entity, arg_min(eggs, date) as eggs_first_day from visits group by 1""",
)
def first_value(spark, d):
    return panel.first_value(views.visits(spark, d), "entity", "date", "eggs", "eggs_first_day")
