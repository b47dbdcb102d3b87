"""From a nest list and a visit log to nest histories and the season's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import scalars
from quadrat.functions.scalars import recode, text_rules, yes_no
from quadrat.operators import grouping, joins, panel, rank
from quadrat.plans import field_rules as rules
from quadrat.session import cut_lineage
from quadrat.sources.tables import literal_table

NEST = "nest_id"
WHO = ("host", "bhco")


def classify_nests(master: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """Nests of the study, renumbered, and the nests and visits that were not monitored."""
    old = panel.entities_where(log, NEST, text_rules(F.col("notes"), rules.OLD_NEST, "no") == "yes")
    master, log = joins.drop_members(master, old, NEST), joins.drop_members(log, old, NEST)
    unmonitored = panel.entities_where(log, NEST, text_rules(F.col("notes"), rules.MONITORED, "yes") == "no")
    target = F.coalesce(F.col("host_species").rlike(rules.TARGET_SPECIES), F.lit(False))
    sited = master.withColumns(
        {
            "tree_species": recode(F.col("tree_species"), rules.TREE_SPECIES),
            "site": panel.assign_site(F.col(NEST), rules.SITE_PREFIXES, rules.SITE_EXACT),
            "target_species": yes_no(target),
        }
    )
    kept = sited.where((F.col("target_species") == "yes") & F.col("site").isin(rules.SITES))
    kept = joins.drop_members(kept, unmonitored, NEST)
    columns = kept.columns
    return {
        "nests": rank.number_rows(kept.drop("master_number"), [NEST], "master_number").select(*columns),
        "log": joins.drop_members(log, unmonitored, NEST),
        "not_monitored": joins.natural_join(
            joins.keep_members(sited, unmonitored, NEST), joins.keep_members(log, unmonitored, NEST), "full"
        ),
    }


def clean_log(log: DataFrame, year: int) -> DataFrame:
    """Uniform spellings, real dates and clock times; rows without a date are dropped."""
    out = log.withColumnRenamed("notes", "field_notes")
    maps = {
        "adult": rules.ADULT,
        "stage": rules.STAGE,
        "new_parasitism": rules.NEW_PARASITISM,
        "bhco_swab": rules.BHCO_SWAB,
        "host_swab": rules.HOST_SWAB,
        "predated": rules.PREDATED,
    }
    out = out.withColumns({c: recode(F.col(c), m) for c, m in maps.items()})
    out = out.withColumns({"time": scalars.clock_time(F.col("time")), "date": scalars.packed_date(F.col("date"), year)})
    return out.where(F.col("date").isNotNull())


def _history(near: DataFrame, nests: DataFrame, duds: DataFrame, who: str, year: int) -> DataFrame:
    """One row per nest: eggs, hatching, outcome and dates of the host or of the guest."""
    spark = near.sparkSession
    eggs, hatch = f"num_{who}_egg", f"num_{who}_hatch"
    facts = panel.event_facts(near, NEST, "doy", eggs, hatch)
    host = who == "host"
    fixes = {"max_egg": rules.MAX_HOST_EGG if host else [], "max_hatch": rules.MAX_HOST_HATCH if host else []}
    for column, rows in fixes.items():
        # typed-in corrections, a fixed handful of rows
        table = literal_table(spark, rows, f"{NEST} string, __value long, {column}_note string")
        facts = facts.join(F.broadcast(table), NEST, "left").withColumn(
            column, F.coalesce("__value", F.col(column).cast("long"))
        )
        facts = facts.drop("__value")
    unknown = F.col(NEST).isin(rules.UNKNOWN_PROPORTION) if host else F.lit(False)
    lost = F.col(NEST).isin(rules.UNKNOWN_OUTCOME) if host else None
    facts = facts.withColumn("share", panel.proportion(F.col("max_hatch"), F.col("max_egg"), unknown))
    days = literal_table(spark, rules.INCUBATION, "host_species string, incubation int, citation string")
    if host:
        facts = facts.join(nests.select(NEST, "host_species"), NEST, "left").join(F.broadcast(days), "host_species", "left")
        facts = facts.drop("host_species")
    else:
        number, source = rules.BHCO_INCUBATION
        facts = facts.withColumns({"incubation": F.lit(number), "citation": F.lit(source)})
    facts = panel.start_estimate(facts, F.col("incubation"), who)
    end = panel.completion(near, duds if host else None, NEST, "doy", eggs, hatch, "last_hatch_doy")
    facts = facts.join(end, NEST, "left").withColumn("last_hatch_doy", F.when(F.col("max_hatch") >= 1, F.col("last_hatch_doy")))
    col = F.col
    no_eggs = f"{who} proportion hatch unknown because nest not initiated"
    share_note = F.when(unknown, "host proportion hatched unknown because nest found with 1 egg 1 hatch").when(
        col("max_egg") == 0, no_eggs
    )
    hatch_note = F.when(col("max_egg") > 0, F.when(col("max_hatch") == 0, f"{who} did not hatch").when(
        ~col("first_hatch_witnessed"), f"first {who} hatch was not witnessed"
    ))
    last_note = F.when(
        (col("max_hatch") > 0) & (col("max_egg") > 0) & col("last_hatch_doy").isNull(),
        f"last {who} hatch was not witnessed",
    )
    note = panel.audit_note(
        col("max_egg_note"), col("max_hatch_note"), share_note, hatch_note, col("start_reason"), last_note
    )

    def date(c: str) -> Column:
        return scalars.date_of_day(col(c), year)

    named = {
        f"max_{who}_egg": col("max_egg"),
        f"max_{who}_hatch": col("max_hatch"),
        f"num_{who}_egg_before_hatch": col("egg_before_hatch"),
        f"{who}_proportion_hatch": col("share"),
        f"{who}_hatching_sucess": scalars.ratio(col("max_hatch"), col("egg_before_hatch")),
        f"{who}_nest_outcome": panel.outcome(col("max_egg"), col("share"), lost),
        f"{who}_clutch_initiation_date": date("start_doy"),
        f"{who}_clutch_initiation_day_of_year": col("start_doy"),
        f"{who}_clutch_initiation_estimated": F.when(col("start_estimated"), "yes").when(~col("start_estimated"), "no"),
        f"{who}_first_hatch_date": date("first_hatch_doy"),
        f"{who}_first_hatch_day_of_year": col("first_hatch_doy"),
        f"{who}_last_hatch_date": date("last_hatch_doy"),
        f"{who}_last_hatch_day_of_year": col("last_hatch_doy"),
        f"{who}_time_to_hatch": col("last_hatch_doy") - col("start_doy"),
        f"{who}_hatching_period": col("last_hatch_doy") - col("first_hatch_doy"),
        f"average_{who}_incubation_period": col("incubation"),
        f"citation_average_{who}_incubation_period": col("citation"),
        f"__{who}_hatch_seen": col("first_hatch_witnessed"),
        f"__{who}_note": note,
    }
    return facts.select(NEST, *[c.alias(n) for n, c in named.items()])


# Columns of the observation table, in order.
OBSERVATION_COLUMNS = """nest_id date day_of_year time adult num_host_egg num_host_hatch num_bhco_egg num_bhco_hatch
new_parasitism predated nest_damage weather_impact natural_parasitism nest_deserted nest_buried desertion_burial_effect
predation_weather_effect host_nest_outcome bhco_nest_outcome max_host_egg addled_host_egg num_addled_host_egg
max_host_hatch num_host_egg_before_hatch host_proportion_hatch host_hatching_sucess host_clutch_initiation_date
host_clutch_initiation_day_of_year host_clutch_initiation_estimated host_first_hatch_date
host_first_hatch_day_of_year host_last_hatch_date host_last_hatch_day_of_year host_time_to_hatch
host_hatching_period max_bhco_egg max_bhco_hatch num_bhco_egg_before_hatch bhco_proportion_hatch
bhco_hatching_sucess bhco_clutch_initiation_date bhco_clutch_initiation_day_of_year
bhco_clutch_initiation_estimated bhco_first_hatch_date bhco_first_hatch_day_of_year bhco_last_hatch_date
bhco_last_hatch_day_of_year bhco_time_to_hatch bhco_hatching_period bhco_swab host_swab host_swab_first_egg
num_host_swabs average_host_incubation_period citation_average_host_incubation_period
average_bhco_incubation_period citation_average_bhco_incubation_period field_notes data_cleaning_notes""".split()


def observations(log: DataFrame, nests: DataFrame, year: int) -> DataFrame:
    """One row per nest and day with the nest's history on every row."""
    visits = joins.keep_members(clean_log(log, year), nests, NEST)
    days = panel.mark_ends(panel.densify(visits, NEST, "date"), NEST, "date")
    counts = [f"num_{w}_{x}" for w in WHO for x in ("egg", "hatch")]
    near = panel.with_neighbours(days, NEST, "date", counts)
    note = F.col("field_notes")
    near = near.withColumns(
        {
            "day_of_year": F.col("doy"),
            "weather_impact": text_rules(note, rules.WEATHER, "no"),
            "nest_damage": text_rules(note, rules.DAMAGE, "no"),
        }
    )
    # seven aggregates and the final join read the panel, so it is written once
    near = cut_lineage(near)
    flags = near.groupBy(NEST).agg(
        *[
            F.max(F.coalesce(c, F.lit(False))).alias(n)
            for n, c in {
                "__deserted": note.rlike(rules.DESERTED),
                "__buried": note.rlike(rules.BURIED),
                "has_duds": note.rlike(rules.ADDLED),
                "__hit": (F.col("predated") == "yes") | (F.col("weather_impact") == "yes"),
                "__guest": F.col("num_bhco_egg") > 0,
                "__one_egg_swab": (F.col("host_swab") == "yes") & (F.col("num_host_egg") == 1),
            }.items()
        ],
        F.max(F.when(F.col("last_day"), F.col("num_host_egg"))).alias("__last_eggs"),
    )
    flags = flags.withColumn("num_duds", panel.final_count(F.col("__last_eggs"), F.col("has_duds")))
    swabs = panel.event_days(near, NEST, "date", F.col("host_swab") == "yes", "num_host_swabs")
    nest_facts = flags.join(swabs, NEST)
    for who in WHO:
        nest_facts = nest_facts.join(_history(near, nests, flags, who, year), NEST)
    col = F.col
    nest_facts = nest_facts.select(
        "*",
        yes_no(col("__deserted")).alias("nest_deserted"),
        yes_no(col("__buried")).alias("nest_buried"),
        yes_no(col("__deserted") | col("__buried")).alias("desertion_burial_effect"),
        yes_no(col("__hit")).alias("predation_weather_effect"),
        yes_no(col("__guest")).alias("natural_parasitism"),
        yes_no(col("has_duds")).alias("addled_host_egg"),
        col("num_duds").cast("int").alias("num_addled_host_egg"),
        yes_no(col("__one_egg_swab") & col("__host_hatch_seen")).alias("host_swab_first_egg"),
    )
    out = near.join(nest_facts, NEST)
    out = out.withColumn("data_cleaning_notes", panel.audit_note(col("gap_note"), col("__host_note"), col("__bhco_note")))
    return out.select(*OBSERVATION_COLUMNS)


# Columns of the status table with the condition each counts.
STATUS = {
    "num_total_failure_bhco_nest": ("bhco_nest_outcome", "total failure"),
    "num_partial_sucess_bhco_nest": ("bhco_nest_outcome", "partial sucess"),
    "num_complete_sucess_bhco_nest": ("bhco_nest_outcome", "complete sucess"),
    "num_total_failure_host_nest": ("host_nest_outcome", "total failure"),
    "num_partial_sucess_host_nest": ("host_nest_outcome", "partial sucess"),
    "num_complete_sucess_host_nest": ("host_nest_outcome", "complete sucess"),
    "num_nest_with_addled_host_egg": ("addled_host_egg", "yes"),
    "num_nest_parasitized": ("natural_parasitism", "yes"),
    "num_nest_affected_by_desertion_burial": ("desertion_burial_effect", "yes"),
    "num_nest_affected_by_predation_weather": ("predation_weather_effect", "yes"),
}


def season_summary(observed: DataFrame) -> DataFrame:
    """Nest counts and variable profiles by host species and site."""
    keys = ["host_species", "site"]
    values = [
        f.format(who)
        for who in WHO
        for f in ("num_{}_egg", "num_{}_hatch", "{}_hatching_sucess", "{}_proportion_hatch", "{}_time_to_hatch", "{}_hatching_period")
    ]
    conditions = {n: F.col(c) == v for n, (c, v) in STATUS.items()}
    counts = grouping.status_counts(observed, keys, NEST, conditions)
    profile = grouping.profile(observed, keys, values)
    both = joins.keyed_join(counts, profile, keys, "full", null_safe=True)
    return both.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def field_season(master: DataFrame, log: DataFrame, year: int = 2022) -> dict[str, DataFrame]:
    """All tables of the season from the two field tables."""
    parts = classify_nests(master, log)
    observed = observations(parts["log"], parts["nests"], year)
    together = joins.natural_join(observed, parts["nests"], "full")
    return {
        "master_nest_list": parts["nests"],
        "nest_observations": observed,
        "master_and_nest_observations": together,
        "not_monitored_nests": parts["not_monitored"],
        "summary_table": season_summary(together),
    }
