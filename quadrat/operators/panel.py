"""Entity panels: irregular visit logs turned into daily calendars, events, outcomes and durations.

A panel has one row per entity and calendar day.  Per-entity facts are plain
aggregates (``min`` of a struct finds "the row of the first event" without a
window), so an entity with a large share of the rows is reduced before the
shuffle.  Only neighbour-day values use a window by entity, and that window
holds at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.functions.scalars import first_match, if_else, join_notes, ratio
from quadrat.operators.grouping import first_k_rows, with_group
from quadrat.operators.joins import drop_members

GAP_NOTE = "nest not monitored on this date"


# ---------------------------------------------------------------- who is in the panel


def entities_where(df: DataFrame, entity: str, condition: Column) -> DataFrame:
    """Distinct entities with at least one row that meets the condition."""
    return df.where(condition).select(entity).distinct()


def exclude_by_evidence(tables: list[DataFrame], log: DataFrame, entity: str, condition: Column) -> list[DataFrame]:
    """Drop every entity with excluding evidence anywhere in the log from each table."""
    excluded = entities_where(log, entity, condition)
    return [drop_members(t, excluded, entity) for t in tables]


def assign_site(
    entity: Column, prefixes: Iterable[tuple[str, str]], exact: Iterable[tuple[str, str]]
) -> Column:
    """Site from id prefixes, replaced by exact-id exceptions; null when no rule fits."""
    by_prefix = first_match([(entity.rlike(pattern), site) for pattern, site in prefixes])
    return first_match([(entity == key, site) for key, site in exact], by_prefix)


# ---------------------------------------------------------------- calendar


def densify(visits: DataFrame, entity: str, date: str, gap_note: str = GAP_NOTE) -> DataFrame:
    """Every day between an entity's first and last visit; days without a visit carry a note.

    Several visits on one day stay several rows.  The calendar is built from one
    row per entity, so it grows with entity-days, not with visits.
    """
    span = visits.groupBy(entity).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(entity, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(date))
    seen = visits.withColumn("observed", F.lit(True))
    out = days.join(seen, [entity, date], "left")
    return out.withColumns(
        {
            "observed": F.coalesce("observed", F.lit(False)),
            "gap_note": F.when(F.col("observed").isNull(), F.lit(gap_note)),
            "doy": F.dayofyear(date),
        }
    )


def with_neighbours(panel: DataFrame, entity: str, date: str, columns: Iterable[str]) -> DataFrame:
    """``prev_x`` and ``next_x``: the value on the calendar day before and after.

    Null when that day has no row, also in a panel that was not densified.  With several rows
    on that day the largest value counts, for each row of the day that looks.
    """
    by_day = W.partitionBy(entity).orderBy(F.unix_date(F.col(date).cast("date")))
    before, after = by_day.rangeBetween(-1, -1), by_day.rangeBetween(1, 1)
    added = {}
    for c in columns:
        added[f"prev_{c}"] = F.max(c).over(before)
        added[f"next_{c}"] = F.max(c).over(after)
    return panel.withColumns(added)


def mark_ends(panel: DataFrame, entity: str, date: str) -> DataFrame:
    """Flags for the first and last day of each entity."""
    out = with_group(panel, [entity], {"__lo": F.min(date), "__hi": F.max(date)})
    return out.withColumns(
        {"first_day": F.col(date) == F.col("__lo"), "last_day": F.col(date) == F.col("__hi")}
    ).drop("__lo", "__hi")


# ---------------------------------------------------------------- per-entity facts


def event_days(panel: DataFrame, entity: str, date: str, flag: Column, name: str) -> DataFrame:
    """Number of different days with the flag per entity, zero when there is none."""
    per_day = panel.groupBy(entity, date).agg(F.max(F.coalesce(flag, F.lit(False))).alias("__hit"))
    return per_day.groupBy(entity).agg(F.count_if("__hit").alias(name))


def max_with_override(
    panel: DataFrame, entity: str, value: str, overrides: DataFrame, name: str
) -> DataFrame:
    """Entity maximum, replaced by a hand-checked value where the override table has one.

    ``overrides`` has the entity, ``value`` and ``note``; the note goes into the audit text.
    """
    top = panel.groupBy(entity).agg(F.max(value).alias("__max"))
    typed = overrides.select(entity, F.col("value").alias("__value"), F.col("note").alias(f"{name}_note"))
    out = top.join(typed, entity, "left")
    return out.withColumn(name, F.coalesce(F.col("__value").cast("long"), F.col("__max").cast("long"))).drop(
        "__max", "__value"
    )


def proportion(part: Column, whole: Column, unknown: Column | None = None) -> Column:
    """Part of whole; null for an empty whole or an entity listed as unknown."""
    value = ratio(part, whole)
    return value if unknown is None else F.when(~unknown, value)


# Outcome labels.
COMPLETE, PARTIAL, FAILURE = "complete sucess", "partial sucess", "total failure"


def outcome(max_egg: Column, share: Column, unknown: Column | None = None) -> Column:
    """Outcome class from the share that succeeded; a share above one has no class."""
    none = F.lit(None).cast("string")
    rules = [(max_egg == 0, none)]
    if unknown is not None:
        rules.append((unknown, none))
    return first_match(rules + [(share == 1, COMPLETE), (share == 0, FAILURE), (share < 1, PARTIAL)])


def direction(value: Column, following: Column) -> tuple[Column, Column]:
    """Rising and falling towards the next day; null when either day is unknown."""
    return if_else(value < following, F.lit(True), F.lit(False)), if_else(value > following, F.lit(True), F.lit(False))


def first_event(panel: DataFrame, entity: str, doy: str, count: str, name: str) -> DataFrame:
    """Day of the first positive count of the entity and a flag on the rows of that day."""
    out = with_group(panel, [entity], {name: F.min(F.when(F.col(count) >= 1, F.col(doy)))})
    found = (F.col(count) >= 1) & (F.col(doy) == F.col(name))
    return out.withColumn(f"{name}_found", F.coalesce(found, F.lit(False)))


def event_facts(panel: DataFrame, entity: str, doy: str, eggs: str, hatch: str) -> DataFrame:
    """First egg, first hatch and the values around them, one row per entity.

    Needs ``prev_``/``next_`` columns of both counts and the end flags.  The smallest
    struct led by the day carries the neighbouring values along, so one aggregate
    answers what would otherwise be four window passes.
    """
    e, h = F.col(eggs), F.col(hatch)
    egg_row = F.struct(
        F.col(doy).alias("doy"),
        e.alias("count"),
        F.col(f"prev_{eggs}").alias("prev"),
        F.col(f"next_{eggs}").alias("next"),
        F.col("first_day").alias("first_day"),
    )
    hatch_row = F.struct(
        F.col(doy).alias("doy"), F.col(f"prev_{hatch}").alias("prev"), F.col(f"prev_{eggs}").alias("eggs_before")
    )
    facts = panel.groupBy(entity).agg(
        F.max(eggs).alias("max_egg"),
        F.max(hatch).alias("max_hatch"),
        F.min(F.when(e >= 1, egg_row)).alias("__egg"),
        F.min(F.when(h >= 1, hatch_row)).alias("__hatch"),
        F.max(F.when(F.col("last_day"), e)).alias("last_count"),
    )
    witnessed = lambda c: F.coalesce(c, F.lit(False))
    facts = facts.withColumns(
        {
            "first_egg_doy": F.col("__egg.doy"),
            "first_egg_witnessed": witnessed((F.col("__egg.count") == 1) & (F.col("__egg.prev") == 0)),
            "first_hatch_found_doy": F.col("__hatch.doy"),
            "first_hatch_witnessed": witnessed(F.col("__hatch.prev") == 0),
        }
    )
    return facts.withColumns(
        {
            "first_hatch_doy": F.when(F.col("first_hatch_witnessed"), F.col("first_hatch_found_doy")),
            "egg_before_hatch": F.when(F.col("first_hatch_witnessed"), F.col("__hatch.eggs_before")),
            "egg_count_found": F.col("__egg.count"),
            "egg_rising": F.col("__egg.count") < F.col("__egg.next"),
            "egg_on_first_day": F.col("__egg.first_day"),
        }
    ).drop("__egg", "__hatch")


# Reasons written next to an estimated or missing start date.
LAYING_REASON = "clutch initiation estimated based on {who}s laying every 24hrs"
INCUBATION_REASON = "clutch initiation estimated based on average incubation time and {who}s laying every 24hrs"
NOT_INITIATED = "{who} clutch not initiated"
HATCH_UNSEEN = "unable to estimate clutch inititaion because first {who} hatch not witnessed"
NEVER_HATCHED = "unable to estimate clutch inititaion because {who} did not hatch"


def start_estimate(facts: DataFrame, incubation: Column, who: str = "host") -> DataFrame:
    """Start date by four ordered rules, with the rule, an estimated flag and a reason.

    1 the first egg was seen being laid; 2 count back one egg a day; 3 and 4 count
    back from the witnessed hatch by the incubation time and the eggs found.
    """
    back = (F.col("egg_count_found") - 1).cast("int")
    unseen = ~F.col("first_egg_witnessed") & F.col("first_egg_doy").isNotNull()
    rule = first_match(
        [
            (F.col("first_egg_witnessed"), F.lit(1)),
            (unseen & F.col("egg_rising"), F.lit(2)),
            (unseen & ~F.col("egg_rising") & F.col("egg_on_first_day") & F.col("first_hatch_witnessed"), F.lit(3)),
            (unseen & F.col("egg_rising").isNull() & F.col("first_hatch_witnessed"), F.lit(4)),
        ]
    )
    out = facts.withColumn("start_rule", rule)
    by_hatch = (F.col("first_hatch_doy") - incubation - back).cast("int")
    sure = F.col("start_rule").isin(2, 3) | ((F.col("start_rule") == 4) & F.col("egg_on_first_day"))
    out = out.withColumns(
        {
            "start_doy": F.when(F.col("start_rule") == 1, F.col("first_egg_doy"))
            .when(F.col("start_rule") == 2, F.col("first_egg_doy") - back)
            .when(F.col("start_rule").isin(3, 4), by_hatch),
        }
    )
    known = F.col("start_doy").isNotNull()
    out = out.withColumn(
        "start_estimated", F.when(known & (F.col("start_rule") == 1), F.lit(False)).when(known & sure, F.lit(True))
    )
    reason = (
        F.when(known & (F.col("start_rule") == 2), LAYING_REASON.format(who=who))
        .when(known & F.col("start_estimated"), INCUBATION_REASON.format(who=who))
        .when(~known & (F.col("max_egg") == 0), NOT_INITIATED.format(who=who))
        .when(~known & unseen & ~F.col("first_hatch_witnessed"), HATCH_UNSEEN.format(who=who))
        .when(~known & unseen & (F.col("max_hatch") == 0), NEVER_HATCHED.format(who=who))
    )
    return out.withColumn("start_reason", reason)


def final_count(last_count: Column, flagged: Column) -> Column:
    """Count on the last day for a flagged entity, zero for one that is not flagged."""
    return F.when(flagged, last_count).when(~flagged, F.lit(0))


def completion(
    panel: DataFrame, duds: DataFrame | None, entity: str, doy: str, eggs: str, hatch: str, name: str
) -> DataFrame:
    """First day on which nothing was left to hatch, one row per entity that has one.

    Either no egg is left and there was one the day before, or, for entities with
    known duds, exactly the duds are left today and tomorrow.  ``duds`` has the
    entity, ``has_duds`` and ``num_duds``.
    """
    e, prev, following = F.col(eggs), F.col(f"prev_{eggs}"), F.col(f"next_{eggs}")
    emptied = (e == 0) & (prev > 0)
    rows = panel
    if duds is not None:
        rows = panel.join(duds.select(entity, "has_duds", "num_duds"), entity, "left")
        left = F.col("num_duds")
        emptied = emptied | (F.col("has_duds") & (prev > left) & (e == left) & (following == left))
    return rows.where((F.col(hatch) >= 1) & emptied).groupBy(entity).agg(F.min(doy).alias(name))


def entity_flags(panel: DataFrame, entity: str, flags: dict[str, Column]) -> DataFrame:
    """For each flag, whether any row of the entity has it."""
    return panel.groupBy(entity).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


def first_value(panel: DataFrame, entity: str, order: str, value: str, name: str) -> DataFrame:
    """Value on the entity's first day."""
    return panel.groupBy(entity).agg(F.min_by(value, order).alias(name))


# Names of the first three occasions.
ORDINALS = ["first", "second", "third"]


def with_kth_events(
    panel: DataFrame, entity: str, date: str, flag: Column, value: str, prefix: str, suffix: str, ordinal: str = "ordinal"
) -> DataFrame:
    """The rows with the values of their entity's first three flagged rows as columns, and the ordinal of a flagged row.

    Flagged rows are numbered by date and value, so two of one day have two ordinals and no row is doubled.
    Rows without an entity are kept and have neither.
    """
    known = panel.where(F.col(entity).isNotNull())
    upto = W.partitionBy(entity).orderBy(date, value).rowsBetween(W.unboundedPreceding, W.currentRow)
    # the window holds what an entity's calendar holds, and streams
    numbered = known.withColumn("__k", F.when(flag, F.count(F.when(flag, F.lit(1))).over(upto)))
    first = [F.max(F.when(F.col("__k") == i + 1, F.col(value))).alias(f"{prefix}{o}{suffix}") for i, o in enumerate(ORDINALS)]
    values = numbered.where(F.col("__k") <= len(ORDINALS)).groupBy(entity).agg(*first)
    name = first_match([(F.col("__k") == i + 1, o) for i, o in enumerate(ORDINALS)]).alias(ordinal)
    found = numbered.join(values, entity, "left")
    out = found.select(*[found[c] for c in panel.columns], *values.columns[1:], name)
    return out.unionByName(panel.where(F.col(entity).isNull()), allowMissingColumns=True)


def audit_note(*notes: Column) -> Column:
    """Audit messages in one text."""
    return join_notes(*notes)
