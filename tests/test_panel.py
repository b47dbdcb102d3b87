import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrat.operators import panel
from tests.conftest import rows

D = dt.date


@pytest.fixture(scope="module")
def visits(spark):
    data = [
        # watched from the first egg to the last hatch, with a gap day
        ("a3", D(2022, 5, 1), 0, 0, None),
        ("a3", D(2022, 5, 2), 1, 0, None),
        ("a3", D(2022, 5, 3), 2, 0, "wind"),
        ("a3", D(2022, 5, 5), 3, 0, None),
        ("a3", D(2022, 5, 6), 1, 2, None),
        ("a3", D(2022, 5, 7), 0, 3, None),
        # found with eggs
        ("a35", D(2022, 5, 1), 2, 0, "one addled egg"),
        ("a35", D(2022, 5, 2), 3, 0, None),
        # found complete, hatch seen
        ("e1", D(2022, 5, 20), 3, 0, None),
        ("e1", D(2022, 5, 21), 1, 2, None),
        ("e1", D(2022, 5, 22), 1, 2, None),
        # one visit, nothing in it
        ("j1", D(2022, 5, 9), 0, 0, None),
    ]
    return spark.createDataFrame(data, "e string, d date, eggs int, hatch int, note string")


@pytest.fixture(scope="module")
def near(visits):
    marked = panel.mark_ends(panel.densify(visits, "e", "d"), "e", "d")
    return panel.with_neighbours(marked, "e", "d", ["eggs", "hatch"]).persist()


@pytest.fixture(scope="module")
def facts(near):
    return panel.event_facts(near, "e", "doy", "eggs", "hatch").persist()


def by_entity(df):
    return {r["e"]: r.asDict() for r in df.collect()}


def test_densify_fills_the_gap(visits):
    out = panel.densify(visits, "e", "d")
    gap = out.where("e = 'a3' and not observed").collect()
    assert [(r["d"], r["gap_note"]) for r in gap] == [(D(2022, 5, 4), panel.GAP_NOTE)]
    assert out.count() == 13


def test_several_visits_on_a_day_stay(visits):
    twice = visits.unionByName(visits.where("e = 'j1'"))
    assert panel.densify(twice, "e", "d").where("e = 'j1'").count() == 2


def test_neighbours_stop_at_gaps(visits, near):
    dense = near.where("e = 'a3' and d = '2022-05-05'").first()
    assert dense["prev_eggs"] is None and dense["next_eggs"] == 1
    sparse = panel.with_neighbours(visits, "e", "d", ["eggs"]).where("e = 'a3' and d = '2022-05-05'").first()
    assert sparse["prev_eggs"] is None


def test_event_facts(facts):
    f = by_entity(facts)
    assert f["a3"]["first_egg_witnessed"] and f["a3"]["first_egg_doy"] == 122
    assert f["a3"]["first_hatch_witnessed"] and f["a3"]["egg_before_hatch"] == 3
    assert not f["a35"]["first_egg_witnessed"] and f["a35"]["first_hatch_doy"] is None
    assert f["j1"]["first_egg_doy"] is None and f["j1"]["max_egg"] == 0


def test_start_rules(facts):
    out = by_entity(panel.start_estimate(facts, F.lit(11)))
    assert (out["a3"]["start_rule"], out["a3"]["start_doy"], out["a3"]["start_estimated"]) == (1, 122, False)
    assert (out["a35"]["start_rule"], out["a35"]["start_doy"], out["a35"]["start_estimated"]) == (2, 120, True)
    assert (out["e1"]["start_rule"], out["e1"]["start_doy"]) == (3, 141 - 11 - 2)
    assert out["j1"]["start_doy"] is None and out["j1"]["start_reason"] == "host clutch not initiated"


def test_completion_with_and_without_duds(spark, near):
    plain = by_entity(panel.completion(near, None, "e", "doy", "eggs", "hatch", "end"))
    assert {k: v["end"] for k, v in plain.items()} == {"a3": 127}
    duds = spark.createDataFrame([("e1", True, 1)], "e string, has_duds boolean, num_duds int")
    assert by_entity(panel.completion(near, duds, "e", "doy", "eggs", "hatch", "end"))["e1"]["end"] == 141


def test_exclusion_is_exact(visits):
    (kept,) = panel.exclude_by_evidence([visits], visits, "e", F.col("note").rlike("wind"))
    assert {r[0] for r in kept.select("e").distinct().collect()} == {"a35", "e1", "j1"}


def test_outcomes(spark):
    df = spark.createDataFrame([(0, None), (4, 1.0), (4, 0.0), (4, 0.5), (4, 1.5)], "m int, p double")
    got = rows(df.select(panel.outcome(F.col("m"), F.col("p"))))
    assert [r[0] for r in got] == [None, panel.COMPLETE, panel.FAILURE, panel.PARTIAL, None]


def test_direction_is_null_without_neighbour(near):
    rising, falling = panel.direction(F.col("eggs"), F.col("next_eggs"))
    last = near.where("e = 'a35' and last_day").select(rising, falling).first()
    assert tuple(last) == (None, None)


def test_event_days_and_flags(visits):
    days = by_entity(panel.event_days(visits, "e", "d", F.col("hatch") > 0, "n"))
    assert {k: v["n"] for k, v in days.items()} == {"a3": 2, "a35": 0, "e1": 2, "j1": 0}
    flags = by_entity(panel.entity_flags(visits, "e", {"w": F.col("note").rlike("(?i)wind")}))
    assert flags["a3"]["w"] and not flags["j1"]["w"]


def test_override_and_kth(spark, visits):
    fixes = spark.createDataFrame([("a3", 5, "two removed")], "e string, value int, note string")
    top = by_entity(panel.max_with_override(visits, "e", "eggs", fixes, "m"))
    assert top["a3"]["m"] == 5 and top["a3"]["m_note"] == "two removed" and top["e1"]["m"] == 3
    out = panel.with_kth_events(visits, "e", "d", F.col("eggs") > 0, "eggs", "n_", "")
    assert out.count() == visits.count()
    rows = out.where("e = 'a3'").collect()
    assert {(r["n_first"], r["n_second"], r["n_third"]) for r in rows} == {(1, 2, 3)}
    assert out.where("e = 'e1' and ordinal is not null").count() == 3


def test_two_events_of_one_day_do_not_double_rows(spark):
    log = spark.createDataFrame([("n", 1, 5, True), ("n", 1, 4, True), ("n", 2, 9, False), ("n", 3, 7, True), (None, 1, 1, True), ("m", 1, 2, False)], "e string, d int, v int, hit boolean")
    out = panel.with_kth_events(log, "e", "d", F.col("hit"), "v", "v_", "")
    got = sorted((r["e"] or "", r["d"], r["v"], r["ordinal"], r["v_first"], r["v_second"], r["v_third"]) for r in out.collect())
    assert got == [("", 1, 1, None, None, None, None), ("m", 1, 2, None, None, None, None), ("n", 1, 4, "first", 4, 5, 7), ("n", 1, 5, "second", 4, 5, 7), ("n", 2, 9, None, 4, 5, 7), ("n", 3, 7, "third", 4, 5, 7)]


def test_first_event(near):
    out = panel.first_event(near, "e", "doy", "eggs", "first").where("first_found").collect()
    assert {(r["e"], r["doy"]) for r in out} == {("a3", 122), ("a35", 121), ("e1", 140)}


def test_neighbours_look_up_the_calendar_day(spark):
    visits = spark.createDataFrame([("n", "2022-05-01", 1), ("n", "2022-05-02", 2), ("n", "2022-05-02", 3), ("n", "2022-05-03", 4), ("n", "2022-05-05", 5)], "e string, d string, eggs int")
    out = panel.with_neighbours(visits.selectExpr("e", "to_date(d) as d", "eggs"), "e", "d", ["eggs"]).orderBy("d", "eggs").collect()
    assert [(r.eggs, r.prev_eggs, r.next_eggs) for r in out] == [(1, None, 3), (2, 1, 4), (3, 1, 4), (4, 3, None), (5, None, None)]
