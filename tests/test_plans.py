import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quadrat.plans import community, field_season
from tests.conftest import rows

MASTER = [
    (9, "a10", "YEWA", "dwarf raspberry"),
    (4, "a1", "RWBL", "na"),
    (7, "e3", "YEWA", "willow"),
    (8, "j6", "YEWA", "willow"),
    (1, "r1", "YEWA", "willow"),
    (2, "a20", "MODO", "willow"),
    (3, "a30", "GRCA", "willow"),
    (5, "a40", "AMRO", "willow"),
]


def visit(nest, date, egg, hatch, note=None, guest=0, swab="no", predated="no"):
    return (nest, date, "1899-12-31 10:30:00", "Yes", "Laying", egg, guest, "n", "na", swab, predated, hatch, 0, note)


LOG = [
    visit("a10", 520, 0, 0),
    visit("a10", 521, 1, 0, swab="Yes"),
    visit("a10", 522, 2, 0, "storm last night", swab="yes"),
    visit("a10", 524, 2, 0),
    visit("a10", 601, 1, 1),
    visit("a10", 602, 0, 2),
    visit("a1", 525, 3, 0, "likely deserted", guest=1),
    visit("e3", 525, 0, 0, "windy day"),
    visit("e3", 631, 0, 0),
    visit("a30", 525, 1, 0, "Old Nest"),
    visit("a40", 525, 1, 0, "need ladder to reach"),
]
SCHEMA = """nest_id string, date int, time string, adult string, stage string, num_host_egg int, num_bhco_egg int,
new_parasitism string, bhco_swab string, host_swab string, predated string, num_host_hatch int, num_bhco_hatch int, notes string"""


@pytest.fixture(scope="module")
def season(spark):
    master = spark.createDataFrame(MASTER, "master_number int, nest_id string, host_species string, tree_species string")
    return field_season.field_season(master, spark.createDataFrame(LOG, SCHEMA))


def test_nest_list(season):
    got = rows(season["master_nest_list"].select("master_number", "nest_id", "site", "tree_species"), "nest_id")
    # r1 has no site, j6 lies outside, a20 is another species, a30 is old, a40 was not monitored
    assert got == [(1, "a1", "pcc", None), (2, "a10", "dwf", "raspberry"), (3, "e3", "pcc", "willow")]
    assert [r["nest_id"] for r in season["not_monitored_nests"].collect()] == ["a40"]


def test_observations(season):
    table = season["nest_observations"]
    assert table.columns == field_season.OBSERVATION_COLUMNS and len(table.columns) == 60
    nest = {r["nest_id"]: r for r in table.collect()}
    a10 = nest["a10"]
    assert a10["host_clutch_initiation_date"] == dt.date(2022, 5, 21) and a10["host_clutch_initiation_estimated"] == "no"
    # the day before the first hatchling was not visited, so the hatch was not witnessed
    assert a10["host_first_hatch_date"] is None and a10["host_last_hatch_date"] == dt.date(2022, 6, 2)
    assert a10["host_time_to_hatch"] == 12 and a10["host_nest_outcome"] == "complete sucess"
    assert a10["predation_weather_effect"] == "yes" and nest["e3"]["predation_weather_effect"] == "no"
    assert a10["num_host_swabs"] == 2 and a10["average_host_incubation_period"] == 11
    assert nest["a1"]["nest_deserted"] == "yes" and nest["a1"]["natural_parasitism"] == "yes"
    assert "host proportion hatch unknown because nest not initiated" in nest["e3"]["data_cleaning_notes"]
    assert table.where("nest_id = 'a10'").count() == 14
    gaps = table.where("nest_id = 'a10' and data_cleaning_notes like 'nest not monitored on this date%'").count()
    assert gaps == 8


def test_summary(season):
    got = {(r["host_species"], r["site"]): r for r in season["summary_table"].collect()}
    assert len(season["summary_table"].columns) == 60
    assert got["YEWA", "dwf"]["num_complete_sucess_host_nest"] == 1 and got["YEWA", "dwf"]["num_nest_parasitized"] is None
    assert got["RWBL", "pcc"]["num_nest_affected_by_desertion_burial"] == 1
    assert got["YEWA", "dwf"]["max_num_host_egg"] == 2 and got["RWBL", "pcc"]["sd_num_host_egg"] is None


def test_swabs(season):
    observed = season["master_and_nest_observations"]
    out = community.swab_history(observed)
    assert {r[0] for r in out["not_swabbed"].select("nest_id").distinct().collect()} == {"a1", "e3"}
    orders = out["swab_nests"].where("host_swab_order is not null").select("date", "host_swab_order", "num_eggs_second_host_swab")
    assert rows(orders, "date") == [(dt.date(2022, 5, 21), "first", 2), (dt.date(2022, 5, 22), "second", 2)]


def test_sequencing(spark):
    head = "asv_name string, kingdom string, phylum string, species string, asv_sequences string, " + ", ".join(
        f"{s} long" for s in ("a1_mul1806", "e2_mul1806", "j3_mul1806", "x0001_mul1806", "water1_cou1805")
    )
    data = [
        ("ASV1", "Bacteria", "P", "big_one_x", "ACGT", 5, 5, 5, 5, 0),
        ("ASV2", "Bacteria", None, None, "CC", 1, 1, 1, 0, 0),
        ("ASV3", "Archaea", "P", "s", "GG", 5, 5, 5, 5, 5),
        ("ASV4", "Bacteria", "P", "s", "TT", 500, 1, 1, 1, 1),
    ]
    out = community.sequencing(spark.createDataFrame(data, head))
    assert rows(out["pilot_taxo"]) == [("ASV1", "Bacteria", "P", "big one_x")]
    got = rows(out["pilot_sample_asv"].select("sample", "reads", "nest_id", "control_type"), "sample")
    assert got[0] == ("a1_mul1806", 5, "a1", None) and got[-1] == ("x0001_mul1806", 5, None, "cloacal") and len(got) == 5


def test_community_statistics(spark):
    rng = random.Random(5)
    nests = [f"n{i}" for i in range(10)]
    cells = [(n, f"ASV{j}", rng.randint(1, 30) + (40 if (j < 2) == (i < 5) else 0)) for i, n in enumerate(nests) for j in range(6)]
    members = [(n, "dwf" if i < 5 else "pcc") for i, n in enumerate(nests)]
    places = [(n, 50 + rng.random(), -100 + rng.random()) for n in nests]
    out = community.community_statistics(
        spark.createDataFrame(cells, "nest_id string, asv_name string, reads long"),
        spark.createDataFrame(members, "nest_id string, group string"),
        spark.createDataFrame(places, "nest_id string, latitude double, longitude double"),
        ["dwf", "pcc"],
        iterations=3,
        permuted=19,
    )
    assert out["alpha"].count() == 50 and out["bray"].count() == 45 and out["alpha_t"].count() == 5
    assert out["permanova"].first()["p_value"] == pytest.approx(0.05)
    assert 0 < out["mantel"].first()["p_value"] <= 1 and out["dispersion"].first()["df2"] == 8
    assert out["indicators"].where(F.col("stat") > 0.7).count() > 0
