import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import grouping, joins, quantiles, rank, reshape
from tests.conftest import rows


def test_natural_join_matches_null_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20), ("z", 30)], "k string, b int")
    full = joins.natural_join(a, b, "full").orderBy("a", "b")
    assert sorted(map(str, rows(full))) == sorted(
        map(str, [("x", 1, 10), (None, 2, 20), ("y", 3, None), ("z", None, 30)])
    )
    assert joins.natural_join(a, b, "left").count() == 3
    with pytest.raises(ValueError):
        joins.natural_join(a, b.toDF("q", "r"))


def test_members_and_nulls(spark):
    df = spark.createDataFrame([("a3",), ("a35",), (None,)], "id string")
    ids = spark.createDataFrame([("a3",), (None,)], "id string")
    assert rows(joins.keep_members(df, ids, "id")) == [("a3",)]
    assert sorted(map(str, rows(joins.drop_members(df, ids, "id")))) == ["('a35',)", "(None,)"]


def test_number_rows_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    out = rank.number_rows(df, ["v"], "n")
    assert out.where("n <> v + 1").count() == 0 and out.count() == 1000


@pytest.mark.parametrize("hot", [0, 700])
def test_exact_quantiles_equal_numpy(spark, hot):
    rng = np.random.default_rng(1)
    values = np.r_[rng.normal(size=1500), np.full(hot, 0.25)]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("one", 4.0), ("one", None)], "g string, v double")
    out = dict((r[0], r[1:]) for r in rows(quantiles.exact_quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 1.0}, 50)))
    assert np.allclose(out["g"], np.quantile(values, [0.1, 0.5, 1.0]))
    assert out["one"] == (4.0, 4.0, 4.0)
    overall = quantiles.exact_quantiles(df.where("g = 'g'"), [], "v", {"m": 0.5})
    assert np.isclose(rows(overall)[0][0], np.median(values))


def test_exact_quantiles_of_small_groups(spark):
    data = [(n, float(i * i)) for n in (1, 2, 3, 7, 600, 675) for i in range(n)]
    probs = {"a": 0.1, "b": 0.25, "c": 0.333, "z": 0.9}
    out = dict((r[0], r[1:]) for r in rows(quantiles.exact_quantiles(spark.createDataFrame(data, "g long, v double"), ["g"], "v", probs)))
    for n in (1, 2, 3, 7, 600, 675):
        assert np.allclose(out[n], np.quantile(np.arange(n) ** 2.0, list(probs.values())))


def test_exact_quantiles_of_brackets_beyond_the_bound(spark, monkeypatch):
    """One group with a thousand times as many different values as may be ordered, skewed over many magnitudes."""
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 20)
    monkeypatch.setattr(quantiles, "SLICES", 8)
    rng = np.random.default_rng(2)
    values = np.r_[np.exp(rng.normal(size=20_000) * 40), np.full(500, 1.0)]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", float(v)) for v in range(7)], "g string, v double")
    probs = {"a": 0.0, "b": 0.013, "m": 0.5, "x": 0.777, "z": 1.0}
    out = dict((r[0], r[1:]) for r in rows(quantiles.exact_quantiles(df, ["g"], "v", probs, 4)))
    assert np.allclose(out["g"], np.quantile(values, list(probs.values())), rtol=1e-12)
    assert np.allclose(out["h"], np.quantile(np.arange(7.0), list(probs.values())))


def test_status_counts_null_not_zero(spark):
    df = spark.createDataFrame([("s", 1, "yes"), ("s", 1, "yes"), ("s", 2, "no"), ("t", 3, None)], "g string, id int, f string")
    out = grouping.status_counts(df, ["g"], "id", {"n": F.col("f") == "yes"})
    assert rows(out, "g") == [("s", 1), ("t", None)]


def test_set_regions(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("y", "a"), ("z", None)], "e string, g string")
    out = grouping.set_regions(df.withColumn("k", F.lit(1)), ["k"], "e", "g")
    assert rows(out.select("region", "n"), "region") == [("a", 1), ("a,b", 1)]


def test_kth_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "g string, d int")
    assert rows(grouping.kth_row(df, ["g"], [F.col("d")], 2)) == [("a", 5)]


def test_pairs_wide_and_back(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 3.0)], "id_a string, id_b string, d double")
    wide = reshape.pairs_to_wide(pairs, ["a", "b", "c"], "d")
    assert rows(wide, "id_a")[0] == ("a", 0.0, 1.0, 2.0)
    assert rows(reshape.wide_to_pairs(wide, "id_a", "d"), "id_a", "id_b") == rows(pairs, "id_a", "id_b")


def test_roll_up_keeps_levels_apart(spark):
    df = spark.createDataFrame([("s", "x", "g", 1), ("s", "y", "g", 2)], "sample string, f string, genus string, n int")
    out = reshape.roll_up(df, ["sample"], ["f", "genus"], {"n": F.sum("n")})
    assert rows(out, "level", "taxon") == [("s", "f", "x", 1), ("s", "f", "y", 2), ("s", "genus", "g", 3)]


def test_union_and_stack(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    assert reshape.union_distinct([a, a]).count() == 2
    stacked = reshape.stack_tagged({"p": a, "q": a.withColumn("y", F.lit(5))}, "tag")
    assert stacked.count() == 4 and set(stacked.columns) == {"x", "tag", "y"}
