import datetime as dt

from pyspark.sql import functions as F

from quadrat.functions import names, scalars
from quadrat.sources.tables import read_csv, require_columns, write_csv
from tests.conftest import rows


def test_clean_names():
    assert names.snake_case("Master.Number") == "master_number"
    assert names.snake_case("hostSpecies") == "host_species"
    assert names.snake_case("2nd count") == "x2nd_count"
    assert names.snake_case("..") == "x"


def test_clean_names_makes_duplicates_unique(spark):
    df = spark.createDataFrame([(1, 2)], ["A b", "a.b"])
    assert names.clean_names(df).columns == ["a_b", "a_b_2"]


def test_if_else_keeps_null(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    out = df.select(scalars.if_else(F.col("x") > 2, F.lit("yes"), F.lit("no")).alias("f"), scalars.yes_no(F.col("x") > 2).alias("g"))
    assert rows(out) == [("no", "no"), ("yes", "yes"), (None, "no")]


def test_rules_first_match_wins(spark):
    df = spark.createDataFrame([("no ladder",), ("need ladder",), (None,)], "t string")
    rules = [("equals", "need ladder", "yes"), ("regex", "(?i)LADDER", "no")]
    assert rows(df.select(scalars.text_rules(F.col("t"), rules, "yes"))) == [("no",), ("yes",), ("yes",)]


def test_recode_and_null_tokens(spark):
    df = spark.createDataFrame([("n/a",), ("bo",), ("keep",), (None,)], "t string")
    out = df.select(scalars.recode(F.col("t"), {"bo": "no", "n/a": None}), scalars.null_tokens(F.col("t")))
    assert rows(out) == [(None, None), ("no", "bo"), ("keep", "keep"), (None, None)]


def test_replace_first_only(spark):
    df = spark.createDataFrame([("a_b_c",), ("abc",)], "t string")
    assert rows(df.select(scalars.replace_first(F.col("t"), "_", " "))) == [("a b_c",), ("abc",)]


def test_unite_and_notes(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("", "n")], "x string, y string")
    out = df.select(
        scalars.unite([F.col("x"), F.col("y")], "-"),
        scalars.unite([F.col("x"), F.col("y")], ", ", skip_null=True),
        scalars.join_notes(F.col("x"), F.col("y")),
    )
    assert rows(out) == [("a-NA", "a", "a"), ("NA-NA", "", None), ("-n", ", n", "n")]


def test_packed_date_and_time(spark):
    df = spark.createDataFrame([(523, "1899-12-31 09:05:00"), (631, "7:5"), (None, None)], "p int, t string")
    out = df.select(scalars.packed_date(F.col("p"), 2022), scalars.clock_time(F.col("t")))
    assert rows(out) == [(dt.date(2022, 5, 23), "09:05"), (None, None), (None, None)]


def test_day_of_year_round_trip(spark):
    df = spark.createDataFrame([(dt.date(2022, 12, 31),), (dt.date(2022, 1, 1),)], "d date")
    assert rows(df.select(scalars.date_of_day(F.dayofyear("d"), 2022))) == rows(df)


def test_strict_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, x int")
    assert rows(df.groupBy("g").agg(scalars.strict_sum(F.col("x")).alias("s")), "g") == [("a", None), ("b", 2)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,1", None, 'say "x"'), ("b", 2, None)], "nest string, n int, note string")
    path = str(tmp_path / "t")
    write_csv(df, path)
    back = read_csv(spark, path, "nest string, n int, note string")
    assert rows(back, "nest") == rows(df, "nest")
    assert dict(read_csv(spark, path).dtypes)["n"] == "int"


def test_require_columns(spark):
    import pytest

    with pytest.raises(ValueError):
        require_columns(spark.range(1), "missing")


def test_across_and_pick(spark):
    df = spark.createDataFrame([(2.5, 3.5, "x")], ["a", "b", "c"])
    out = names.across(df, ["a", "b"], lambda c: F.bround(c, 0))
    assert rows(out) == [(2.0, 4.0, "x")]
    assert names.pick(df, "c", between=("a", "b"), drop=["a"]).columns == ["c", "b"]
    assert names.suffix_columns(df, "_compared", keep=["c"]).columns == ["a_compared", "b_compared", "c"]
