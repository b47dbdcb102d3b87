"""Permuted designs sent as row numbers give what they give as a table."""

import numpy as np
import pytest
from pyspark.sql import types as T

from quadrat.operators import permuted


@pytest.mark.parametrize("observed", [False, True])
@pytest.mark.parametrize("blocks", [(2048, 1024, 4_000_000), (4, 5, 60)])
def test_products_of_shuffled_designs(spark, monkeypatch, observed, blocks):
    for name, size in zip(("BLOCK_SAMPLES", "BLOCK_FEATURES", "CHUNK_VALUES"), blocks, strict=True):
        monkeypatch.setattr(permuted, name, size)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, float(v), float(w)) for i, (v, w) in enumerate(rng.normal(size=(11, 2)))], "id long, a double, b double")
    cells = spark.createDataFrame([(i, f"f{j}", float(rng.normal())) for i in range(12) for j in range(9) if rng.random() < 0.6], "id long, f string, v double")
    schema = T.StructType([T.StructField("perm", T.IntegerType()), T.StructField("f", T.StringType()), T.StructField("x", T.DoubleType())])

    def finish(taxa, sums, seen, perms):
        import pandas as pd

        return pd.DataFrame([(int(p), f, sums[0, i, k] + 10 * sums[1, i, k]) for i, f in enumerate(taxa) for k, p in enumerate(perms)], columns=["perm", "f", "x"]).astype({"perm": "int32"})

    designs = permuted.Shuffled(rows, 40, 3)
    got, want = ({(r["perm"], r["f"]): r["x"] for r in permuted.products(cells, "id", "f", "v", d, ["a", "b"], finish, schema, observed).collect()} for d in (designs, designs.table("id", ["a", "b"])))
    assert got.keys() == want.keys() and len(got) == 41 * 9
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_redundancy_makes_no_table_of_permutations(spark, monkeypatch):
    from quadrat.operators import permutation

    rng = np.random.default_rng(6)
    members = spark.createDataFrame([(i, float(i % 2), float(rng.normal())) for i in range(12)], "id long, g double, x double")
    cells = spark.createDataFrame([(i, f"f{j}", float(rng.random())) for i in range(12) for j in range(5)], "id long, f string, v double")
    monkeypatch.setattr(permuted, "permutations", None)
    monkeypatch.setattr(permutation, "permutations", None)
    assert permutation.redundancy(cells, members, "id", "f", "v", ["g", "x"], 9).count() == 3
    assert permutation.axis_tests(cells, members, "id", "f", "v", ["g", "x"], 9).count() == 2


def test_axes_of_repeated_samples(spark):
    """Samples that repeat go through a table of permutations; the statistics of the table itself are the same."""
    from quadrat.operators import permutation

    rng = np.random.default_rng(7)
    rows = [(i, float(i % 2), float(rng.normal())) for i in range(12)]
    cells = spark.createDataFrame([(i, f"f{j}", float(rng.random())) for i in range(12) for j in range(5)], "id long, f string, v double")
    members = spark.createDataFrame(rows, "id long, g double, x double")
    (one, two) = (permutation.axis_tests(cells, m, "id", "f", "v", ["g", "x"], 9).orderBy("axis").collect() for m in (members, members.unionByName(members.where("id = 3"))))
    assert [r["axis"] for r in one] == [r["axis"] for r in two] == [1, 2]
    designs = permuted.Shuffled(members, 9, 1)
    assert designs.packable("id") and not permuted.Shuffled(members.unionByName(members), 9, 1).packable("id")
