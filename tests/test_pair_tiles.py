"""Steps that take what they need from the tiles of pairs give what they give on the table of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import inference, ordination, pairs, permutation, quantiles, resample


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(2)
    data = [(i, f"f{j:02d}", float(rng.integers(1, 5))) for i in range(23) for j in range(40) if rng.random() < 0.4]
    data += [(None, "f00", 2.0)]  # a sample without a name is in no pair
    members = [(i, "abc"[i % 3] if i % 7 else None, float(i)) for i in range(25) if i != 4] + [(None, "a", 0.0)]
    return spark.createDataFrame(data, "s long, f string, n double").persist(), spark.createDataFrame(members, "s long, g string, x double").persist()


@pytest.fixture(params=[4, 256])
def tiles(request, counts, monkeypatch):
    """Pairs that fail when they are made a table, and their table."""
    monkeypatch.setattr(pairs, "BLOCK_SAMPLES", request.param)
    monkeypatch.setattr(pairs, "MOST_SAMPLES", request.param)
    monkeypatch.setattr(pairs, "FEATURE_CHUNK", 11)
    table = pairs.community_distance(counts[0], "s", "f", "n").localCheckpoint()
    made = pairs.CommunityPairs(counts[0], "s", "f", "n")
    return made, table, counts[1]


def _same(one, two, key):
    columns = sorted(one.columns, key=lambda c: (c not in key, c))
    one, two = (sorted((tuple(r) for r in x.select(columns).collect()), key=str) for x in (one, two))
    assert len(one) == len(two)
    for a, b in zip(one, two, strict=True):
        assert all(x == y if x is None or y is None or isinstance(x, str) else x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b, strict=True))


def test_permanova_needs_no_table(tiles, monkeypatch):
    made, table, members = tiles
    want = permutation.permanova_statistics(table, members, "s", "g", "distance", 19, 3).select("perm", "ss_total", "ss_within", "f")
    monkeypatch.setattr(pairs.CommunityPairs, "table", None)
    got = permutation.permanova_statistics(made, members, "s", "g", "distance", 19, 3).select("perm", "ss_total", "ss_within", "f")
    _same(got, want, ["perm"])


def test_dispersion_needs_no_table(tiles, monkeypatch):
    made, table, members = tiles
    want = inference.centroid_distances(table, members, "s", "g", "distance")
    monkeypatch.setattr(pairs.CommunityPairs, "table", None)
    _same(inference.centroid_distances(made, members, "s", "g", "distance"), want, ["s"])


def test_group_tests_need_no_table(tiles, monkeypatch):
    made, table, members = tiles
    compared = {"all": (members, "g"), "some": (members.where("s < 15"), "g")}
    want = permutation.group_tests({"bray": table}, compared, "s", "distance", 19, 3)
    monkeypatch.setattr(pairs.CommunityPairs, "table", None)
    _same(permutation.group_tests({"bray": made}, compared, "s", "distance", 19, 3), want, ["comparison"])


def test_gower_in_tiles(tiles):
    made, table, members = tiles
    want = ordination.gower_center(table.withColumn("root", F.sqrt("distance")), members, "s", "root")
    _same(ordination.gower_center(made.root(), members, "s", "root"), want, ["id_a", "id_b"])


@pytest.mark.filterwarnings("ignore:principal")
def test_principal_coordinates_need_no_table(tiles, monkeypatch):
    made, table, members = tiles
    want, values, share = ordination.pcoa(table.withColumn("root", F.sqrt("distance")), members, "s", "root", rounds=3, tolerance=0.0)
    monkeypatch.setattr(pairs.CommunityPairs, "table", None)
    got, found, part = ordination.pcoa(made.root(), members, "s", "root", rounds=3, tolerance=0.0)
    assert found == pytest.approx(values) and part == pytest.approx(share)
    a, b = (x.toPandas().set_index("s").sort_index() for x in (got, want))
    assert list(a.index) == list(b.index)
    assert np.abs(a.to_numpy()) == pytest.approx(np.abs(b.to_numpy()), abs=1e-6)


def test_packed_tiles_are_exact():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 9, (7, 5)) / 7, rng.random((300, 300))):
        assert (ordination._unpacked(ordination._packed(values), len(values)) == values).all()


def test_about_is_an_inner_join(tiles, spark):
    made, table, _ = tiles
    about = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (9, "z"), (99, "w"), (None, "n")], "s long, l string")
    ends = [about.select(F.col("s").alias(f"id_{e}"), F.col("l").alias(f"l_{e}")) for e in "ab"]
    want = table.join(ends[0], "id_a").join(ends[1], "id_b")
    _same(made.table(about=about, key="s"), want.select("id_a", "id_b", "distance", "l_a", "l_b"), ["id_a", "id_b"])


def test_levels_equal_smaller_counts():
    rng = np.random.default_rng(4)
    for most, step in ((3, 1), (40, 1), (4, 0.5)):
        a, b = (rng.integers(0, most, (n, 30)) * step for n in (6, 9))
        assert pairs._shared(a, b, "bray") == pytest.approx(np.minimum(a[:, None], b).sum(axis=2))
    for f, v in ((rng.integers(0, 70_000, 50), rng.integers(1, 300, 50)), (rng.integers(0, 9, 50), rng.random(50)), (np.arange(50), np.ones(50))):
        s = np.sort(rng.integers(2, 8, 50))
        got = pairs._decoded(pairs._encoded(s, f, v.astype(float)))
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(s.tolist(), f.tolist(), v.astype(float).tolist()))


def test_packed_permutations_are_the_same(spark):
    members = spark.createDataFrame([(f"k{i}", i) for i in range(37)] + [(None, 99)], "k string, v int")
    want = {(r["perm"], r["k"]): r["v"] for r in resample.permutations(members, "k", ["v"], 9, 5).collect()}
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(table, perms, to):
        v, k = table.column("v").to_numpy(), table.column("k").to_pylist()
        rows = [(int(p), k[i], int(v[to[n, i]])) for n, p in enumerate(perms) for i in range(len(k))]
        return pa.table({"perm": pa.array([r[0] for r in rows], pa.int32()), "k": [r[1] for r in rows], "v": pa.array([r[2] for r in rows], pa.int32())})

    schema = T.StructType([T.StructField("perm", T.IntegerType()), T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    got = resample.permuted_chunks(resample.numbered_rows(members, "k"), "k", ["k", "v"], 9, 4, 5, run, schema).collect()
    assert {(r["perm"], r["k"]): r["v"] for r in got} == want


def test_quantiles_of_counted_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 20)
    monkeypatch.setattr(quantiles, "SLICES", 8)
    rng = np.random.default_rng(3)
    data = [(g, float(v), int(w)) for g in "ab" for v, w in zip(rng.integers(0, 90, 200), rng.integers(1, 6, 200), strict=True)]
    out = quantiles.exact_quantiles(spark.createDataFrame(data, "g string, v double, w long"), ["g"], "v", {"m": 0.5, "q": 0.9}, weight="w")
    got = {r["g"]: (r["m"], r["q"]) for r in out.collect()}
    for g in "ab":
        every = np.repeat([v for k, v, _ in data if k == g], [w for k, _, w in data if k == g])
        assert got[g] == pytest.approx(tuple(np.quantile(every, [0.5, 0.9])))
