import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrat.functions.special import geodesic, log_gamma
from quadrat.operators import composition, diversity, pairs, resample
from tests.conftest import rows

COUNTS = {
    "s1": {"a": 10, "b": 5, "c": 1, "d": 2},
    "s2": {"a": 1, "b": 1, "e": 20},
    "s3": {"f": 7},
    "s4": {"a": 10, "b": 5, "c": 1, "d": 2},
    "s5": {"a": 300, "b": 41, "c": 1, "d": 1, "e": 2, "f": 55},
}


@pytest.fixture(scope="module")
def cells(spark):
    data = [(s, f, n) for s, row in COUNTS.items() for f, n in row.items()] + [("s1", "zero", 0)]
    return spark.createDataFrame(data, "sample string, feature string, reads long").persist()


def test_drop_empty(cells):
    assert "zero" not in {r[0] for r in composition.drop_empty(cells, "feature", "reads").select("feature").collect()}


def test_prevalence_filter_uses_strict_bound(cells):
    kept = composition.prevalence_filter(cells, "feature", "reads", 3, 0.95)
    assert {r[0] for r in kept.select("feature").distinct().collect()} == {"a", "b"}


def test_alpha_by_hand(cells):
    out = {r["sample"]: r for r in diversity.alpha(cells, ["sample"], "reads").collect()}
    for s, row in COUNTS.items():
        x = np.array(list(row.values()), float)
        p = x / x.sum()
        f1, f2 = (x == 1).sum(), (x == 2).sum()
        assert out[s]["richness"] == len(x)
        assert math.isclose(out[s]["chao1"], len(x) + f1 * (f1 - 1) / (2 * (f2 + 1)))
        assert math.isclose(out[s]["shannon"], -(p * np.log(p)).sum(), abs_tol=1e-12)
        assert math.isclose(out[s]["simpson"], 1 - (p * p).sum(), abs_tol=1e-12)
    assert out["s3"]["evenness"] is None


def test_rarefaction_curve_equals_combinatorics(cells):
    out = composition.rarefaction_curve(cells, "sample", "reads", 7)
    got = {(r["sample"], r["depth"]): r["expected"] for r in out.collect()}
    for s, row in COUNTS.items():
        total = sum(row.values())
        for n in sorted({*range(1, total + 1, 7), total}):
            want = sum(1 - math.comb(total - k, n) / math.comb(total, n) for k in row.values())
            assert math.isclose(got.pop((s, n)), want, rel_tol=1e-9)
    assert not got


def test_log_gamma(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1.5, 2, 10, 1e3, 1e6)], "x double")
    for x, g in rows(df.select("x", log_gamma(F.col("x")))):
        assert math.isclose(g, math.lgamma(x), rel_tol=1e-10, abs_tol=1e-9)


@pytest.mark.parametrize("method", ["rarefy", "rarefy_draw"])
def test_rarefied_totals_and_bounds(cells, method):
    drawn = getattr(resample, method)(cells, "sample", "feature", "reads", F.lit(18), 40, seed=3)
    got = drawn.collect()
    totals = {}
    for r in got:
        totals[r["iter"], r["sample"]] = totals.get((r["iter"], r["sample"]), 0) + r["reads"]
        assert 0 < r["reads"] <= COUNTS[r["sample"]][r["feature"]]
    assert set(totals.values()) == {18}
    # s3 has 7 reads and drops out; s1 and s4 have exactly 18 and stay as they are
    assert {s for _, s in totals} == {"s1", "s2", "s4", "s5"}
    assert {(r["feature"], r["reads"]) for r in got if r["sample"] == "s1"} == set(COUNTS["s1"].items())
    mean = np.mean([r["reads"] for r in got if r["sample"] == "s5" and r["feature"] == "a"])
    assert abs(mean - 18 * 0.75) < 1.5
    assert sorted(map(tuple, got)) == sorted(map(tuple, drawn.repartition(7).collect()))


def test_draw_in_small_buckets(cells):
    drawn = resample.rarefy_draw(cells, "sample", "feature", "reads", F.lit(18), 5, seed=3, bucket_features=2)
    totals = drawn.groupBy("iter", "sample").agg(F.sum("reads").alias("n"))
    assert totals.where("n <> 18").count() == 0 and totals.count() == 20


def test_replicate_mean_counts_missing_draws(spark):
    drawn = spark.createDataFrame([(1, "s", "f", 4), (2, "s", "f", 4), (3, "s", "f", 1)], "iter int, sample string, feature string, reads long")
    assert rows(resample.replicate_mean(drawn, "sample", "feature", "reads", 4))[0][2] == 9 / 4
    assert rows(resample.replicate_mean(drawn, "sample", "feature", "reads", 4, distinct_values=True))[0][2] == 5 / 3


def brute(kind):
    out = {}
    for a, b in itertools.combinations(sorted(COUNTS), 2):
        x, y = COUNTS[a], COUNTS[b]
        if kind == "bray":
            shared = sum(min(x.get(f, 0), y.get(f, 0)) for f in x)
            out[a, b] = 1 - 2 * shared / (sum(x.values()) + sum(y.values()))
        else:
            out[a, b] = 1 - len(set(x) & set(y)) / len(set(x) | set(y))
    return out


@pytest.mark.parametrize("kind", ["bray", "jaccard"])
@pytest.mark.parametrize("chunk", [1, 4096])
@pytest.mark.parametrize("block", [2, 256])
def test_community_distance(cells, monkeypatch, kind, chunk, block):
    monkeypatch.setattr(pairs, "BLOCK_SAMPLES", block)
    monkeypatch.setattr(pairs, "FEATURE_CHUNK", chunk)
    out = pairs.community_distance(cells, "sample", "feature", "reads", kind)
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in out.collect()}
    want = brute(kind)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert got["s1", "s4"] == pytest.approx(0) and got["s1", "s3"] == 1


@pytest.mark.parametrize("chunk", [7, 4096])
def test_replicated_distance_is_a_mean(spark, monkeypatch, chunk):
    """Many replicates and a sample with far more features than a chunk; a sample missing in a replicate takes no part in it."""
    monkeypatch.setattr(pairs, "FEATURE_CHUNK", chunk)
    monkeypatch.setattr(pairs, "BLOCK_SAMPLES", 3)
    rng = np.random.default_rng(9)
    samples, features, draws = 7, 60, 9
    counts = rng.integers(0, 4, (draws, samples, features)) * (rng.random((draws, samples, features)) < 0.3)
    counts[:, 0] = 1
    counts[3, 2] = 0
    rows = [(int(k), f"s{i}", int(j), int(counts[k, i, j])) for k, i, j in zip(*np.nonzero(counts), strict=True)]
    out = pairs.community_distance(spark.createDataFrame(rows, "it int, s string, f long, n long"), "s", "f", "n", "bray", replicate="it")
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in out.collect()}
    assert len(got) == samples * (samples - 1) // 2
    for a, b in itertools.combinations(range(samples), 2):
        each = [1 - 2 * np.minimum(c[a], c[b]).sum() / (c[a].sum() + c[b].sum()) for c in counts if c[a].sum() and c[b].sum()]
        assert got[f"s{a}", f"s{b}"] == pytest.approx(np.mean(each))


def test_all_pairs_once(spark):
    df = spark.range(60).withColumn("v", F.col("id") * 2)
    out = pairs.all_pairs(df, "id", ["v"], block_rows=7)
    assert out.count() == 60 * 59 // 2 and out.distinct().count() == 60 * 59 // 2
    assert out.where("id_a >= id_b or v_a <> 2 * id_a or v_b <> 2 * id_b").count() == 0


def test_geodesic_published_line(spark):
    # one degree along the equator and along a meridian have published WGS84 lengths
    df = spark.createDataFrame(
        [(0.0, 0.0, 0.0, 1.0), (5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 1.0, 0.0), (10.0, 179.5, 10.0, -179.5)], "a double, b double, c double, d double"
    )
    got = [r[0] for r in rows(df.select(geodesic("a", "b", "c", "d")))]
    assert got[0] == pytest.approx(111319.491, abs=1e-3)
    assert got[1] == 0
    assert got[2] == pytest.approx(110574.389, abs=1e-3)
    assert got[3] == pytest.approx(109639.3, abs=0.1)


def test_labels(spark):
    data = [("a12_mul1806",), ("dogsample1_mul1806",), ("water2_cou1805",), ("x0001_mul1806",), ("e7_mul1806",)]
    out = composition.decode_labels(spark.createDataFrame(data, "l string"), "l")
    got = {r["l"]: (r["entity"], r["control_type"]) for r in out.collect()}
    assert got["a12_mul1806"] == ("a12", None)
    assert got["dogsample1_mul1806"] == (None, "dogsample")
    assert got["water2_cou1805"] == (None, "water")
    assert got["x0001_mul1806"] == (None, "cloacal")


def test_group_means_count_absent_samples(spark, cells):
    members = spark.createDataFrame([("s1", "x"), ("s2", "x"), ("s3", "y")], "sample string, grp string")
    out = composition.group_means(cells, members, "sample", "feature", "grp", "reads")
    got = {(r["feature"], r["grp"]): (r["mean"], r["fidelity"]) for r in out.collect()}
    assert got["c", "x"] == (0.5, 0.5) and got["f", "y"] == (7.0, 1.0) and got["zero", "x"] == (0.0, 0.0)


def test_draw_of_any_size():
    rng = np.random.default_rng(2)
    counts = np.array([3 * 10**12, 10**12, 0, 5, 2 * 10**12])
    for take in (0, 7, 2_500_000, int(counts.sum()) - 9):
        got = resample.draw_counts(rng.random((5, 3)), counts, np.full(3, take))
        assert (got.sum(axis=0) == take).all() and (got <= counts[:, None]).all() and (got >= 0).all()
    share = resample.draw_counts(rng.random((5, 1)), counts, np.array([2_500_000]))[:, 0] / 2_500_000
    assert np.abs(share - counts / counts.sum()).max() < 0.003


def test_hypergeometric_inverts_the_distribution():
    """Against exact sums of binomials, at every number where the distribution steps."""
    for total, good, take in ((10, 4, 5), (30, 29, 7), (50, 1, 50), (400, 180, 150), (7, 0, 3), (5, 5, 2), (9, 3, 0)):
        low, high = max(0, take - total + good), min(good, take)
        chances = [math.comb(good, x) * math.comb(total - good, take - x) / math.comb(total, take) for x in range(low, high + 1)]
        upto = np.cumsum(chances)
        for x, (top, chance) in enumerate(zip(upto, chances, strict=True)):
            if chance > 1e-9:
                u = np.array([top - chance * 0.999, top - chance * 0.5, top - chance * 0.001])
                full = [np.full(3, v) for v in (total, good, take)]
                assert (resample.hypergeometric(u, *full) == low + x).all()


def test_draws_have_the_means_and_spreads_of_the_distribution(spark):
    counts = [40, 25, 3, 1, 31]
    cells = spark.createDataFrame([("s", f"f{i}", n) for i, n in enumerate(counts)], "sample string, feature string, reads long")
    for size in (2, 1000):
        drawn = resample.rarefy_draw(cells, "sample", "feature", "reads", F.lit(30), 800, seed=5, bucket_features=size)
        got = {r["feature"]: r for r in drawn.groupBy("feature").agg(F.sum("reads").alias("n"), F.sum(F.col("reads") * F.col("reads")).alias("nn")).collect()}
        for i, n in enumerate(counts):
            mean, p = 30 * n / 100, n / 100
            var = 30 * p * (1 - p) * 70 / 99
            assert abs(got[f"f{i}"]["n"] / 800 - mean) < 5 * (var / 800) ** 0.5
            assert got[f"f{i}"]["nn"] / 800 - (got[f"f{i}"]["n"] / 800) ** 2 == pytest.approx(var, rel=0.25)


def test_geodesic_of_far_points():
    series = lambda *v: pd.Series(v, dtype=float)
    far = geodesic.func(series(0, 0, 90, 30), series(0, 0, 0, 0), series(0.5, 0, -90, -30), series(179.7, 180, 0, 180))
    assert far.astype(float).to_numpy() == pytest.approx([19944127.421, 20003931.4586, 20003931.4586, 20003931.4586], abs=1e-3)
