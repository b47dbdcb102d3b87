import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions.tails import f_upper, shapiro, t_two_sided
from quadrat.operators import correlation, inference, mantel, ordination, permutation, permuted, resample
from tests.conftest import rows


def test_published_critical_values():
    assert t_two_sided([2.228, 12.706, 1.960], [10, 1, 1e7]) == pytest.approx([0.05, 0.05, 0.05], abs=2e-4)
    assert f_upper([4.965, 3.098, 161.45], [1, 3, 1], [10, 20, 1]) == pytest.approx([0.05] * 3, abs=2e-4)
    assert f_upper([0.0], [2], [5]) == pytest.approx([1.0])


def test_shapiro_published_example():
    # men's weights, the example of the original paper: W = 0.79, p < 0.01
    w, p = shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=5e-4)
    assert math.isnan(shapiro(np.array([1.0, 1.0, 1.0]))[0])


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(4)
    data = []
    for m, shift in (("p", 0.0), ("q", 2.0)):
        for g, n in (("a", 9), ("b", 14)):
            for _ in range(n):
                x = float(rng.normal())
                data.append((m, g, x, float(1.5 * x + (shift if g == "b" else 0) + rng.normal())))
    return spark.createDataFrame(data, "m string, g string, x double, y double").persist()


def columns(values, m):
    pdf = values.where(F.col("m") == m).toPandas()
    return pdf["g"].to_numpy() == "b", pdf["x"].to_numpy(), pdf["y"].to_numpy()


def rss(design, y):
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    return float(((y - design @ beta) ** 2).sum())


def test_two_group_tests(values):
    out = {r["m"]: r for r in inference.t_pooled(values, ["m"], "g", "y", ("a", "b")).collect()}
    ratio = {r["m"]: r for r in inference.variance_ratio(values, ["m"], "g", "y", ("a", "b")).collect()}
    for m in "pq":
        g, _, y = columns(values, m)
        a, b = y[~g], y[g]
        pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(y) - 2)
        assert out[m]["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(pooled * (1 / len(a) + 1 / len(b))))
        assert ratio[m]["f"] == pytest.approx(a.var(ddof=1) / b.var(ddof=1))


def test_one_way_equals_t_squared(values):
    f = {r["m"]: r for r in inference.one_way(values, ["m"], "g", "y").collect()}
    t = {r["m"]: r for r in inference.t_pooled(values, ["m"], "g", "y", ("a", "b")).collect()}
    for m in "pq":
        assert f[m]["f"] == pytest.approx(t[m]["t"] ** 2) and f[m]["p_value"] == pytest.approx(t[m]["p_value"])
    assert inference.one_way(values, [], "g", "y").count() == 1


def test_ancova_equals_nested_fits(values):
    out = {(r["m"], r["effect"]): r for r in inference.ancova(values, ["m"], "g", "x", "y").collect()}
    for m in "pq":
        g, x, y = columns(values, m)
        one = np.ones_like(x)
        sep = rss(np.c_[one, g, x, g * x], y)
        par, line, mean = rss(np.c_[one, g, x], y), rss(np.c_[one, x], y), rss(np.c_[one, g], y)
        assert out[m, "group"]["ss"] == pytest.approx(line - par)
        assert out[m, "covariate"]["ss"] == pytest.approx(mean - par)
        assert out[m, "group:covariate"]["ss"] == pytest.approx(par - sep)
        assert out[m, "group"]["f"] == pytest.approx((line - par) / (sep / (len(y) - 4)))


def test_linear_model_equals_hat_matrix(values):
    got = inference.linear_model(values, ["m"], "g", "x", "y").where("m = 'q'").toPandas().sort_values("x")
    g, x, y = columns(values, "q")
    design = np.c_[np.ones_like(x), g, x]
    hat = design @ np.linalg.inv(design.T @ design) @ design.T
    r = y - hat @ y
    s = math.sqrt((r**2).sum() / (len(y) - 3))
    order = np.argsort(x)
    assert got["std_resid"].to_numpy() == pytest.approx((r / (s * np.sqrt(1 - np.diag(hat))))[order])


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,), (None,)], "p double")
    got = {r["p"]: r["p_adjusted"] for r in inference.benjamini_hochberg(df, "p").collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.04] == pytest.approx(0.16 / 3) and got[0.5] == 0.5 and got[None] is None


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(30, 3))
    points[15:] += [1.5, 0, 0]
    label = ["a"] * 15 + ["b"] * 15
    members = spark.createDataFrame([(i, g) for i, g in enumerate(label)], "id long, g string").persist()
    data = [(i, j, float(np.linalg.norm(points[i] - points[j]))) for i, j in itertools.combinations(range(30), 2)]
    pairs = spark.createDataFrame(data, "id_a long, id_b long, d double").persist()
    return points, np.array(label), members, pairs


def test_centroid_distances(space):
    points, label, members, pairs = space
    got = {r["id"]: r["z"] for r in inference.centroid_distances(pairs, members, "id", "g", "d").collect()}
    for i, p in enumerate(points):
        assert got[i] == pytest.approx(np.linalg.norm(p - points[label == label[i]].mean(axis=0)))


@pytest.mark.parametrize("block", [8, 256])
def test_permanova(space, monkeypatch, block):
    from quadrat.operators import pairs as tiles

    monkeypatch.setattr(permutation, "BLOCK_SAMPLES", block)
    monkeypatch.setattr(tiles, "BLOCK_SAMPLES", block)
    points, label, members, pairs = space
    out = permutation.permanova(pairs, members, "id", "g", "d", 39, seed=2).collect()
    total = ((points - points.mean(axis=0)) ** 2).sum()
    within = sum(((points[label == g] - points[label == g].mean(axis=0)) ** 2).sum() for g in "ab")
    assert len(out) == 1
    assert out[0]["f"] == pytest.approx((total - within) / (within / 28)) and out[0]["df2"] == 28
    assert out[0]["p_value"] == pytest.approx(1 / 40)


def test_permutations_are_permutations(spark):
    members = spark.range(300).select("id", (F.col("id") * 10).alias("v"))
    out = resample.permutations(members, "id", ["v"], 4, seed=5).toPandas()
    for p, part in out.groupby("perm"):
        assert sorted(part["id"]) == list(range(300)) and sorted(part["v"]) == list(range(0, 3000, 10))
        assert (part["v"] == part["id"] * 10).all() == (p == 0)


def test_pcoa_keeps_distances(space):
    points, _, members, pairs = space
    scores, values, share = ordination.pcoa(pairs, members, "id", "d", axes=3, rounds=40, tolerance=1e-10)
    got = scores.toPandas().set_index("id").sort_index().to_numpy()
    far = np.linalg.norm(got[:, None] - got[None], axis=-1)
    assert far == pytest.approx(np.linalg.norm(points[:, None] - points[None], axis=-1), abs=1e-6)
    assert share == pytest.approx(1.0) and values == sorted(values, reverse=True)


def test_gower_rows_sum_to_zero(space):
    _, _, members, pairs = space
    g = ordination.gower_center(pairs, members, "id", "d")
    both = g.unionByName(g.where("id_a <> id_b").select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "g"))
    assert both.groupBy("id_a").agg(F.sum("g").alias("s")).where("abs(s) > 1e-9").count() == 0


def tau_b(x, y):
    s = nx = ny = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, nx, ny = s + a * b, nx + abs(a), ny + abs(b)
    return s / math.sqrt(nx * ny)


@pytest.mark.parametrize("splits", [1, 6])
def test_kendall_with_ties_and_a_hot_value(spark, splits):
    rng = np.random.default_rng(3)
    data = []
    for k in range(2):
        x = np.where(rng.random(150) < 0.35, 1.0, rng.integers(0, 40, 150) / 10)
        y = np.where(rng.random(150) < 0.3, x, rng.integers(0, 25, 150) / 5)
        data += [(k, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(data, "k int, x double, y double")
    xs, ys = (correlation.split_points(df, c, splits) for c in "xy")
    df = df.withColumns({"p": correlation.bucket("x", xs), "q": correlation.bucket("y", ys)})
    got = dict(rows(correlation.kendall(df, ["k"], "x", "y", "p", "q")))
    for k in range(2):
        part = np.array([(a, b) for i, a, b in data if i == k])
        assert got[k] == pytest.approx(tau_b(part[:, 0], part[:, 1]))


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, 9.0)], "v double")
    got = sorted(r[0] for r in rows(correlation.with_rank(df, "v")))
    assert got == [1.0, 2.0, 3.5, 3.5, 5.0]


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_mantel_of_itself(space, method):
    _, _, members, pairs = space
    out = mantel.mantel(pairs, pairs, members.select("id"), "id", "d", "d", method, 9, seed=1).collect()[0]
    assert out["statistic"] == pytest.approx(1.0) and out["p_value"] == pytest.approx(0.1)


def test_redundancy_equals_projection(spark):
    rng = np.random.default_rng(6)
    n, features = 24, 5
    g, x = (np.arange(n) % 2).astype(float), rng.normal(size=n)
    y = rng.random((n, features)) * (rng.random((n, features)) < 0.7)
    y[:, 0] += g
    members = spark.createDataFrame([(i, float(g[i]), float(x[i]), float(g[i] * x[i])) for i in range(n)], "id long, g double, x double, gx double")
    cells = spark.createDataFrame([(i, f"f{j}", float(y[i, j])) for i in range(n) for j in range(features) if y[i, j]], "id long, f string, v double")
    out = {r["term"]: r for r in permutation.redundancy(cells, members, "id", "f", "v", ["g", "x", "gx"], 19, seed=1).collect()}
    total = ((y - y.mean(axis=0)) ** 2).sum()

    def fit(*columns):
        return total - sum(rss(np.c_[np.ones(n), *columns], y[:, j]) for j in range(features))

    steps = {"g": fit(g), "x": fit(g, x) - fit(g), "gx": fit(g, x, g * x) - fit(g, x), "model": fit(g, x, g * x)}
    for term, ss in steps.items():
        assert out[term]["variance"] == pytest.approx(ss / (n - 1))
    assert out["model"]["f"] == pytest.approx(steps["model"] / 3 / ((total - steps["model"]) / (n - 4)))
    assert all(1 / 20 <= r["p_value"] <= 1 for r in out.values())
    axes = permutation.constrained_axes(cells, members, "id", "f", "v", ["g", "x", "gx"]).collect()
    assert sum(r["eigenvalue"] for r in axes) == pytest.approx(steps["model"] / (n - 1))


def test_indicator_finds_the_planted_feature(spark):
    members = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(20)], "id long, g string")
    data = [(i, "only_a", 5.0) for i in range(10)] + [(i, "both", 2.0) for i in range(20)] + [(3, "rare", 1.0)]
    cells = spark.createDataFrame(data, "id long, f string, v double")
    out = {r["f"]: r for r in permutation.indicator_test(cells, members, "id", "f", "g", "v", ["a", "b"], 39, seed=1).collect()}
    assert out["only_a"]["indicator_for"] == "a" and out["only_a"]["stat"] == pytest.approx(1) and out["only_a"]["p_value"] == pytest.approx(1 / 40)
    assert out["both"]["indicator_for"] is None and out["both"]["p_value"] is None and out["both"]["stat"] == pytest.approx(1)
    assert out["rare"]["stat"] == pytest.approx(math.sqrt(0.1))


def test_hull_in_parts_equals_whole(spark):
    rng = np.random.default_rng(2)
    xy = rng.normal(size=(500, 2))
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "g string, id long, x double, y double")
    got = {r["id"] for r in ordination.group_hull(df, "g", "id", "x", "y", size=8).collect()}
    assert got == set(ordination.hull_points(xy[:, 0], xy[:, 1]).tolist())
    # brute force: a corner has all points on one side of a line to the next corner
    edges = set()
    for i, j in itertools.permutations(sorted(got), 2):
        cross = (xy[j, 0] - xy[i, 0]) * (xy[:, 1] - xy[i, 1]) - (xy[j, 1] - xy[i, 1]) * (xy[:, 0] - xy[i, 0])
        if (cross >= -1e-12).all():
            edges |= {i, j}
    assert edges == got


def test_tails_at_very_many_degrees_of_freedom():
    from quadrat.functions import tails

    for df in (1e6, 1e8, 1e10, 1e12):
        # with one and infinitely many degrees of freedom F is the square of a normal variable
        assert abs(float(tails.f_upper(3.841458820694124, 1, df)) - 0.05) < 1e-6
        assert abs(float(tails.f_upper(2.6049, 3, df)) - 0.05) < 1e-4
        assert abs(float(tails.t_two_sided(1.959963984540054, df)) - 0.05) < 1e-6
    assert abs(float(tails.f_upper(1 / 3.841458820694124, 1e8, 1)) - 0.95) < 1e-6
    # both sides of the switch agree
    a, b = (float(tails.f_upper(2.6049, 3, d)) for d in (0.999e6, 1.001e6))
    assert abs(a - b) < 1e-8


def test_members_without_pairs_stay_out(spark):
    xy = np.random.default_rng(5).normal(size=(9, 2))
    pairs = [(i, j, float(np.hypot(*(xy[i] - xy[j])))) for i in range(9) for j in range(i + 1, 9)]
    pairs = spark.createDataFrame(pairs, "id_a long, id_b long, d double")
    members = spark.createDataFrame([(i,) for i in range(10)], "id long")
    scores, _, share = ordination.pcoa(pairs, members, "id", "d")
    assert {r["id"] for r in scores.collect()} == set(range(9))
    assert share == pytest.approx(1, abs=1e-6)
    lost = pairs.withColumn("d", F.when(F.col("id_a") > 0, F.col("d")))
    with pytest.raises(Exception, match="no distance"):
        ordination.gower_center(lost, members, "id", "d").collect()


def _sign_tau(x, y):
    """tau-b by all pairs."""
    s = sum(np.sign(a - c) * np.sign(b - d) for i, (a, b) in enumerate(zip(x, y)) for c, d in list(zip(x, y))[:i])
    nx, ny = (sum(a != b for i, a in enumerate(v) for b in v[:i]) for v in (x, y))
    return s / (nx * ny) ** 0.5 if nx and ny else None


@pytest.mark.parametrize("ties", [3, 1000])
def test_tau_counts_ties_and_inversions(ties):
    rng = np.random.default_rng(ties)
    for n in (2, 3, 40, 150):
        x, y = rng.integers(0, ties, n), rng.integers(0, ties, n)
        order = np.argsort(x, kind="stable")
        dense = [np.unique(v, return_inverse=True)[1][order] for v in (x, y)]
        got = mantel.tau(*dense)
        assert got == pytest.approx(_sign_tau(x, y)) if got is not None else _sign_tau(x, y) is None
    assert mantel.tau(np.array([0]), np.array([0])) is None


def _pair_rows(rng, n, values, missing):
    return [(i, j, None if rng.random() < missing else float(rng.integers(0, values))) for i in range(n) for j in range(i + 1, n) if rng.random() > missing]


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
@pytest.mark.parametrize("missing", [0.0, 0.2])
@pytest.mark.parametrize("cells", [mantel.STRIP_CELLS, 60])
def test_mantel_equals_brute_force(spark, monkeypatch, method, missing, cells):
    """Each permutation's statistic over the pairs themselves; small strips make several of them."""
    monkeypatch.setattr(mantel, "STRIP_CELLS", cells)
    rng = np.random.default_rng(8)
    n, count = 11, 5
    xs, ys = _pair_rows(rng, n, 9, missing), _pair_rows(rng, n, 7, missing)
    frames = [spark.createDataFrame(r, "id_a long, id_b long, d double") for r in (xs, ys)]
    members = spark.createDataFrame([(i,) for i in range(n)], "id long")
    moved = {}
    for r in resample.permutations(members.selectExpr("id", "id as to"), "id", ["to"], count, 3).collect():
        moved.setdefault(r["perm"], {})[r["id"]] = r["to"]
    got = {r["perm"]: r["statistic"] for r in mantel.statistics(*frames, members, "id", "d", "d", method, count, 3).collect()}
    assert set(got) == set(range(count + 1))

    def ranks(rows):
        known = [v for _, _, v in rows if v is not None]
        return [(i, j, v if v is None else sum(k < v for k in known) + (sum(k == v for k in known) + 1) / 2) for i, j, v in rows]

    if method == "spearman":
        xs, ys = ranks(xs), ranks(ys)
    partner = {frozenset((i, j)): v for i, j, v in ys if v is not None}
    for perm, to in moved.items():
        both = [(v, partner[frozenset((to[i], to[j]))]) for i, j, v in xs if v is not None and frozenset((to[i], to[j])) in partner]
        a, b = np.array(both).T
        want = _sign_tau(a, b) if method == "kendall" else np.corrcoef(a, b)[0, 1]
        assert got[perm] == pytest.approx(want)


def test_mantel_without_pairs(spark):
    none = spark.createDataFrame([], "id_a long, id_b long, d double")
    members = spark.createDataFrame([(i,) for i in range(4)], "id long")
    for method in ("pearson", "kendall"):
        out = mantel.mantel(none, none, members, "id", "d", "d", method, 9).collect()
        assert all(r["statistic"] is None for r in out)


def test_shapiro_of_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=900), "b": rng.exponential(size=4000), "c": np.round(rng.normal(size=300), 1), "same": np.zeros(60)}
    df = spark.createDataFrame([(k, float(v)) for k, values in data.items() for v in values] + [("a", None)], "g string, v double")
    want = {k: shapiro(v)[0] for k, v in data.items()}
    monkeypatch.setattr(inference, "GATHERED", 50)
    out = {r["g"]: r for r in inference.shapiro_wilk(df, ["g"], "v").collect()}
    for k in ("a", "b", "c"):
        assert out[k]["w"] == pytest.approx(want[k], abs=1e-9) and out[k]["p_value"] is None and out[k]["n"] == len(data[k])
    assert out["same"]["w"] is None
    (row,) = inference.shapiro_wilk(df.where("g = 'b'"), [], "v").collect()
    assert row["w"] == pytest.approx(want["b"], abs=1e-9)


def test_shapiro_beyond_the_range_of_the_test(spark):
    values = np.random.default_rng(4).normal(size=6000)
    (row,) = inference.shapiro_wilk(spark.createDataFrame([(float(v),) for v in values], "v double"), [], "v").collect()
    assert 0.999 < row["w"] < 1 and row["p_value"] is None


def _designs(spark, n, count, columns, rng):
    return [(k, i, *(float(v) for v in rng.normal(size=columns))) for k in range(count + 1) for i in range(n)]


@pytest.mark.parametrize("observed", [False, True])
@pytest.mark.parametrize("blocks", [(2048, 1024, 4_000_000), (4, 5, 60)])
def test_products_equal_brute_force(spark, monkeypatch, observed, blocks):
    """One block or many: with the small ones, one block of samples meets many blocks of features and chunks."""
    for name, size in zip(("BLOCK_SAMPLES", "BLOCK_FEATURES", "CHUNK_VALUES"), blocks, strict=True):
        monkeypatch.setattr(permuted, name, size)
    rng = np.random.default_rng(4)
    n, features, count = 11, 23, 40
    y = rng.normal(size=(n, features)) * (rng.random((n, features)) < 0.5)
    y[0] = 1.0
    rows = _designs(spark, n, count, 2, rng)
    designs = spark.createDataFrame(rows, "perm int, id long, a double, b double")
    cells = spark.createDataFrame([(i, f"f{j:02d}", float(y[i, j])) for i in range(n) for j in range(features) if y[i, j]] + [(99, "f00", 5.0)], "id long, f string, v double")
    schema = "f string, perm int, design int, total double, seen double"
    from pyspark.sql.types import _parse_datatype_string

    def finish(taxa, sums, seen, perms):
        import pandas as pd

        out = [(f, int(k), d, sums[d, i, j], seen[d, i, j]) for d in range(2) for i, f in enumerate(taxa) for j, k in enumerate(perms)]
        return pd.DataFrame(out, columns=["f", "perm", "design", "total", "seen"]).astype({"perm": "int32", "design": "int32"})

    got = {}
    for r in permuted.products(cells, "id", "f", "v", designs, ["a", "b"], finish, _parse_datatype_string(schema), observed).collect():
        key = (r["f"], r["perm"], r["design"])
        assert key not in got or r["perm"] == 0
        got[key] = (r["total"], r["seen"])
    x = np.array([r[2:] for r in rows]).reshape(count + 1, n, 2)
    assert len(got) == features * (count + 1) * 2
    for j in range(features):
        for k in range(count + 1):
            for d in range(2):
                want = (y[:, j] @ x[k, :, d], (y[:, j] != 0) @ x[k, :, d])
                assert got[f"f{j:02d}", k, d] == pytest.approx(want)


def test_axis_tests_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    n, features, count = 14, 5, 15
    g, x = (np.arange(n) % 2).astype(float), rng.normal(size=n)
    y = rng.random((n, features)) * (rng.random((n, features)) < 0.7)
    y[:, 0] += g
    members = spark.createDataFrame([(i, float(g[i]), float(x[i]), float(g[i] * x[i])) for i in range(n)], "id long, g double, x double, gx double")
    cells = spark.createDataFrame([(i, f"f{j}", float(y[i, j])) for i in range(n) for j in range(features) if y[i, j]], "id long, f string, v double")
    out = {r["axis"]: r for r in permutation.axis_tests(cells, members, "id", "f", "v", ["g", "x", "gx"], count, seed=1).collect()}
    moved = {}
    for r in resample.permutations(members.selectExpr("id", "id as to"), "id", ["to"], count, 1).collect():
        moved.setdefault(r["perm"], {})[r["id"]] = r["to"]
    yc = y - y.mean(axis=0)
    basis, _ = np.linalg.qr(np.c_[g, x, g * x] - np.c_[g, x, g * x].mean(axis=0))
    left, values, _ = np.linalg.svd(basis.T @ yc)
    scores = basis @ left
    assert [out[a]["eigenvalue"] for a in (1, 2, 3)] == pytest.approx(list(values[:3] ** 2 / (n - 1)))
    for axis in range(3):
        u, w = scores[:, :axis], scores[:, axis:]
        e = yc - u @ (u.T @ yc)
        stats = []
        for k in range(count + 1):
            # sample i gets the design of sample to[i], so row to[i] of the response goes to place i
            back = np.argsort([moved[k][i] for i in range(n)])
            pe = e[back]
            pe = pe - u @ (u.T @ pe)
            fitted = w.T @ pe
            rest = (pe**2).sum() - (fitted**2).sum()
            stats.append(np.linalg.svd(fitted)[1][0] ** 2 / (rest / (n - 1 - 3)))
        assert out[axis + 1]["f"] == pytest.approx(stats[0])
        assert out[axis + 1]["p_value"] == pytest.approx((1 + sum(s >= stats[0] - 1e-9 for s in stats[1:])) / (count + 1))
