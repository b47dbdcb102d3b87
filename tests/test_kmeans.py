"""All restarts of k-means in the same passes."""

import numpy as np
import pytest

from quadrat.operators import ordination


def cost(x, of):
    return sum(((x[of == c] - x[of == c].mean(axis=0)) ** 2).sum() for c in np.unique(of))


@pytest.mark.parametrize("k", [2, 4])
def test_kmeans_finds_the_best_partition(spark, k):
    rng = np.random.default_rng(k)
    middle = np.array([[0, 0], [6, 0], [0, 6], [6, 6]])[:k]
    of = rng.integers(0, k, 120)
    x = middle[of] + rng.normal(size=(120, 2))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("kmeans", "")
    out = ordination.kmeans(spark.createDataFrame(rows + rows[:5], "id long, a double, b double"), ["a", "b"], k=k)
    assert len(jobs.getJobIdsForGroup("kmeans")) < 200  # not some dozens for each of the 100 restarts
    got = {r["id"]: r["cluster"] for r in out.collect()}
    assert out.count() == 125 and out.columns == ["id", "a", "b", "cluster"]
    assert cost(x, np.array([got[i] for i in range(120)])) <= cost(x, of) * 1.001 and len(set(got.values())) == k


def test_kmeans_of_odd_points(spark):
    same = spark.createDataFrame([(i, 1.0) for i in range(4)], "id long, a double")
    assert len({r["cluster"] for r in ordination.kmeans(same, ["a"], k=2, restarts=3).collect()}) == 1
    assert ordination.kmeans(same.where("id > 9"), ["a"], k=2, restarts=3).count() == 0
    with pytest.raises(ValueError, match="no place"):
        ordination.kmeans(spark.createDataFrame([(1, None)], "id long, a double"), ["a"])
