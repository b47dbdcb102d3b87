"""Parametric tests for many groups at once, from sufficient statistics.

Each test is one aggregate with map-side partial sums; only its small result is
worked on further.  Variances and covariances use the centred built-in aggregates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.tails import LAST_WEIGHT, NEXT_WEIGHT, f_tail, f_two_sided, normal_quantile, shapiro, t_tail
from quadrat.operators.grouping import with_group
from quadrat.operators.joins import beside
from quadrat.operators.pairs import CommunityPairs
from quadrat.operators.quantiles import with_group_median
from quadrat.operators.rank import number_rows
from quadrat.session import written

def two_groups(df: DataFrame, keys: Iterable[str], group: str, y: str, levels: tuple) -> DataFrame:
    """Size, mean and variance of two groups side by side."""
    first, second = (F.when(F.col(group) == level, F.col(y)) for level in levels)
    return df.groupBy(*keys).agg(
        F.count(first).alias("n1"),
        F.count(second).alias("n2"),
        F.avg(first).alias("mean1"),
        F.avg(second).alias("mean2"),
        F.var_samp(first).alias("var1"),
        F.var_samp(second).alias("var2"),
    )


def variance_ratio(df: DataFrame, keys: Iterable[str], group: str, y: str, levels: tuple) -> DataFrame:
    """F test of equal variances."""
    out = two_groups(df, keys, group, y, levels)
    out = out.withColumns({"f": F.try_divide("var1", "var2"), "df1": F.col("n1") - 1, "df2": F.col("n2") - 1})
    return out.withColumn("p_value", f_two_sided("f", "df1", "df2")).drop("n1", "n2", "mean1", "mean2")


def t_pooled(df: DataFrame, keys: Iterable[str], group: str, y: str, levels: tuple) -> DataFrame:
    """Two-sample t test with a pooled variance."""
    out = two_groups(df, keys, group, y, levels).withColumn("df", F.col("n1") + F.col("n2") - 2)
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / F.col("df")
    error = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    out = out.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), error))
    return out.withColumn("p_value", t_tail("t", "df")).select(*keys, "mean1", "mean2", "t", "df", "p_value")


def one_way(df: DataFrame, keys: Iterable[str], group: str, y: str) -> DataFrame:
    """One-way analysis of variance."""
    by = list(keys)
    groups = df.where(F.col(y).isNotNull()).groupBy(*by, group).agg(
        F.count(y).alias("__n"), F.avg(y).alias("__m"), F.var_pop(y).alias("__v")
    )
    centred = with_group(groups, by, {"__grand": F.sum(F.col("__n") * F.col("__m")) / F.sum("__n")})
    out = centred.groupBy(*by).agg(
        (F.count("*") - 1).alias("df1"),
        (F.sum("__n") - F.count("*")).alias("df2"),
        F.sum(F.col("__n") * F.pow(F.col("__m") - F.col("__grand"), F.lit(2))).alias("ss_between"),
        F.sum(F.col("__n") * F.col("__v")).alias("ss_within"),
    )
    f = F.try_divide(F.try_divide("ss_between", "df1"), F.try_divide("ss_within", "df2"))
    return out.withColumn("f", f).withColumn("p_value", f_tail("f", "df1", "df2"))


def levene(df: DataFrame, keys: Iterable[str], group: str, y: str) -> DataFrame:
    """Levene's test about the group medians."""
    keys = list(keys)
    centred = with_group_median(df.where(F.col(y).isNotNull()), [*keys, group], y, "__median")
    return one_way(centred.withColumn("__dev", F.abs(F.col(y) - F.col("__median"))), keys, group, "__dev")


def _group_moments(df: DataFrame, by: list[str], group: str, x: str, y: str) -> DataFrame:
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull())
    n = F.count(y)
    return complete.groupBy(*by, group).agg(
        n.alias("__n"),
        F.avg(x).alias("__mx"),
        F.avg(y).alias("__my"),
        (F.var_pop(x) * n).alias("__sxx"),
        (F.var_pop(y) * n).alias("__syy"),
        (F.covar_pop(x, y) * n).alias("__sxy"),
    )


def linear_model(df: DataFrame, keys: Iterable[str], group: str, x: str, y: str) -> DataFrame:
    """``y ~ group + x``: fitted value, residual and standardised residual on every row."""
    by = list(keys)
    moments = _group_moments(df, by, group, x, y)
    fit = moments.groupBy(*by).agg(
        F.sum("__sxx").alias("__wxx"),
        F.try_divide(F.sum("__sxy"), F.sum("__sxx")).alias("__slope"),
        (F.sum("__syy") - F.try_divide(F.sum("__sxy") * F.sum("__sxy"), F.sum("__sxx"))).alias("__rss"),
        (F.sum("__n") - F.count("*") - 1).alias("__df"),
    )
    line = beside(moments, fit, by).select(*by, group, "__n", "__mx", "__my", "__wxx", "__slope", "__rss", "__df")
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(line, [*by, group])
    away = F.col(x) - F.col("__mx")
    out = out.withColumn("fitted", F.col("__my") + F.col("__slope") * away).withColumn("resid", F.col(y) - F.col("fitted"))
    leverage = 1 / F.col("__n") + away * away / F.col("__wxx")
    scale = F.sqrt(F.try_divide("__rss", "__df") * (1 - leverage))
    out = out.withColumn("std_resid", F.try_divide(F.col("resid"), scale))
    return out.drop("__n", "__mx", "__my", "__wxx", "__slope", "__rss", "__df")


def outliers(model: DataFrame, beyond: float = 3.0) -> DataFrame:
    """Rows whose standardised residual is larger than ``beyond``."""
    return model.where(F.abs("std_resid") > beyond)


def ancova(df: DataFrame, keys: Iterable[str], group: str, x: str, y: str) -> DataFrame:
    """Type II table of ``y ~ group * x``, one row per effect.

    Residual sums of squares of the nested models all follow from the per-group moments.
    """
    by = list(keys)
    moments = _group_moments(df, by, group, x, y)
    centred = with_group(
        moments,
        by,
        {"__gx": F.sum(F.col("__n") * F.col("__mx")) / F.sum("__n"), "__gy": F.sum(F.col("__n") * F.col("__my")) / F.sum("__n")},
    )
    dx, dy = F.col("__mx") - F.col("__gx"), F.col("__my") - F.col("__gy")
    sums = centred.groupBy(*by).agg(
        F.sum("__n").alias("__n"),
        F.count("*").alias("__k"),
        F.sum("__sxx").alias("__wxx"),
        F.sum("__sxy").alias("__wxy"),
        F.sum("__syy").alias("__wyy"),
        F.sum(F.col("__syy") - F.try_divide(F.col("__sxy") * F.col("__sxy"), F.col("__sxx"))).alias("__separate"),
        F.sum(F.col("__sxx") + F.col("__n") * dx * dx).alias("__txx"),
        F.sum(F.col("__sxy") + F.col("__n") * dx * dy).alias("__txy"),
        F.sum(F.col("__syy") + F.col("__n") * dy * dy).alias("__tyy"),
    )
    col = F.col
    parallel = col("__wyy") - F.try_divide(col("__wxy") * col("__wxy"), col("__wxx"))
    common = col("__tyy") - F.try_divide(col("__txy") * col("__txy"), col("__txx"))
    effects = F.array(
        F.struct(F.lit("group").alias("effect"), (common - parallel).alias("ss"), (col("__k") - 1).alias("dfn")),
        F.struct(F.lit("covariate").alias("effect"), (col("__wyy") - parallel).alias("ss"), F.lit(1).cast("long").alias("dfn")),
        F.struct(F.lit("group:covariate").alias("effect"), (parallel - col("__separate")).alias("ss"), (col("__k") - 1).alias("dfn")),
    )
    out = sums.select(*by, (col("__n") - 2 * col("__k")).alias("dfd"), col("__separate").alias("ss_error"), F.inline(effects))
    f = F.try_divide(F.try_divide("ss", "dfn"), F.try_divide("ss_error", "dfd"))
    out = out.withColumns({"f": f, "ges": F.try_divide(col("ss"), col("ss") + col("ss_error"))})
    return out.withColumn("p_value", f_tail("f", "dfn", "dfd"))


def trend(df: DataFrame, keys: Iterable[str], x: str, y: str) -> DataFrame:
    """Straight line and correlation per group."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def trend_p(out: DataFrame) -> DataFrame:
    """p-value of the correlation of :func:`trend`."""
    t = F.try_divide(F.col("r") * F.sqrt((F.col("n") - 2).cast("double")), F.sqrt(1 - F.col("r") * F.col("r")))
    return out.withColumn("p_value", t_tail(t, F.col("n") - 2))


#: Most values of a group that one task takes; Royston's transformation of W to p is fitted up to there as well.
GATHERED = 5000


def shapiro_wilk(df: DataFrame, keys: Iterable[str], y: str) -> DataFrame:
    """Shapiro-Wilk W and p per group.

    Groups of 3 to 5000 values are tested by one task each.  Of larger ones W comes from row numbers
    and sums, so no task holds a group; their p-value is null, because the approximation of
    W's distribution is fitted to 5000 values and no more.  Fewer than 3 values, or equal ones, give null.
    """
    by = list(keys)
    df = df.where(F.col(y).isNotNull())
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    sized = beside(df.select(*by, y), sizes.select(*by, F.col("n").alias("__n")), by)
    usable = sized.where((F.col("__n") >= 3) & (F.col("__n") <= GATHERED))
    schema = T.StructType(
        [df.schema[k] for k in by] + [T.StructField("w", T.DoubleType()), T.StructField("p_value", T.DoubleType())]
    )

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro(rows[y].to_numpy())
        return pd.DataFrame([[rows[k].iloc[0] for k in by] + [w, p]], columns=[*by, "w", "p_value"])

    tested = usable.select(*by, y).groupBy(*by).applyInPandas(test, schema)
    large = _large_shapiro(sized.where(F.col("__n") > GATHERED), by, y)
    tested = tested.unionByName(large.select(*by, "w", F.lit(None).cast("double").alias("p_value")))
    return sizes.join(tested, by, "left") if by else beside(sizes, tested, [])


def _large_shapiro(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """W from the order statistics: normal scores by row number, weighted sums, the two values at either end."""
    placed = number_rows(df.select(*by, F.col(y).cast("double").alias("__x")), [*by, "__x"], "__r")
    about = placed.groupBy(*by).agg(
        (F.min("__r") - 1).alias("__before"), F.count("*").alias("__n"), F.avg("__x").alias("__m"), F.var_pop("__x").alias("__v")
    )
    place = F.col("__r") - F.col("__before")
    n = F.col("__n")
    scored = beside(placed, about, by).withColumn("__i", place).withColumn("__x", F.col("__x") - F.col("__m"))
    scored = scored.withColumn("__s", normal_quantile((F.col("__i") - 0.375) / (n + 0.25)))
    end = (F.col("__i") <= 2) | (F.col("__i") > n - 2)

    def at(which, column: str, name: str):
        return F.max(F.when(F.col("__i") == which, F.col(column))).alias(name)

    sums = scored.groupBy(*by, "__n", "__v").agg(
        F.sum(F.col("__s") * F.col("__s")).alias("norm"),
        F.sum(F.when(~end, F.col("__s") * F.col("__x"))).alias("middle"),
        at(F.lit(1), "__x", "x1"), at(F.lit(2), "__x", "x2"), at(n - 1, "__x", "y2"), at(n, "__x", "y1"),
        at(n, "__s", "s1"), at(n - 1, "__s", "s2"),
    )
    u = 1 / F.sqrt(n.cast("double"))

    def polynomial(coefficients: list[float]):
        out = F.lit(0.0)
        for c in coefficients:
            out = out * u + c
        return out

    last = polynomial(LAST_WEIGHT) + F.col("s1") / F.sqrt("norm")
    near = polynomial(NEXT_WEIGHT) + F.col("s2") / F.sqrt("norm")
    sums = sums.withColumn("last", last).withColumn("near", near)
    square = lambda c: F.col(c) * F.col(c)
    rest = (F.col("norm") - 2 * square("s1") - 2 * square("s2")) / (1 - 2 * square("last") - 2 * square("near"))
    total = F.col("middle") / F.sqrt(rest) + F.col("last") * (F.col("y1") - F.col("x1")) + F.col("near") * (F.col("y2") - F.col("x2"))
    return sums.select(*by, F.when(F.col("__v") > 0, F.least(total * total / (n * F.col("__v")), F.lit(1.0))).alias("w"))


def benjamini_hochberg(tests: DataFrame, p: str, name: str = "p_adjusted") -> DataFrame:
    """Adjusted p-values for a table of tests.

    Works on distinct p-values with their counts: a permutation test has at most
    one more distinct value than permutations.
    """
    from pyspark.sql import Window as W

    counts = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c")).scalar()
    upto = F.sum("__c").over(W.orderBy(p).rowsBetween(W.unboundedPreceding, W.currentRow))
    raw = counts.withColumn("__raw", F.col(p) * total / upto)
    least = F.min("__raw").over(W.orderBy(p).rowsBetween(W.currentRow, W.unboundedFollowing))
    adjusted = raw.select(p, F.least(least, F.lit(1.0)).alias(name))
    return tests.join(adjusted, p, "left")


def centroid_distances(pairs: DataFrame | CommunityPairs, labels: DataFrame, key: str, group: str, distance: str) -> DataFrame:
    """Distance of every sample to the centroid of its group, from the pair table alone.

    The squared distance to the centroid is the mean squared distance to the members
    less half the mean squared distance within the group.
    """
    sizes = labels.groupBy(group).agg(F.count("*").alias("__n"))
    tagged = labels.select(key, group)
    if isinstance(pairs, CommunityPairs):
        ends = _squares_within(pairs, tagged, key, group)
    else:
        a = tagged.select(F.col(key).alias("id_a"), F.col(group).alias("__ga"))
        b = tagged.select(F.col(key).alias("id_b"), F.col(group).alias("__gb"))
        within = pairs.join(a, "id_a").join(b, "id_b").where("__ga = __gb")
        squared = F.col(distance) * F.col(distance)
        ends = within.select(F.explode(F.array("id_a", "id_b")).alias(key), squared.alias("__d2"))
    rows = ends.groupBy(key).agg(F.sum("__d2").alias("__row"))
    per_sample = tagged.join(rows, key, "left").fillna(0.0, subset=["__row"]).join(sizes, group)
    per_sample = with_group(per_sample, [group], {"__half": F.sum("__row") / 2})
    z2 = F.col("__row") / F.col("__n") - F.col("__half") / (F.col("__n") * F.col("__n"))
    return per_sample.select(key, group, F.sqrt(F.abs(z2)).alias("z"))


def _squares_within(pairs: CommunityPairs, tagged: DataFrame, key: str, group: str) -> DataFrame:
    """``key`` and ``__d2``: of each tile, the sums of every sample's squared distances to members of its group."""

    def sums(tile) -> Iterator[dict]:
        if not tile.about:
            return
        (at_a, one), (at_b, two) = tile.about
        codes = pd.factorize(np.concatenate([t.column(group).to_numpy(zero_copy_only=False) for t in (one, two)]))[0]
        a, b = codes[: len(at_a)], codes[len(at_a) :]
        within = tile.squares()[at_a][:, at_b] * ((a[:, None] == b) & (a >= 0)[:, None])
        yield {key: tile.names[0].take(pa.array(at_a)), "__d2": within.sum(axis=1)}
        yield {key: tile.names[1].take(pa.array(at_b)), "__d2": within.sum(axis=0)}

    schema = T.StructType([T.StructField(key, pairs.id_type), T.StructField("__d2", T.DoubleType())])
    # written, as it is read for the samples and for the groups
    return written(pairs.visit(sums, schema, tagged, key).groupBy(key).agg(F.sum("__d2").alias("__d2")))
