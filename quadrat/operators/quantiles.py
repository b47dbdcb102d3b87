"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.operators.joins import beside
from quadrat.session import cut_lineage

#: Different values of one group among which a rank is looked up by ordering them.
BRACKET_ROWS = 100_000
#: Slices into which a larger bracket is cut in each round.
SLICES = 256
_BELOW = float("-inf")


def exact_quantiles(
    df: DataFrame, keys: Iterable[str], value: str, probs: dict[str, float], accuracy: int = 10_000, weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles, one output column per named probability.

    The built-in exact percentile holds every distinct value of a group in one
    buffer.  Here an approximate quantile sketch brackets the wanted rank; rows
    below the bracket are only counted, rows inside are counted per value.  While a
    bracket holds more than ``BRACKET_ROWS`` different values it is cut into slices, which are
    counted, and only the slices with the rank are kept.  So what is ordered in one task is bounded,
    however large a group is.  The sketch's rank error is at most 1/accuracy, so the bracket of three
    times that and of three ranks on each side must contain the rank; should it ever not, the query fails
    instead of giving a wrong number.  A row stands for ``weight`` rows of its value, a whole number from 1.
    """
    keys, names = list(keys), list(probs)
    if weight is None:
        counted, sizes = _bracketed(df, keys, value, probs, accuracy)
    else:
        # values that are counted already need no bracket: the slices below narrow them down
        base = df.select(*keys, F.col(value).cast("double").alias("v"), F.col(weight).cast("long").alias("c")).where("v is not null")
        counted = base.groupBy(*keys, "v").agg(F.sum("c").alias("c")).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("i"), "v", "c")
        sizes = cut_lineage(base.groupBy(*keys).agg(F.sum("c").alias("__n")))
    counted, below = cut_lineage(counted), F.lit(_BELOW)
    position = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("i") + 1) * (F.col("__n") - 1)
    while _widest(counted, keys) > BRACKET_ROWS:
        counted = cut_lineage(_narrowed(counted, keys, sizes, position))
    running = W.partitionBy(*keys, "i").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        beside(counted.withColumn("upto", F.sum("c").over(running)), sizes, keys)
        .withColumn("h", position)
        .groupBy(*keys, "i")
        .agg(
            F.min(F.when(F.col("upto") > F.floor("h"), F.col("v"))).alias("a"),
            F.min(F.when(F.col("upto") > F.ceil("h"), F.col("v"))).alias("b"),
            F.first("h").alias("h"),
        )
    )
    missed = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == below) | (F.col("b") == below)
    quantile = F.when(missed, F.raise_error(F.lit("quantile bracket missed the rank")).cast("double")).otherwise(
        F.col("a") + (F.col("h") - F.floor("h")) * (F.col("b") - F.col("a"))
    )
    out = found.withColumn("q", quantile)
    return out.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])


def _bracketed(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """How often each value inside the brackets of the ranks occurs, all below them as one, and the groups' sizes."""
    names = list(probs)
    # in small groups three ranks are a larger share
    margins = [m for m in (3.0 / accuracy * 10**k for k in range(20)) if m < 1] + [1.0]
    base = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    lows = F.array(*[F.lit(max(0.0, p - m)) for p in probs.values() for m in margins])
    highs = F.array(*[F.lit(min(1.0, p + m)) for p in probs.values() for m in margins])
    sketched = base.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.percentile_approx("__v", lows, F.lit(accuracy)).alias("__lo"),
        F.percentile_approx("__v", highs, F.lit(accuracy)).alias("__hi"),
    )
    narrowest = sum(((F.col("__n") * m < 3).cast("int") for m in margins[:-1]), F.lit(0))
    ends = [F.array(*[F.col(c)[narrowest + i * len(margins)] for i in range(len(names))]).alias(c) for c in ("__lo", "__hi")]
    brackets = cut_lineage(sketched.select(*keys, "__n", *ends))
    below = F.lit(_BELOW)
    picks = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when(F.col("__v") < F.col("__lo")[i], below)
                .when(F.col("__v") <= F.col("__hi")[i], F.col("__v"))
                .alias("v"),
            )
            for i in range(len(names))
        ]
    )
    counted = (
        beside(base, brackets.select(*keys, "__lo", "__hi"), keys)
        .select(*keys, F.inline(F.filter(picks, lambda s: s["v"].isNotNull())))
        .groupBy(*keys, "i", "v")
        .agg(F.count("*").alias("c"))
    )
    return counted, brackets.select(*keys, "__n")


def _widest(counted: DataFrame, keys: list[str]) -> int:
    """Most different values in a bracket."""
    return counted.groupBy(*keys, "i").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _narrowed(counted: DataFrame, keys: list[str], sizes: DataFrame, position) -> DataFrame:
    """The brackets without the slices that cannot hold their ranks; what lies below is one row again."""
    by = [*keys, "i"]
    inside = F.col("v") != F.lit(_BELOW)
    shares = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    cuts = counted.where(inside).groupBy(*by).agg(F.percentile_approx("v", shares, F.lit(10 * SLICES)).alias("cuts"))
    slice_of = F.when(inside, F.size(F.filter("cuts", lambda s: s < F.col("v")))).otherwise(F.lit(-1))
    sliced = counted.join(cuts, by).withColumn("slice", slice_of).drop("cuts")
    totals = sliced.groupBy(*by, "slice").agg(F.sum("c").alias("c"))
    before = W.partitionBy(*by).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    totals = beside(totals.withColumn("under", F.coalesce(F.sum("c").over(before), F.lit(0))), sizes, keys).withColumn("h", position)
    upto = F.col("under") + F.col("c")
    # a slice holds the ranks under + 1 to upto, counted from 1; wanted are floor(h) + 1 and ceil(h) + 1
    wanted = (F.col("under") <= F.ceil("h")) & (upto > F.floor("h"))
    place = F.when(upto <= F.floor("h"), F.lit(-1)).when(wanted, F.lit(0)).otherwise(F.lit(1)).alias("place")
    placed = sliced.join(totals.select(*by, "slice", place), [*by, "slice"]).where("place <= 0")
    return placed.groupBy(*by, F.when(F.col("place") == 0, F.col("v")).otherwise(F.lit(_BELOW)).alias("v")).agg(F.sum("c").alias("c"))


def with_group_median(df: DataFrame, keys: Iterable[str], value: str, name: str) -> DataFrame:
    """Attach the exact group median to every row."""
    keys = list(keys)
    return df.join(exact_quantiles(df, keys, value, {name: 0.5}), keys, "left")
