"""Document quality by pairwise ranking.

The Bradley-Terry model gives each document a score, linear in its features, such that the
logistic function of the difference of two scores is the chance that the first is preferred.
It is fitted by logistic loss on feature differences of preference pairs, which all labelled
rows that may teach enter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import bounded_sample, fold, map_rows, schema_of
from quadrat.llm.features import FORM, form
from quadrat.operators.quantiles import exact_quantiles
from quadrat.operators.rank import hash_rank, slice_digits
from quadrat.session import cut_lineage, written

#: Preference pairs for each row of the larger class.
PAIRS_PER_ROW = 3
#: Reported score that stands for the quantile threshold.
CUT = 0.7


@dataclass(frozen=True)
class Ranker:
    """Weights of the (expanded) features, the threshold in score units, and the scale of the reported score."""

    weights: tuple[float, ...]
    threshold: float
    scale: float


def expanded(form_of: Column) -> list[Column]:
    """Form features, their square roots and squares: rates of junk differ most near zero."""
    x = [form_of[i] for i in range(len(FORM))]
    return [*x, *(F.sqrt(F.abs(v)) for v in x), *(v * v for v in x)]


def features(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``features``, the form of each row's whole text."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for *kept, texts in batches:
            yield [*kept, [form(value or "") for value in texts]]

    return map_rows(df, [*keep, text], schema_of(df, *keep, features=T.ArrayType(T.DoubleType())), run)


def taught_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Key and ``__label`` of the keys that may teach.

    Those whose crc32(key as text) mod 4 is 2 are held out.  Where a key has several labels the
    largest counts.
    """
    taught = labels.select(key, label).filter(F.col(label).isNotNull() & (fold(key, 4) != 2))
    return taught.groupBy(key).agg((F.max(label) > 0).cast("int").alias("__label"))


def labelled_sample(df: DataFrame, labels: DataFrame, key: str, label: str, text: str, rows: int) -> DataFrame:
    """Key, text and label of a bounded sample of the rows that may teach.

    The sampled labels are bounded by ``rows``, so they are broadcast.
    """
    return df.select(key, text).join(F.broadcast(bounded_sample(taught_labels(labels, key, label), key, rows)), key)


def fit(taught: DataFrame, key: str = "doc_id", pairs: int = PAIRS_PER_ROW) -> Ranker | None:
    """Fit on all rows of a table of key, ``features`` and ``__label``; None when a class is missing.

    Rows of both classes are numbered by a hash of the key; row i of the larger class meets rows
    i * pairs, i * pairs + 1, ... of the smaller one, cyclically, so every row is in a pair.  Half of the pairs
    are turned round, so that both outcomes occur; there is no intercept.  The threshold is an exact
    quantile of the scores of all rows.  The table may be of any size: slices are numbered and
    bracketed on their own, and the loss is summed up over partitions.
    """
    digest = F.md5(F.concat(F.lit("pair"), F.col(key).cast("string")))
    taught = cut_lineage(taught.select("__label", "features", digest.alias("__digest")))
    sizes = {r[0]: r[1] for r in taught.groupBy("__label").count().collect()}
    if len(sizes) < 2:
        return None
    many, few = (1, 0) if sizes[1] >= sizes[0] else (0, 1)
    # rows of one key are told apart by their features
    placed = hash_rank(taught, ["__label"], "__digest", "place", slice_digits(F.lit(sizes[many])), ["features"])
    placed = cut_lineage(placed.select("features", "__label", (F.col("place") - 1).alias("place")))
    left = placed.filter(F.col("__label") == many).select("place", F.col("features").alias("x"))
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    left = left.withColumn("meets", F.pmod(F.col("place") * pairs + F.col("turn"), F.lit(sizes[few])))
    right = placed.filter(F.col("__label") == few).select(F.col("place").alias("meets"), F.col("features").alias("y"))
    turned = F.pmod(F.col("place") + F.col("turn"), F.lit(2)) == 0
    sign = F.when(turned, F.lit(1.0)).otherwise(F.lit(-1.0))
    # label 1: the first of the pair is preferred
    met = left.join(right, "meets").select("x", "y", sign.alias("sign"), (turned if many == 1 else ~turned).cast("double").alias("label"))
    apart = [F.col("sign") * (a - b) for a, b in zip(expanded(F.col("x")), expanded(F.col("y")), strict=True)]
    differences = met.select(array_to_vector(F.array(*apart)).alias("features"), "label")
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60).fit(differences)
    weights = tuple(float(w) for w in model.coefficients)
    share = sizes[0] / (sizes[0] + sizes[1])
    scored = placed.select(_raw(weights).alias("score"))
    threshold, low, high = exact_quantiles(scored, [], "score", {"threshold": share, "low": 0.1, "high": 0.9}).first()
    return Ranker(weights, threshold, 4.0 / max(high - low, 1e-9))


def _raw(weights: tuple[float, ...]) -> Column:
    """Bradley-Terry score of a row's ``features``."""
    return sum((x * w for x, w in zip(expanded(F.col("features")), weights, strict=True)), F.lit(0.0))


def scores(rows: DataFrame, ranker: Ranker | None, key: str = "doc_id") -> DataFrame:
    """Key, ``score`` and ``predicted`` of rows with ``features``; see :func:`rank`."""
    score = F.lit(0.5)
    if ranker is not None:
        shifted = (_raw(ranker.weights) - ranker.threshold) * ranker.scale + math.log(CUT / (1 - CUT))
        score = 1 / (1 + F.exp(-F.least(F.greatest(shifted, F.lit(-40.0)), F.lit(40.0))))
    return rows.select(key, score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def rank(df: DataFrame, ranker: Ranker | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``score`` and ``predicted`` of each row's whole text.

    ``score`` is the logistic function of the Bradley-Terry score, shifted so that the quantile
    threshold is CUT; ``predicted`` is 1 from CUT on.  Null texts count as empty.  Without a model
    (a class had no labelled row) every score is 0.5.
    """
    return scores(features(df, [key], text), ranker, key)


def rank_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text") -> DataFrame:
    """Learn from all labelled rows that may teach, score all rows; adds ``held_out``.

    A null key is never learned from and counts as held out; of a repeated key every row teaches.  The features are those of
    :mod:`quadrat.llm.features`, so neither language nor source nor label is an input.  They
    are made once, in a pass over the texts, and written.
    """
    rows = written(features(df, [key], text))
    ranker = fit(rows.join(taught_labels(labels, key, label), key), key)
    return scores(rows, ranker, key).withColumn("held_out", F.coalesce(fold(key, 4) == 2, F.lit(True)))
