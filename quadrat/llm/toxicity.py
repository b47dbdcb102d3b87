"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and beginnings of words that are far more frequent in texts
labelled toxic.  Features are the lexicon's densities, how near its hits are to words that
address the reader, capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import bounded_sample, fold, map_rows, schema_of
from quadrat.llm.features import form
from quadrat.llm.ranking import labelled_sample
from quadrat.session import cut_lineage

#: Labelled rows that training reads, on average.
TRAINING_ROWS = 12_000
#: Letters of the word beginnings that may enter the lexicon.
BEGINNINGS = (4, 5, 6)
#: A term enters the lexicon with this many toxic texts and this log-odds at least; the strongest LEXICON_TERMS are kept.
LEAST_TEXTS, LEAST_ODDS, LEXICON_TERMS = 6, 2.5, 5000
#: Score from which a text is predicted toxic.
CUT = 0.3
#: Second-person words of the four languages, in lower case.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr tú ti tus usted ustedes vosotros vuestro".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
#: Words that a task remembers with their weight.
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W_]+(?:[.*@$!0-9_-]+[^\W_]+)*")
_INNER = re.compile(r"[\W_]+")


def terms(word: str) -> list[str]:
    """A lower-case word and its beginnings, each with a mark for which it is."""
    return ["=" + word] + [f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n]


def plain(word: str) -> str:
    """A word without disguise: separators between letters dropped, digits and signs read as letters."""
    return _INNER.sub("", word.translate(DISGUISE)) if not word.isalpha() else word


def learn_lexicon(sample: DataFrame, text: str = "text") -> dict[str, float]:
    """Terms with their log-odds; ``sample`` is bounded and has ``__label``."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for texts, labels in batches:
            found = [(t, y) for value, y in zip(texts, labels, strict=True) for t in {t for w in set(_WORD.findall((value or "").lower())) for t in terms(plain(w))}]
            yield [[t for t, _ in found], [y for _, y in found]]

    kind = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.IntegerType())])
    sizes = {r[0]: r[1] for r in sample.groupBy("__label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = map_rows(sample, [text, "__label"], kind, run).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    kept = counts.withColumn("odds", odds).filter((F.col("a") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS))
    return {r["term"]: r["odds"] for r in kept.orderBy(F.desc("odds"), "term").limit(LEXICON_TERMS).collect()}


class Featurizer:
    """Dense features of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[float, bool]] = {}

    def weigh(self, word: str) -> tuple[float, bool]:
        """Largest log-odds of the word's terms, and whether it took undoing a disguise to find it."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            bare = plain(word)
            found = max((self.lexicon.get(t, 0.0) for t in terms(bare)), default=0.0), bare != word
            self.known[word] = found
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        words = _WORD.findall(text.lower())
        count = max(len(words), 1)
        weights, disguised, at = [], 0, []
        for i, (weight, hidden) in enumerate(map(self.weigh, words)):
            if weight:
                weights.append(weight)
                at.append(i)
                disguised += hidden
        near = 0
        if at:
            you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
            near = _near(np.array(at), you)
        strong = sum(w > 4 for w in weights)
        return [
            len(weights) / count,
            float(np.log1p(len(weights))),
            strong / count,
            float(np.log1p(strong)),
            max(weights, default=0.0),
            sum(weights) / count,
            near / count,
            disguised / count,
            sum(not w.isalpha() for w in words) / count,
            *form(text),
        ]


def _near(at: np.ndarray, you: np.ndarray) -> int:
    """Hits within five words of an address, by binary search."""
    if not len(you):
        return 0
    right = np.searchsorted(you, at)
    after = np.abs(you[np.minimum(right, len(you) - 1)] - at)
    before = np.abs(you[np.maximum(right - 1, 0)] - at)
    return int((np.minimum(after, before) <= 5).sum())


def features(df: DataFrame, keep: list[str], lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """The kept columns and ``features`` of each row's whole text."""
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        own = Featurizer(sent.value)
        for *kept, texts in batches:
            yield [*kept, [own(value) for value in texts]]

    return map_rows(df, [*keep, text], schema_of(df, *keep, features=T.ArrayType(T.DoubleType())), run)


def score_toxicity(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", rows: int = TRAINING_ROWS
) -> DataFrame:
    """Key, ``held_out``, ``score`` and ``predicted`` of each row's whole text.

    Lexicon, trees and calibration are learned from a bounded sample of labelled rows whose
    crc32(key as text) mod 4 is not 2: half of it teaches the lexicon and the trees, the other
    half, which they haven't seen, the calibration.  Null texts count as empty; a null key
    is held out.  When a class is missing every score is 0.
    """
    held = F.coalesce(fold(key, 4) == 2, F.lit(True)).alias("held_out")
    sample = cut_lineage(labelled_sample(df, labels, key, label, text, rows))
    half = F.pmod(F.xxhash64(F.lit("half"), F.col(key).cast("string")), F.lit(2))
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy(half.alias("half"), "__label").count().collect()}
    if len(sizes) < 4:
        return df.select(key, held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    lexicon = learn_lexicon(sample.filter(half == 0), text)
    vectors = features(sample, [key, "__label"], lexicon, text).select(
        key, array_to_vector("features").alias("features"), F.col("__label").cast("double").alias("label")
    )
    vectors = cut_lineage(vectors)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=7, maxBins=32).fit(vectors.filter(half == 0))
    chance = vector_to_array("probability")[1]
    unseen = trees.transform(vectors.filter(half == 1)).select(chance.alias("raw"), "label")
    curve = IsotonicRegression(featuresCol="raw").fit(unseen)
    scored = trees.transform(features(df, [key], lexicon, text).withColumn("features", array_to_vector("features")))
    scored = curve.transform(scored.select(key, chance.alias("raw")))
    score = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return scored.select(key, held, score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
