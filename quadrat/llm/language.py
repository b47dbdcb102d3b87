"""Language identification by prediction by partial matching.

For each language a context tree counts which byte follows each context of up to
``ORDER`` bytes.  A text's code length under a language is the sum over its bytes of
-log2 p(byte | longest context the tree has seen), where a byte that a context hasn't seen
costs an escape (method C: distinct successors over distinct plus total) and is then coded in
the next shorter context, down to a uniform code.  The statistics are frozen after training,
so all code lengths can be laid out in one array and a text is scored by two array lookups a
byte.  The language with the shortest code wins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import bounded_sample, fold, map_rows, schema_of

#: Bytes of context; the array of contexts has 64 ** ORDER entries.
ORDER = 3
#: Texts of each language that training reads, on average (all of them if there are fewer).
TRAINING_ROWS = 1500
#: Bytes that are scored at once.
CHUNK = 1 << 20
#: Symbols: 0 is whatever is no letter, the others are bytes of lower-case letters by falling count.
SYMBOLS = 64
_NO_LETTERS = re.compile(r"[\W\d_]+")
#: What \w takes for a part of a word although it is neither a letter nor a decimal digit: fractions, superscripts, Roman numerals.
_NUMBER_SIGNS = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()) + "]+")


def letters(text: str | None) -> bytes:
    """Lower-case letters of a text in UTF-8, runs of anything else as one space; one space at either end."""
    found = _NO_LETTERS.sub(" ", (text or "").lower())
    if not found.replace(" ", "").isalpha():
        found = _NUMBER_SIGNS.sub(" ", found)
    return b" " + found.strip().encode() + b" "


@dataclass(frozen=True)
class Model:
    """Frozen statistics; its size is bounded by ORDER, SYMBOLS and the training sample."""

    languages: tuple[str, ...]
    symbol: np.ndarray  # byte -> symbol
    node: np.ndarray  # the ORDER symbols before -> row of its longest known context
    bits: np.ndarray  # (row * SYMBOLS + symbol, language) -> code length

    def parts(self) -> tuple:
        """Plain values, which executors can read without this class."""
        return self.languages, self.symbol, self.node, self.bits


def _grams(data: bytes, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte after the first: code of the ORDER symbols before it, and its own symbol."""
    s = symbol[np.frombuffer(data, np.uint8)].astype(np.int64)
    padded = np.concatenate([np.zeros(ORDER - 1, np.int64), s])
    context = np.zeros(len(s) - 1, np.int64)
    for k in range(ORDER):
        context = context * SYMBOLS + padded[k : k + len(s) - 1]
    return context, s[1:]


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count contexts in all rows of ``df``, which the caller has bounded.

    Rows without a text, letters or language teach nothing.  Counts are summed by Spark; the
    driver gets one row for each language and (ORDER + 1)-gram, at most 64 ** (ORDER + 1) of each.
    """
    rows = df.select(text, lang).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())

    def bytes_used(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        total = np.zeros(256, np.int64)
        for (texts,) in batches:
            for value in texts:
                total += np.bincount(np.frombuffer(letters(value), np.uint8), minlength=256)
        yield [list(range(256)), total.tolist()]

    kind = T.StructType([T.StructField("byte", T.IntegerType()), T.StructField("n", T.LongType())])
    used = {r[0]: r[1] for r in map_rows(rows, [text], kind, bytes_used).groupBy("byte").agg(F.sum("n")).collect()}
    symbol = np.full(256, SYMBOLS - 1, np.int64)  # the rare ones share a symbol
    ranked = sorted((b for b in used if used[b] and b != 32), key=lambda b: (-used[b], b))
    for i, b in enumerate(ranked[: SYMBOLS - 2]):
        symbol[b] = i + 1
    symbol[32] = 0

    def counts(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        found: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for texts, langs in batches:
            for value, name in zip(texts, langs, strict=True):
                context, s = _grams(letters(value), symbol)
                if len(s) > 1:
                    own = found[name]
                    for gram, n in zip(*(x.tolist() for x in np.unique(context * SYMBOLS + s, return_counts=True)), strict=True):
                        own[gram] += n
        for name, grams in found.items():
            yield [[name] * len(grams), list(grams), list(grams.values())]

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    grams: dict[str, dict[int, int]] = defaultdict(dict)
    for name, gram, n in map_rows(rows, [text, lang], kind, counts).groupBy("lang", "gram").agg(F.sum("n")).collect():
        grams[name][gram] = n
    return _freeze(grams, symbol)


def _freeze(grams: dict[str, dict[int, int]], symbol: np.ndarray) -> Model:
    """Lay out the code length of each symbol after each context known to any language."""
    languages = tuple(sorted(grams))
    trees = []
    for name in languages:
        # by length of context: context code -> counts of the symbols that follow
        tree: list[dict[int, np.ndarray]] = [{} for _ in range(ORDER + 1)]
        for gram, n in grams[name].items():
            for k in range(ORDER + 1):
                row = tree[k].setdefault(gram // SYMBOLS % SYMBOLS**k, np.zeros(SYMBOLS))
                row[gram % SYMBOLS] += n
        trees.append(tree)

    def code_lengths(tree: list[dict[int, np.ndarray]], context: int, k: int, memo: dict) -> np.ndarray:
        """-log2 p of each symbol after a context of k symbols."""
        if k < 0:
            return np.full(SYMBOLS, np.log2(SYMBOLS))
        if (context, k) not in memo:
            shorter = code_lengths(tree, context % SYMBOLS ** max(k - 1, 0), k - 1, memo)
            row = tree[k].get(context)
            if row is not None:
                distinct, total = np.count_nonzero(row), row.sum()
                escape = np.log2((distinct + total) / distinct)
                with np.errstate(divide="ignore"):
                    shorter = np.where(row > 0, np.log2((distinct + total) / row), escape + shorter)
            memo[context, k] = shorter
        return memo[context, k]

    # rows of the array: the empty context first, then longer ones; a context that no tree knows uses its longest known ending
    places = {(0, 0): 0}
    for k in range(1, ORDER + 1):
        for context in sorted({c for tree in trees for c in tree[k]}):
            places[context, k] = len(places)
    bits = np.empty((len(places), SYMBOLS, max(len(languages), 1)), np.float32)
    memos: list[dict] = [{} for _ in trees]
    for (context, k), place in places.items():
        for j, tree in enumerate(trees):
            bits[place, :, j] = code_lengths(tree, context, k, memos[j])
    node = np.zeros(1, np.int32)
    for k in range(1, ORDER + 1):
        node = np.tile(node, SYMBOLS)  # the symbol put in front is the most significant digit
        for (context, length), place in places.items():
            if length == k:
                node[context] = place
    return Model(languages, symbol, node, bits.reshape(len(places) * SYMBOLS, -1))


def code_bits(data: bytes, model: Model) -> np.ndarray:
    """Exact code length of the bytes under each language, whatever their number."""
    total = np.zeros(len(model.languages))
    for begin in range(0, max(len(data) - 1, 1), CHUNK):
        part = data[max(begin - ORDER + 1, 0) : begin + CHUNK + 1]
        context, s = _grams(part, model.symbol)
        skip = begin - max(begin - ORDER + 1, 0)
        total += model.bits[model.node[context[skip:]].astype(np.int64) * SYMBOLS + s[skip:]].sum(axis=0, dtype=np.float64)
    return total


def best_of(text: str | None, model: Model) -> tuple[str, float]:
    """Language and score of one text."""
    data = letters(text)
    if len(data) < 3 or not model.languages:
        return "und", 0.0
    bits = code_bits(data, model)
    best = int(np.argmin(bits))
    return model.languages[best], float(1.0 / np.exp2((bits[best] - bits) / np.sqrt(len(data))).sum())


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred`` and ``score`` of each row's whole text.

    The score is the winner's share of 2 ** -(bits per letter byte), scaled by the square root
    of the length: near 1 when the runner-up needs clearly more bits, 1 / languages on a tie.
    A null or empty text, or one without letters, is ``und`` with score 0; so is every text when
    the model knows no language.  Ties go to the first language by name.  Rows are independent.
    """
    sent = df.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        frozen = Model(*sent.value)
        for keys, texts in batches:
            found = [best_of(value, frozen) for value in texts]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            yield [keys, langs, scores]

    return map_rows(df, [key, text], schema_of(df, key, lang_pred=T.StringType(), score=T.DoubleType()), run)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAINING_ROWS) -> DataFrame:
    """Train on a bounded sample of the labelled rows and predict every row.

    Rows whose crc32(key as text) mod 3 is 1, or whose key is null, are held out: they are
    never trained on.  ``rows`` bounds the sample, as a mean for each language.  Returns what
    :func:`predict` does and ``held_out``.
    """
    model = train(taught_rows(df, key, text, lang, rows), text, lang)
    return predict(df, model, key, text).withColumn("held_out", F.coalesce(fold(key, 3) == 1, F.lit(True)))


def taught_rows(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAINING_ROWS) -> DataFrame:
    """The bounded sample that teaches: the fold comes from crc32 of the key, the sample from another hash of it."""
    return bounded_sample(df.select(key, text, lang).filter(fold(key, 3) != 1), key, rows, by=lang)


def keep(df: DataFrame, model: Model, text: str = "text", least: float = 0.4) -> DataFrame:
    """The rows, with all their columns, whose text has letters and a score of ``least`` or more."""
    sent = df.sparkSession.sparkContext.broadcast(model.parts())

    @F.pandas_udf(T.BooleanType())
    def told(texts: pd.Series) -> pd.Series:
        frozen = Model(*sent.value)
        return texts.map(lambda value: best_of(value, frozen)[1] >= least).astype(bool)

    return df.filter(told(F.col(text)))
