"""Quality rules as a short-circuit cascade.

Every rule is tried on a sample, where its cost and the texts it rejects are measured.  The
rules are then ordered greedily by rejections per second among the texts that the rules
before them let pass, and a text is judged by them in that order until one rejects it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import SPACES, bounded_sample, map_rows, schema_of

#: Rows on which costs and selectivities are estimated, on average.
SAMPLE_ROWS = 1000


class Measures:
    """What the rules ask of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # bytes.split() parts at space and 9 to 13, as the words' definition does

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, "#*$%&|<>"))

    @cached_property
    def lines(self) -> Counter:
        """Lines that have a word, with how often they occur."""
        return Counter(line for line in self.text.split("\n") if line.strip(SPACES))

    @cached_property
    def n_dup_lines(self) -> int:
        return sum(self.lines.values()) - len(self.lines)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that occur more than once, all occurrences counted."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(windows)
        if len(often) == len(windows):
            return 0
        again = np.fromiter((often[x] > 1 for x in windows), bool, len(windows))
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        return int(covered.sum())

    @cached_property
    def kinds(self) -> tuple[int, int, int]:
        """ASCII capitals, ASCII letters, and bytes of other characters than ASCII."""
        n = np.bincount(np.frombuffer(self.data, np.uint8), minlength=256)
        return int(n[65:91].sum()), int(n[65:91].sum() + n[97:123].sum()), int(n[128:].sum())


@dataclass(frozen=True)
class Rule:
    """A name and a test that is true for a text to reject."""

    name: str
    rejects: Callable[[Measures], bool]


RULES = [
    Rule("few_words", lambda m: len(m.words) < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * len(m.words)),
    Rule("symbols", lambda m: 10 * m.n_symbols > len(m.words)),
    Rule("duplicate_lines", lambda m: m.n_dup_lines >= 3 and 2 * m.n_dup_lines > sum(m.lines.values())),
    Rule("word_length", lambda m: m.word_chars < 2 * len(m.words) or m.word_chars > 15 * len(m.words)),
    Rule("capitals", lambda m: 2 * m.kinds[0] > m.kinds[1]),
    Rule("no_letters", lambda m: 2 * (m.kinds[1] + m.kinds[2]) < len(m.data)),
]


def cascade(df: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order in which to apply them.

    Costs are seconds on a sample of about ``rows`` rows, each rule on a text with nothing
    computed before it.  Only sums leave the tasks: for each rule its seconds, for each set of
    rejecting rules the number of texts.  On an empty sample the order is as given.
    """
    rules = rules or RULES

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        seconds, masks = [0.0] * len(rules), Counter()
        for (texts,) in batches:
            for value in texts:
                mask = 0
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= rule.rejects(Measures(value)) << i
                    seconds[i] += time.perf_counter() - began
                masks[mask] += 1
        yield [[-1 - i for i in range(len(rules))] + list(masks), seconds + [float(n) for n in masks.values()]]

    kind = T.StructType([T.StructField("what", T.LongType()), T.StructField("amount", T.DoubleType())])
    sample = bounded_sample(df.select(key, text), key, rows)
    found = {r[0]: r[1] for r in map_rows(sample, [text], kind, run).groupBy("what").agg(F.sum("amount")).collect()}
    cost = [max(found.get(-1 - i, 0.0), 1e-9) for i in range(len(rules))]
    alive = {mask: n for mask, n in found.items() if mask >= 0}
    left, order = list(range(len(rules))), []
    while left:
        gain = {i: sum(n for mask, n in alive.items() if mask >> i & 1) / cost[i] for i in left}
        best = max(left, key=lambda i: (gain[i], -cost[i], -i)) if alive else left[0]
        order.append(rules[best])
        left.remove(best)
        alive = {mask: n for mask, n in alive.items() if not mask >> best & 1}
    return order


def judge(df: DataFrame, order: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts, ``base_failed``, ``kept`` and ``rejected_by`` of each row's whole text.

    The counts are wanted for every row; the cascade stops at the first rule that rejects.
    ``kept`` doesn't depend on the order, ``rejected_by`` does.  A null or empty text has no words
    and fails.  Rows are independent; extra columns are not read.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    added = dict.fromkeys(counts, T.LongType()) | {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "rejected_by": T.StringType()}

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            out: list[list] = [[] for _ in added]
            for value in texts:
                m = Measures(value)
                n = len(m.words)
                failed = n < 50 or 100 * m.n_repeat_words > 50 * n
                by = next((rule.name for rule in order if rule.rejects(m)), None)
                row = (n, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, not failed and by is None, by)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield [keys, *out]

    return map_rows(df, [key, text], schema_of(df, key, **added), run)
