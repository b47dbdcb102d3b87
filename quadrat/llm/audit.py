"""Audit of how text filters interact, from one pass of a byte transducer.

Every text goes once through a table-driven transducer over its UTF-8 bytes.  Its state says
whether the byte before stood in a word; a table gives, for state and class of the next byte,
what the byte adds: a code point, a capital, a symbol, the begin of a word.  The spans of the
words go into a hash table that compares the bytes of a span with those of the entry it meets,
so distinct words are counted exactly.  Since the next state follows from the class of the byte
alone, whole blocks of bytes are looked up at once.

The five filters then give each row a pattern of failures.  Whatever an order of the filters
does to a part of the table follows from how many of its rows are clear of each set of
filters, so a part is summed up by 32 numbers, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadrat.llm.common import schema_of

#: The five filters in the order of their bits.
FILTERS = "ABCDE"
#: Classes of bytes, outputs of the transducer.
SPACE, CAPITAL, SYMBOL, CONTINUED, OTHER = range(5)
POINT, IS_CAPITAL, IS_SYMBOL, BEGINS, INSIDE = 1, 2, 4, 8, 16
#: Bytes of texts that are looked up at once; a longer text is a block of its own.
BLOCK = 1 << 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[32, *range(9, 14)]] = SPACE
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[[ord(c) for c in "#$%&*|"]] = SYMBOL
    table[0x80:0xC0] = CONTINUED
    return table


def _outputs() -> np.ndarray:
    """Output for (state, class); state 1 is inside a word, and so is every byte but a space."""
    table = np.zeros((2, 5), np.uint8)
    for state in (0, 1):
        for kind in range(5):
            out = 0 if kind == CONTINUED else POINT
            out |= {CAPITAL: IS_CAPITAL, SYMBOL: IS_SYMBOL}.get(kind, 0)
            if kind != SPACE:
                out |= INSIDE | (0 if state else BEGINS)
            table[state, kind] = out
    return table.ravel()


class SpanTable:
    """Open addressing over word spans of a byte buffer; entries are verified byte by byte."""

    def __init__(self, data: np.ndarray):
        self.data = data
        # eight bytes from every place; the buffer ends with eight zeros
        self.eight = np.ndarray(max(len(data) - 7, 0), "<u8", data.data, strides=(1,)) if len(data) >= 8 else np.zeros(0, "<u8")

    def hashes(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number for each span, from its eight-byte parts."""
        out = size.astype(np.uint64)
        at, left, who = begin.copy(), size.copy(), np.arange(len(begin))
        while len(who):
            part = self.eight[at] & _MASK[np.minimum(left, 8)]
            mixed = (out[who] ^ part) * _FACTOR
            out[who] = mixed ^ (mixed >> np.uint64(29))
            more = left > 8
            at, left, who = at[more] + 8, left[more] - 8, who[more]
        return out

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of two spans of one size are equal."""
        equal = np.ones(len(a), bool)
        at, other, left, who = a.copy(), b.copy(), size.copy(), np.arange(len(a))
        while len(who):
            fits = (self.eight[at] ^ self.eight[other]) & _MASK[np.minimum(left, 8)] == 0
            equal[who[~fits]] = False
            more = fits & (left > 8)
            at, other, left, who = at[more] + 8, other[more] + 8, left[more] - 8, who[more]
        return equal

    def distinct(self, owner: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Marks the spans that are entries: one of each text of each owner."""
        count = len(begin)
        fresh = np.zeros(count, bool)
        if not count:
            return fresh
        number = self.hashes(begin, size) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        bits = max(int(count * 2 - 1).bit_length(), 4)
        slots = np.full(1 << bits, -1, np.int64)
        place = ((number * _FACTOR) >> np.uint64(64 - bits)).astype(np.int64)
        pending = np.arange(count)
        while len(pending):
            at = place[pending]
            free = slots[at] < 0
            slots[at[free]] = pending[free]  # of several that want a slot the last gets it
            held = slots[at]
            fresh[pending[held == pending]] = True
            like = (held != pending) & (number[held] == number[pending]) & (owner[held] == owner[pending]) & (size[held] == size[pending])
            met = np.flatnonzero(like)
            like[met] = self.same(begin[pending[met]], begin[held[met]], size[pending[met]])
            pending = pending[(held != pending) & ~like]
            place[pending] = (place[pending] + 1) & ((1 << bits) - 1)
        return fresh


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def count_block(data: np.ndarray, ends: np.ndarray, classes: np.ndarray, outputs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a block; ``ends`` are the ends of the texts, ``data`` has eight zeros more."""
    length = int(ends[-1]) if len(ends) else 0
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    kinds = classes[data[:length]]
    before = np.empty(length, np.uint8)
    if length:
        before[0] = 0
        before[1:] = kinds[:-1] != SPACE
        before[starts[starts < length]] = 0
    out = outputs[before * np.uint8(5) + kinds]

    def places(bit: int) -> np.ndarray:
        return np.flatnonzero(out & bit)

    def per_text(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, ends) - np.searchsorted(at, starts)

    begin = places(BEGINS)
    words = per_text(begin)
    owner = np.repeat(np.arange(len(ends)), words)
    # a word ends at the next space or at the end of its text, whichever comes first
    spaces = np.append(np.flatnonzero(kinds == SPACE), length)
    end = np.minimum(spaces[np.searchsorted(spaces, begin)], ends[owner]) if len(begin) else begin
    fresh = SpanTable(data).distinct(owner, begin, end - begin)
    return {
        "words": words,
        "distinct": np.bincount(owner[fresh], minlength=len(ends)),
        "capitals": per_text(places(IS_CAPITAL)),
        "symbols": per_text(places(IS_SYMBOL)),
        "points": ends - starts - per_text(np.flatnonzero(kinds == CONTINUED)),
    }


COUNTS = ("words", "distinct", "capitals", "symbols", "points")


def counts(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``words``, ``distinct``, ``capitals``, ``symbols`` and ``points`` of each row's whole text.

    Null texts count as empty.  A task holds one Arrow batch and the tables of one block.
    """
    schema = schema_of(df, *keep, **dict.fromkeys(COUNTS, T.LongType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, outputs = _classes(), _outputs()
        for batch in batches:
            texts = batch.column(text).fill_null("").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            found: dict[str, list[np.ndarray]] = {name: [] for name in COUNTS}
            first = 0
            while first < len(texts):
                last = max(int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1, first + 1)
                block = np.concatenate([whole[offsets[first] : offsets[last]], np.zeros(8, np.uint8)])
                for name, values in count_block(block, offsets[first + 1 : last + 1] - offsets[first], classes, outputs).items():
                    found[name].append(values)
                first = last
            added = [pa.array(np.concatenate(found[name]) if found[name] else [], pa.int64()) for name in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *added], schema=arrow)

    return df.select(*keep, text).mapInArrow(run, schema)


def failures() -> Column:
    """The failures of filters A to D as bits, from the counts; E needs the whole table."""
    failed = [
        F.col("words") < 50,
        100 * F.col("distinct") < 65 * F.col("words"),
        100 * F.col("capitals") > 5 * F.col("points"),
        F.col("symbols") > 0,
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)), F.lit(0))


def patterns(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows of each ``part`` with each pattern of ``fails``: ``n``, ``n_good`` and ``n_toxic``.

    Filter E fails where a smaller key has an identical text, by SHA-256.  No group of equal texts
    is gathered: rows are counted by text, part and label first, and of each such group only the
    rows of its smallest key can pass.  A null key is neither smaller than others nor larger, so
    it never fails E; it has no label.  Where a key has several labels the largest counts.
    """
    read = df.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("t"))
    read = read.withColumn("digest", F.unhex(F.sha2("t", 256)))
    rows = counts(read, ["k", "part", "digest"], "t").select("k", "part", "digest", failures().alias("fails"))
    rows = rows.groupBy("k", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.select(F.col(key).alias("k"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).filter(F.col("k").isNotNull())
    marks = marks.groupBy("k").agg(F.coalesce(F.max("q"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic"))
    # rows without a key meet no label; their salt spreads them over the tasks of the join
    salt = F.when(F.col("k").isNull(), F.hash("digest")).otherwise(F.lit(0))
    labelled = rows.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0)), ["k", "salt"], "left")
    clean = F.lit(False)
    labelled = labelled.select(*rows.columns, F.coalesce("good", clean).alias("good"), F.coalesce("toxic", clean).alias("toxic"))
    groups = labelled.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("no_key"),
        F.min(F.when(F.col("k").isNotNull(), F.struct("k", "n"))).alias("first"),
    )
    least = groups.groupBy("digest").agg(F.min("first.k").alias("least"))
    passing = F.col("no_key") + F.when(F.col("first.k") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = groups.join(least, "digest").select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("fails").alias("fails"), passing.alias("n")),
            F.struct(F.col("fails").bitwiseOR(F.lit(16)).alias("fails"), (F.col("n") - passing).alias("n")),
        )).alias("x"),
    )
    split = split.select("part", "good", "toxic", "x.fails", "x.n").filter(F.col("n") > 0)

    def of(mark: str) -> Column:
        return F.sum(F.when(F.col(mark), F.col("n")).otherwise(F.lit(0)))

    return split.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


def interactions(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each step of each order of the five filters does, for each part.

    Returns ``part`` (null: empty string), ``filter_order``, ``step`` (1 to 5) and, for the
    filter at that step, ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost`` and ``shapley`` (its removals summed over all orders), all long.  An empty
    table has no part and so no row.  Columns other than the four named are not read.
    """
    all_sets = (1 << len(FILTERS)) - 1
    clear = patterns(df, labels, key, text, part).withColumn("sets", F.explode(F.sequence(F.lit(0), F.lit(all_sets))))
    # rows that fail no filter of the set; a part with none at all still has an entry for each set
    hit = F.col("fails").bitwiseAND(F.col("sets")) == 0

    def clear_sum(name: str) -> Column:
        return F.sum(F.when(hit, F.col(name)).otherwise(F.lit(0)))

    clear = clear.groupBy("part", "sets").agg(clear_sum("n").alias("n"), clear_sum("n_good").alias("good"), clear_sum("n_toxic").alias("toxic"))
    clear = clear.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("sets", "n", "good", "toxic"))).alias("c"))

    steps = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append(f"{''.join(order)} {step} {earlier} {bit}")
            earlier |= bit
    size = len(FILTERS)
    weights = [factorial(bin(s).count("1")) * factorial(size - 1 - bin(s).count("1")) if s < all_sets else 0 for s in range(all_sets + 1)]
    each = F.explode(F.split(F.lit(",".join(steps)), ","))  # 600 steps, whatever the data
    with_bit = F.col("earlier").bitwiseOR(F.col("bit"))

    def at(which: Column | int, field: str = "n") -> Column:
        return F.element_at(F.col("c"), (which if isinstance(which, Column) else F.lit(which)) + 1)[field]

    removed = at(F.col("earlier")) - at(with_bit)
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(all_sets)),
        F.lit(0).cast("long"),
        lambda total, s: total + F.when(
            s.bitwiseAND(F.col("bit")) == 0,
            F.element_at(F.array(*map(F.lit, weights)), s + 1) * (at(s) - at(s.bitwiseOR(F.col("bit")))),
        ).otherwise(F.lit(0)),
    )
    steps_of = clear.select("part", "c", each.alias("x")).withColumn("x", F.split("x", " ")).select(
        "part", "c", F.col("x")[0].alias("filter_order"), *(F.col("x")[i].cast("int").alias(n) for i, n in ((1, "step"), (2, "earlier"), (3, "bit")))
    )
    return steps_of.select(
        "part", "filter_order", "step",
        at(with_bit).alias("kept"),
        removed.alias("removed"),
        (at(0) - at(F.col("bit")) - removed).alias("redundant"),
        (at(F.lit(all_sets).bitwiseXOR(F.col("bit"))) - at(all_sets)).alias("unique_fails"),
        (at(F.col("earlier"), "good") - at(with_bit, "good")).alias("good_lost"),
        (at(F.col("earlier"), "toxic") - at(with_bit, "toxic")).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
