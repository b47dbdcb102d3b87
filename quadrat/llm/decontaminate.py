"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document when enough of the item's words are covered by tiles:
non-overlapping word runs that both share, the longest first.  As tiles may stand in any
order, a passage whose sentences were moved is found too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import map_rows, schema_of

#: Words of the shortest tile, which is also the length of the seeds.
SHORTEST = 5
#: Share of an item's words under tiles from which it counts as leaked.
COVERAGE = 0.5
#: UTF-8 bytes of benchmark text that one pass over the documents carries to the tasks.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"\w+")
_BASE, _MASK = 1_000_003, (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin value, modulo 2 ** 64, of every run of ``length`` word numbers."""
    if len(ids) < length:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - length + 1, np.uint64)
    for k in range(length):
        out = out * np.uint64(_BASE) + ids[k : k + len(out)]
    return out


def tiles(a: np.ndarray, b: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in a, place in b, length) of two number sequences.

    For falling lengths, all unmarked runs of b are hashed and looked up with those of a; equal ones
    are compared word by word and extended.  Of the matches found only the longest are marked
    before the search at that length starts anew, so matches are marked strictly longest first;
    ties go to the first place in a, then in b.
    """
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    found: list[tuple[int, int, int]] = []
    length = min(len(a), len(b), max(shortest, 20))
    while length >= shortest:
        runs = _free_runs(free_b, length)
        places = defaultdict(list)
        for value, at in zip(_rolling(b, length)[runs].tolist(), runs.tolist(), strict=True):
            places[value].append(at)
        matches = []
        own = _free_runs(free_a, length)
        for value, i in zip(_rolling(a, length)[own].tolist(), own.tolist(), strict=True):
            for j in places.get(value, ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= length:
                    matches.append((-n, i, j))
        if not matches:
            length = length // 2 if length // 2 > shortest else shortest if length > shortest else 0
            continue
        longest = -min(matches)[0]
        for _, i, j in sorted(m for m in matches if m[0] == -longest):
            if free_a[i : i + longest].all() and free_b[j : j + longest].all():
                free_a[i : i + longest] = False
                free_b[j : j + longest] = False
                found.append((i, j, longest))
    return found


def _free_runs(free: np.ndarray, length: int) -> np.ndarray:
    """Where runs of ``length`` free places begin."""
    if len(free) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[length:] - sums[:-length] == length)


class Block:
    """Some benchmark items: word numbers, and which items have a seed."""

    def __init__(self, items: list[tuple], shortest: int):
        self.shortest = shortest
        self.numbers: dict[str, int] = {}
        self.items: list[tuple] = []  # (item id, word numbers)
        owners: dict[int, set[int]] = defaultdict(set)
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.uint64)
            if len(ids):
                for value in set(_rolling(ids, min(shortest, len(ids))).tolist()):
                    owners[value].add(len(self.items))
                self.items.append((item, ids))
        self.owners = dict(owners)
        # items with fewer words than a seed are seeds of their own length
        self.lengths = sorted({min(shortest, len(ids)) for _, ids in self.items})
        self.seeds = np.array(sorted(owners), np.uint64)

    def leaks(self, text: str | None, coverage: float) -> Iterator[tuple]:
        """(item id, share covered, tiles) of each item that the text leaks."""
        get = self.numbers.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        known = ids > 0
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length in self.lengths:
            runs = _free_runs(known, length)  # a seed has benchmark words only
            if not len(runs):
                continue
            values = _rolling(ids, length)[runs]
            at = np.minimum(np.searchsorted(self.seeds, values), len(self.seeds) - 1)
            for value, place in zip(values[seen := self.seeds[at] == values].tolist(), runs[seen].tolist(), strict=True):
                for i in self.owners[value]:
                    hits[i].append((place, length))
        for i, places in sorted(hits.items()):
            item, own = self.items[i]
            length = min(self.shortest, len(own))
            # only what lies under the item's seeds can be in a tile: cut the text down to it
            mask = np.zeros(len(ids), bool)
            for place, n in places:
                if n == length:
                    mask[place : place + n] = True
            near = np.flatnonzero(mask)
            if not len(near):
                continue
            gaps = np.flatnonzero(np.diff(near) > 1) + 1
            parts = [x for run in np.split(near, gaps) for x in (ids[run], np.zeros(1, np.uint64))]
            tiled = tiles(own, np.concatenate(parts), length)
            share = sum(n for _, _, n in tiled) / len(own)
            if share >= coverage:
                yield item, share, len(tiled)


def blocks_of(benchmark: DataFrame, item: str, text: str, size: int) -> list[list[tuple]]:
    """The benchmark cut into blocks of about ``size`` bytes, fetched one at a time by the caller's loop."""
    width = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64
    total = benchmark.agg(F.sum(width)).first()[0] or 0
    count = max(1, -(-total // size))
    part = F.pmod(F.xxhash64(F.col(item).cast("string"), F.col(text)), F.lit(count))
    return [benchmark.filter(part == i).select(item, text) for i in range(count)]


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
    shortest: int = SHORTEST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row and benchmark item of which at least ``coverage`` is under tiles.

    Returns the key, the item's id, ``coverage`` and ``n_tiles``.  The benchmark goes to the
    tasks in blocks of bounded size, each met by one pass over all documents; nothing is
    shuffled, so a passage in a third of all documents makes no task larger.  Texts are compared
    by lower-case words.  Items shorter than a seed need all their words in one run; items
    without words, null and empty texts leak nothing.  Repeated rows and repeated items give a
    row each; an empty table on either side gives an empty result.
    """
    found = None
    schema = schema_of(df, key)
    schema = T.StructType([*schema, T.StructField(item, benchmark.schema[item].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType())])
    for block in blocks_of(benchmark, item, item_text, block_bytes):
        rows = [tuple(r) for r in block.orderBy(item, item_text).collect()]  # at most about block_bytes
        sent = df.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[list[list]], sent=sent) -> Iterator[list[list]]:
            seeds = Block(sent.value, shortest)
            for keys, texts in batches:
                leaks = [(k, *leak) for k, value in zip(keys, texts, strict=True) for leak in seeds.leaks(value, coverage)]
                if leaks:
                    yield [list(x) for x in zip(*leaks, strict=True)]

        part = map_rows(df, [key, text], schema, run)
        found = part if found is None else found.unionByName(part)
    return found


def keep(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows, with all their columns, that leak no item; one pass for each block of the benchmark."""
    for block in blocks_of(benchmark, item, item_text, BLOCK_BYTES):
        sent = df.sparkSession.sparkContext.broadcast([tuple(r) for r in block.orderBy(item, item_text).collect()])

        df = df.filter(_clean(sent, coverage)(F.col(text)))
    return df


def _clean(sent: Broadcast, coverage: float) -> Callable[[Column], Column]:
    """Whether a text leaks no item of the block."""

    @F.pandas_udf(T.BooleanType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeds = Block(sent.value, SHORTEST)
        for texts in batches:
            yield texts.map(lambda value: next(seeds.leaks(value, coverage), None) is None).astype(bool)

    return clean
