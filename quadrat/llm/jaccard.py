"""Exact Jaccard self-join of documents on word shingles, by prefixes under several global orders.

Order all shingles globally in any way.  Two sets that are similar enough must share a shingle
among the first few of each (the prefix), whatever the order.  Here the first order is by how
often a shingle occurs, rarest first, and gives the join; two further orders, the same
frequencies in broad classes with other ties, must agree before a pair is verified.  Equal sets
are one class from the start.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quadrat.llm.common import map_rows, schema_of
from quadrat.llm.components import connected
from quadrat.llm.shingles import mix, sequence
from quadrat.session import cut_lineage, written

#: Bytes of a slice of the table of loads as it travels.
SLICE = 1 << 14
#: Least and most bits of the table of loads; its size follows the number of rows between them.
LOAD_BITS = (16, 24)
#: Cells that a set is counted into for the filter before verification.
CELLS = 64
#: Bits of the map of wanted keys, in words of 64.
WANTED_WORDS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; a link from ``percent`` on."""

    words: int = 4
    percent: int = 85

    def least_overlap(self, a: Column, b: Column) -> Column:
        """Smallest intersection with which sets of these sizes link."""
        return F.ceil((a + b) * self.percent / F.lit(float(100 + self.percent)) - 1e-9)

    def prefix(self, n: int) -> int:
        """A set of n that links must share one of its first so many under any order."""
        return n - -(-self.percent * n // 100) + 1


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _class_of(own: np.ndarray) -> int:
    """64-bit name of a set: its size and two sums over its members, scrambled."""
    with np.errstate(over="ignore"):
        sums = np.array([len(own), mix(own, 3).sum(dtype=np.uint64), mix(own, 4).sum(dtype=np.uint64)], np.uint64)
        name = mix(mix(mix(sums[:1], 5) + sums[1:2], 6) + sums[2:], 7)
    return struct.unpack("q", struct.pack("Q", int(name[0])))[0]


def loads(df: DataFrame, text: str, rule: Rule) -> np.ndarray:
    """How many sets have a shingle in each bucket, over all rows.

    Each task counts its rows and hands over slices; slices are added up by many tasks and the
    driver gets one number for each bucket, at most 2 ** 24.
    """
    rows = df.count()
    bits = min(max(int(rows).bit_length() + 2, LOAD_BITS[0]), LOAD_BITS[1])
    per = SLICE // 4
    kind = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def count(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        total = np.zeros(1 << bits, np.int64)
        for (texts,) in batches:
            for value in texts:
                own = np.unique(sequence(value, rule.words))
                np.add.at(total, (own >> np.uint64(64 - bits)).astype(np.int64), 1)
        slices = [s for s in range(len(total) // per) if total[s * per : (s + 1) * per].any()]
        yield [slices, [np.minimum(total[s * per : (s + 1) * per], 2**31 - 1).astype(np.int32).tobytes() for s in slices]]

    def add(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        sums: dict[int, np.ndarray] = {}
        for slices, counts in batches:
            for s, c in zip(slices, counts, strict=True):
                sums[s] = np.minimum(sums.get(s, 0) + np.frombuffer(c, np.int32).astype(np.int64), 2**31 - 1)
        yield [list(sums), [c.astype(np.int32).tobytes() for c in sums.values()]]

    parts = map_rows(df, [text], kind, count).repartition("slice")
    out = np.zeros(1 << bits, np.int32)
    for s, c in map_rows(parts, ["slice", "counts"], kind, add).collect():
        out[s * per : (s + 1) * per] = np.frombuffer(c, np.int32)
    return out


def order_by(own: np.ndarray, load: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of shingles under one of the global orders, smallest first.

    Order 0: by load, then a hash.  Orders 1, 2, ...: by the load's power of two, then another hash.
    """
    bits = len(load).bit_length() - 1
    weight = load[(own >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    if order:
        weight = np.ceil(np.log2(weight + np.uint64(1))).astype(np.uint64)
    return (weight << np.uint64(32)) | (mix(own, 10 + order) >> np.uint64(32))


def _first(own: np.ndarray, load: np.ndarray, order: int, count: int) -> np.ndarray:
    keys = order_by(own, load, order)
    ranked = np.lexsort((own, keys)) if len(own) <= 2 * count else None
    if ranked is None:
        near = np.argpartition(keys, count)[: count + 1]
        near = np.flatnonzero(keys <= keys[near].max())  # ties at the border are told apart below
        ranked = near[np.lexsort((own[near], keys[near]))]
    return own[ranked[:count]]


def describe(df: DataFrame, key: str, text: str, rule: Rule, load: np.ndarray) -> DataFrame:
    """Key, set size, class, cell counts and prefix under the first order, of each row with a word."""
    sent = df.sparkSession.sparkContext.broadcast(load)
    added = {"n": T.LongType(), "cls": T.LongType(), "cells": T.ArrayType(T.IntegerType()), "prefix": T.ArrayType(T.LongType())}

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        own_load = sent.value
        for keys, texts in batches:
            out: list[list] = [[], [], [], []]
            for value in texts:
                own = np.unique(sequence(value, rule.words))
                out[0].append(len(own))
                out[1].append(_class_of(own))
                out[2].append(np.bincount((mix(own, 8) >> np.uint64(58)).astype(np.int64), minlength=CELLS).tolist())
                out[3].append(_signed(_first(own, own_load, 0, rule.prefix(len(own)))) if len(own) else [])
            yield [keys, *out]

    return map_rows(df, [key, text], schema_of(df, key, **added), run)


def _marked(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` with ``__near``: the hashed key is on a map, of fixed size whatever the data, of the keys in ``ids``."""
    spot = F.xxhash64(F.col(key).cast("string"), F.lit("wanted"))
    word = F.pmod(spot, F.lit(WANTED_WORDS)).alias("__word")
    bit = F.pmod(F.shiftright(spot, 20), F.lit(64)).cast("int")
    marks = ids.select(word, F.expr("1L").alias("one"), bit.alias("bit")).select("__word", F.call_function("shiftleft", "one", "bit").alias("mark"))
    marks = F.broadcast(marks.groupBy("__word").agg(F.bit_or("mark").alias("__marks")))
    near = F.call_function("shiftright", F.col("__marks"), bit).bitwiseAND(F.lit(1)) == 1
    return df.withColumn("__word", word).join(marks, "__word", "left").withColumn("__near", F.coalesce(near, F.lit(False))).drop("__word", "__marks")


def wanted(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (a column of distinct keys named like it); only rows near them are shuffled."""
    return _marked(df, key, ids).filter("__near").drop("__near").join(ids, key)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; only rows near them are shuffled."""
    marked = _marked(df, key, ids)
    return marked.filter("not __near").drop("__near").unionByName(marked.filter("__near").drop("__near").join(ids, key, "left_anti"))


def sets_of(df: DataFrame, key: str, text: str, rule: Rule, load: np.ndarray, classes: DataFrame) -> DataFrame:
    """Class, whole set and its prefixes under the further orders, of the rows named in ``classes`` (key, cls)."""
    sent = df.sparkSession.sparkContext.broadcast(load)
    rows = wanted(df.select(key, text), key, classes.select(key).distinct())
    longs = T.ArrayType(T.LongType())
    kind = T.StructType([T.StructField("cls", T.LongType()), T.StructField("members", longs), T.StructField("second", longs), T.StructField("third", longs)])

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        own_load = sent.value
        for (texts,) in batches:
            out: list[list] = [[], [], [], []]
            for value in texts:
                own = np.unique(sequence(value, rule.words))
                if not len(own):
                    continue
                out[0].append(_class_of(own))
                out[1].append(_signed(own))
                for k in (1, 2):
                    out[k + 1].append(_signed(_first(own, own_load, k, rule.prefix(len(own)))))
            yield out

    found = map_rows(rows, [text], kind, run)
    return found.join(classes.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def verified(pairs: DataFrame, about: DataFrame, df: DataFrame, key: str, text: str, rule: Rule, load: np.ndarray) -> DataFrame:
    """The pairs (a, b) of classes that link.

    Cell counts bound the intersection from above, so most pairs go before any set is fetched;
    the rest must agree under the further orders and are then counted exactly.
    """
    small = about.select("cls", "n", "cells")
    left = small.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    right = small.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    likely = pairs.join(left, "a").join(right, "b")
    likely = likely.filter(apart <= F.col("na") + F.col("nb") - 2 * rule.least_overlap(F.col("na"), F.col("nb")))
    likely = cut_lineage(likely.select("a", "b", "na", "nb"))
    needed = likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    classes = about.select("cls", key).join(needed, "cls")
    sets = written(sets_of(df, key, text, rule, load, classes))
    one = sets.select(F.col("cls").alias("a"), F.col("members").alias("ma"), F.col("second").alias("sa"), F.col("third").alias("ta"))
    two = sets.select(F.col("cls").alias("b"), F.col("members").alias("mb"), F.col("second").alias("sb"), F.col("third").alias("tb"))
    agreed = likely.join(one, "a").join(two, "b").filter(F.arrays_overlap("sa", "sb") & F.arrays_overlap("ta", "tb"))
    shared = F.size(F.array_intersect("ma", "mb")).cast("long")
    return agreed.filter(100 * shared >= rule.percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule | None = None) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (smallest key reachable by links) of each row.

    Links are exact.  First each shingle's sets are compared with the one in which it stands
    earliest, which joins most copies of a text; then all sets that share a shingle of
    their prefixes and aren't joined yet are compared with each other.  Pairs inside a component
    that is already known are never made.

    A null or empty text, or one without words, has no shingle and is its own component.  Rows
    with the same key are one in ``component_id`` only if their texts link; a null key counts
    as no candidate for the smallest.  Extra columns are not read.
    """
    rule = rule or Rule()
    load = loads(df, text, rule)
    rows = written(describe(df, key, text, rule, load))
    held = rows.filter(F.col("n") > 0)
    # one row of each class; equal sets have equal sizes, cells and prefixes
    about = held.groupBy("cls").agg(F.first("n").alias("n"), F.first("cells").alias("cells"), F.min(key).alias(key))
    about = cut_lineage(about.filter(F.col(key).isNotNull()))
    prefixes = held.filter(F.col(key).isNotNull()).groupBy("cls").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = prefixes.select("cls", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "token"))
    every = W.partitionBy("token")
    postings = postings.select(
        "*", F.min(F.struct("place", "cls", "n")).over(every).alias("first"), F.min("cls").over(every).alias("low"), F.max("cls").over(every).alias("high")
    )
    shared = cut_lineage(postings.filter("low != high").select("token", "cls", "n", "place", "first"))

    def may_link(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
        """Not refuted by sizes and places, if the shingle is the first that the two share."""
        least = rule.least_overlap(na, nb)
        return (na - pa >= least) & (nb - pb >= least)

    star = shared.filter((F.col("cls") != F.col("first.cls")) & may_link(F.col("n"), F.col("place"), F.col("first.n"), F.col("first.place")))
    star = star.select(F.least("cls", "first.cls").alias("a"), F.greatest("cls", "first.cls").alias("b")).distinct()
    links = cut_lineage(verified(star, about, df, key, text, rule, load))
    near = connected(links)

    known = shared.select("token", "cls", "n", "place").join(near.withColumnRenamed("node", "cls"), "cls", "left")
    known = known.select("token", "cls", "n", "place", F.coalesce("label", "cls").alias("label"))
    x, y = known.alias("x"), known.alias("y")
    rest = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.label") != F.col("y.label"))
        & may_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")),
    )
    rest = rest.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    more = verified(rest, about, df, key, text, rule, load)
    final = connected(links.union(more))

    # by class first, so that the rows meet a table with one row for each class and a group of copies can be split
    member = about.select("cls", key).join(final.withColumnRenamed("node", "cls"), "cls", "left")
    member = member.select("cls", key, F.coalesce("label", "cls").alias("label"))
    smallest = cut_lineage(member.groupBy("label").agg(F.min(key).alias("component_id")))
    component = cut_lineage(member.select("cls", "label").join(smallest, "label").select("cls", "component_id"))
    out = rows.select(key, "n", "cls").join(component, "cls", "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))
