"""Tables of all unordered pairs, built tile by tile.

A pair table is the result itself, one row per pair of samples, so the work is
quadratic in samples; what must not happen is that one feature or one sample
makes a task quadratic.  Samples are cut into hash blocks of bounded size and each
pair of blocks is one tile.  Every tile has about the same number of rows however
abundant a feature or deep a sample is.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadrat.functions.scalars import ratio
from quadrat.functions.special import geodesic
from quadrat.operators.rank import number_rows
from quadrat.session import cut_lineage, spread, written

#: Samples of a block, at least; where there would be more than ``BLOCKS`` blocks they grow up to ``MOST_SAMPLES``.
BLOCK_SAMPLES, BLOCKS, MOST_SAMPLES = 256, 24, 1024
FEATURE_CHUNK = 4096
#: Whole counts up to this are compared level by level.
LEVELS = 16
#: Pairs that leave a task at once.
EMITTED = 100_000


def block_of(key: Column, blocks: Column) -> Column:
    """Block number of a key."""
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def tiles_of(block: Column, blocks: Column) -> Column:
    """All tiles a block takes part in, as ordered pairs of block numbers."""
    partners = F.sequence(F.lit(0), blocks.cast("int") - 1)
    return F.transform(partners, lambda j: F.struct(F.least(block, j).alias("p"), F.greatest(block, j).alias("q")))


def all_pairs(df: DataFrame, key: str, columns: Iterable[str], block_rows: int = BLOCK_SAMPLES) -> DataFrame:
    """Every unordered pair of rows: ``id_a < id_b`` and both sides' columns as ``x_a``, ``x_b``."""
    columns = list(columns)
    blocks = df.agg(F.greatest(F.ceil(F.count("*") / F.lit(block_rows)), F.lit(1)).alias("b")).scalar()
    rows = df.select(key, *columns).withColumn("__blocks", blocks)
    rows = rows.withColumn("__block", block_of(F.col(key), F.col("__blocks")))
    tiled = rows.withColumn("__tile", F.explode(tiles_of(F.col("__block"), F.col("__blocks"))))
    tiled = tiled.select("*", F.col("__tile.p").alias("__p"), F.col("__tile.q").alias("__q"))

    def side(s: str, block: str) -> DataFrame:
        here = tiled.where(F.col("__block") == F.col(block))
        return here.select("__p", "__q", F.col(key).alias(f"__{s}"), *[F.col(c).alias(f"__{s}_{c}") for c in columns])

    left, right = side("l", "__p"), side("r", "__q")
    met = spread(left, "__p", "__q").join(spread(right, "__p", "__q"), ["__p", "__q"]).where((F.col("__p") < F.col("__q")) | (F.col("__l") < F.col("__r")))
    ordered = F.col("__l") < F.col("__r")
    out = [F.least("__l", "__r").alias("id_a"), F.greatest("__l", "__r").alias("id_b")]
    for c in columns:
        out.append(F.when(ordered, F.col(f"__l_{c}")).otherwise(F.col(f"__r_{c}")).alias(f"{c}_a"))
        out.append(F.when(ordered, F.col(f"__r_{c}")).otherwise(F.col(f"__l_{c}")).alias(f"{c}_b"))
    return met.select(*out)


def scalar_distance(df: DataFrame, key: str, value: str, name: str = "distance") -> DataFrame:
    """Bray-Curtis of two numbers for every pair: |x - y| / (x + y), null when both are zero."""
    pairs = all_pairs(df, key, [value])
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    return pairs.select("id_a", "id_b", ratio(F.abs(a - b), a + b).alias(name))


def geographic_distance(df: DataFrame, key: str, lat: str, lon: str, name: str = "metres") -> DataFrame:
    """Geodesic distance in metres for every pair."""
    pairs = all_pairs(df, key, [lat, lon])
    return pairs.select("id_a", "id_b", geodesic(f"{lat}_a", f"{lon}_a", f"{lat}_b", f"{lon}_b").alias(name))


def _shared(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Shared amount for all rows of a against all rows of b."""
    if kind == "jaccard":
        return _met(a, b, 1, tiny=True).astype(np.float64)
    top = min(a.max(initial=0), b.max(initial=0))
    if top <= LEVELS and not (a % 1).any() and not (b % 1).any():
        # the smaller of two counts is the number of levels that both reach
        out = np.zeros((len(a), len(b)))
        for level in range(1, int(top) + 1):
            out += _met(a, b, level)
        return out
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        np.minimum(row, b).sum(axis=1, out=out[i])
    return out


def _met(a: np.ndarray, b: np.ndarray, level: int, tiny: bool = False) -> np.ndarray:
    """In how many columns both rows reach the level (with ``tiny``, are above nothing); exact, as a chunk has far fewer than 2^24 columns."""
    a, b = (x > 0 if tiny else x >= level for x in (a, b))
    both = np.flatnonzero(a.any(axis=0) & b.any(axis=0))
    if len(both) < 0.8 * a.shape[1]:
        a, b = a[:, both], b[:, both]
    return a.astype(np.float32) @ b.astype(np.float32).T


def _numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number from 0 of each value, in the order of the values; written, as blocks on both sides of a tile follow from it."""
    return written(number_rows(df.select(key).distinct(), [key], name).select(key, (F.col(name) - 1).alias(name)))


def block_size(samples: int) -> int:
    """Samples of a block: more of them where there are many, as each block is sent to as many tasks as there are blocks."""
    return max(min(-(-samples // BLOCKS), MOST_SAMPLES), BLOCK_SAMPLES)


def community_distance(
    cells: DataFrame, sample: str, feature: str, value: str, kind: str = "bray", replicate: str | None = None, name: str = "distance"
) -> DataFrame:
    """Bray-Curtis or Jaccard dissimilarity of every pair, averaged over replicates when there are any.

    ``cells`` has one row per sample, feature (and replicate).  Samples are cut into blocks and features into
    chunks; the cells of a block, a chunk and a replicate are one packed record.  A task takes two blocks, and their
    records stream by, replicate after replicate: it holds two records, the shared amounts of
    one replicate and the running means.  So neither a sample with millions of features nor many
    replicates make a task larger.  A pair counts in the replicates in which both samples have anything.
    """
    return CommunityPairs(cells, sample, feature, value, kind, replicate).table(name)


class CommunityPairs:
    """The pairs of :func:`community_distance` before they are a table.

    The table is quadratic, so a step that needs a sum of it, or something more about both ends, takes that where a
    tile is made (:meth:`visit`, or ``about`` in :meth:`table`); then the pairs are neither shuffled nor written.
    """

    def __init__(self, cells: DataFrame, sample: str, feature: str, value: str, kind: str = "bray", replicate: str | None = None):
        if kind not in ("bray", "jaccard"):
            raise ValueError(f"unknown dissimilarity {kind}")
        self.kind, self.replicate, self.change = kind, replicate, None
        self.id_type, self.spark = cells.schema[sample].dataType, cells.sparkSession
        keep = [F.col(sample).alias("__sample"), F.col(feature).alias("__feature"), F.col(value).cast("double").alias("v")]
        self._of = lambda: cells.where(F.col(value) > 0).select(*keep, (F.col(replicate).cast("long") if replicate else F.lit(0).cast("long")).alias("r"))
        self._ready: dict = {}

    def among(self, members: DataFrame, key: str) -> CommunityPairs:
        """The pairs of which both ends are in ``members``."""
        out = copy.copy(self)
        ids = members.select(F.col(key).alias("__sample"))
        out._of, out._ready = (lambda: self._of().join(ids, "__sample", "left_semi")), {}
        return out

    def root(self) -> CommunityPairs:
        """The same pairs with the square roots of their distances."""
        out = copy.copy(self)
        out.change = np.sqrt
        return out

    def prepared(self) -> dict:
        """Numbers of the samples and the packed records of each tile; made once."""
        if not self._ready:
            rows = written(self._of())
            samples, features = _numbers(rows, "__sample", "s"), _numbers(rows, "__feature", "f")
            count = samples.count()
            size = block_size(count)
            draws = rows.agg(F.count_distinct("r")).first()[0] if self.replicate else 1
            width = min(max(features.count(), 1), FEATURE_CHUNK)
            records = cut_lineage(self._packed(rows, samples, features, size))
            self._ready |= {"samples": samples, "count": count, "size": size, "blocks": max(-(-count // size), 1), "width": width, "draws": draws, "records": records}
        return self._ready

    @staticmethod
    def _packed(rows: DataFrame, samples: DataFrame, features: DataFrame, size: int) -> DataFrame:
        placed = rows.join(samples, "__sample").join(features, "__feature").select(
            F.floor(F.col("s") / size).cast("int").alias("block"), (F.col("s") % size).cast("int").alias("s"),
            F.floor(F.col("f") / FEATURE_CHUNK).cast("int").alias("chunk"), (F.col("f") % FEATURE_CHUNK).cast("int").alias("f"), "r", "v",
        )
        packed = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("r", T.LongType()), T.StructField("data", T.BinaryType())])

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            data = _encoded(pdf["s"].to_numpy(), pdf["f"].to_numpy(), pdf["v"].to_numpy(np.float64))
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "r": pdf["r"].iloc[:1], "data": [data]})

        return placed.groupBy("block", "chunk", "r").applyInPandas(pack, packed)

    def table(self, name: str = "distance", about: DataFrame | None = None, key: str = "") -> DataFrame:
        """``id_a``, ``id_b``, the distance, and each column x of ``about`` as ``x_a`` and ``x_b``.

        ``about`` is met as in an inner join with both ends: an end with several rows there gives several rows.
        """
        known = self.prepared()
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # several tasks share the replicates of a tile only while there are fewer tiles than tasks
        parts = max(min(known["draws"], -(-2 * tasks // (known["blocks"] * (known["blocks"] + 1) // 2))), 1)
        own = [T.StructField(f"{f.name}_{end}", f.dataType) for f in (about.schema if about is not None else []) if f.name != key for end in "ab"]
        schema = T.StructType([T.StructField("id_a", self.id_type), T.StructField("id_b", self.id_type), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType()), *own])
        columns = [f.name[:-2] for f in own[::2]]

        def rows(tile: _Tile) -> Iterator[dict]:
            i, j = np.nonzero(tile.known())
            if tile.about:
                (at_a, one), (at_b, two) = tile.about
                i, j, x, y = _repeated(i, j, at_a, at_b)
            for begin in range(0, len(i), EMITTED):
                some = slice(begin, begin + EMITTED)
                a, b = i[some], j[some]
                out = {"id_a": tile.names[0].take(pa.array(a)), "id_b": tile.names[1].take(pa.array(b)), "total": tile.total[a, b], "n": tile.n[a, b]}
                if tile.about:
                    for c in columns:
                        out |= {f"{c}_a": one.column(c).take(pa.array(x[some])), f"{c}_b": two.column(c).take(pa.array(y[some]))}
                yield out

        met = self._visited(rows, schema, parts, about, key, not self.replicate)
        if parts > 1:
            added = [F.sum("total").alias("total"), F.sum("n").alias("n")]
            met = met.groupBy("id_a", "id_b", *(f.name for f in own)).agg(*added)
        distance = F.col("total") / F.col("n") if self.replicate else F.col("total")
        return met.select("id_a", "id_b", distance.alias(name), *(f.name for f in own))

    def visit(self, finish: Callable[[_Tile], Iterator[dict]], schema: T.StructType, about: DataFrame | None = None, key: str = "") -> DataFrame:
        """What ``finish`` makes of each tile: columns by name, any number of times.  Only for pairs without replicates."""
        if self.replicate:
            raise ValueError("replicates are averaged in the table of pairs")
        return self._visited(finish, schema, 1, about, key, True)

    def _visited(self, finish, schema: T.StructType, parts: int, about: DataFrame | None, key: str, changed: bool) -> DataFrame:
        known = self.prepared()
        size, width, kind, change = known["size"], known["width"], self.kind, self.change if changed else None
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        block = F.floor(F.col("s") / size).cast("int").alias("block")
        place = (F.col("s") % size).cast("int").alias("s")
        ids = known["samples"].select(block, place, F.col("__sample").alias("id")).groupBy("block").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("s", "id"))), lambda x: x["id"]).alias("ids")
        )  # the names of one block at most
        columns = [c for c in about.columns if c != key] if about is not None else []
        if about is not None:
            told = about.withColumnRenamed(key, "__sample").join(known["samples"], "__sample").select(block, F.struct(place.alias("__s"), *columns).alias("x"))
            ids = ids.join(told.groupBy("block").agg(F.collect_list("x").alias("about")), "block", "left")
        shares = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        tile = F.explode(tiles_of(F.col("block"), F.lit(known["blocks"]))).alias("t")
        wide = ids.schema["about"].dataType if about is not None else T.ArrayType(T.IntegerType())
        heads = ids.select(tile, "block", "ids", F.col("about") if about is not None else F.lit(None).cast(wide).alias("about")).select(
            "t", shares, F.lit(None).cast("long").alias("r"), F.lit(-1).alias("chunk"), "block", F.lit(None).cast("binary").alias("data"), "ids", "about"
        )
        cells = known["records"].select(tile, "block", "chunk", "r", "data").select(
            "t", F.pmod(F.col("r"), F.lit(parts)).cast("int").alias("part"), "r", "chunk", "block", "data", F.lit(None).cast(ids.schema["ids"].dataType).alias("ids"), F.lit(None).cast(wide).alias("about")
        )
        order = ["p", "q", "part", "r", "chunk", "block"]
        records = heads.unionByName(cells).select(F.col("t.p").alias("p"), F.col("t.q").alias("q"), *order[2:], "data", "ids", "about")
        arrow = to_arrow_schema(schema)

        def batch_of(columns: dict) -> pa.RecordBatch:
            made = (columns[f.name] for f in arrow)
            return pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile = None
            for batch in batches:
                for i in range(batch.num_rows):
                    p, q, part, r, chunk, block = (batch.column(c)[i].as_py() for c in order)
                    if tile is None or tile.key != (p, q, part):
                        if tile is not None:
                            yield from map(batch_of, finish(tile.ended()))
                        tile = _Tile((p, q, part), kind, width, change)
                    if r is None:
                        tile.head(block, batch.column("ids")[i].values, batch.column("about")[i].values if columns else None, columns)
                    else:
                        tile.take(r, chunk, block, batch.column("data")[i].as_py())
            if tile is not None:
                yield from map(batch_of, finish(tile.ended()))

        # the head of a block, with its names, comes before its cells
        return records.repartition(tasks, "p", "q", "part").sortWithinPartitions(*order).mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values if isinstance(values, pa.Array) and values.type == kind else values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _repeated(i: np.ndarray, j: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of places as an inner join meets them with the rows at ``at_a`` and ``at_b``, and which rows those are; both rise."""
    for side, at in ((0, at_a), (1, at_b)):
        of = j if side else i
        first, last = np.searchsorted(at, of), np.searchsorted(at, of, side="right")
        times = last - first
        row = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        i, j = np.repeat(i, times), np.repeat(j, times)
        x = np.repeat(x, times) if side else row
        y = row
    return i, j, x, y


def _encoded(s: np.ndarray, f: np.ndarray, v: np.ndarray) -> bytes:
    """Cells in few bytes: how many each sample has, steps from feature to feature, and values by as many bytes as whole numbers need."""
    order = np.lexsort((f, s))
    s, f, v = s[order], f[order], v[order]
    counts = np.bincount(s).astype(np.int32)
    kind = next((k for k in (1, 2) if len(v) and v.max() < 1 << 8 * k and not (v % 1).any()), 8)
    values = v.astype({1: np.uint8, 2: np.uint16, 8: np.float64}[kind])
    steps = np.diff(f, prepend=0)
    begins = (np.cumsum(counts) - counts)[counts > 0]
    steps[begins] = f[begins]
    steps = steps.astype(next(k for k in (np.uint8, np.uint16, np.int32) if steps.max(initial=0) <= np.iinfo(k).max))
    return np.array([len(counts), steps.itemsize, kind], np.int32).tobytes() + counts.tobytes() + steps.tobytes() + values.tobytes()


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples, features and values of an encoded record."""
    samples, narrow, kind = np.frombuffer(data, np.int32, 3).tolist()
    counts = np.frombuffer(data, np.int32, samples, 12)
    total, at = int(counts.sum()), 12 + 4 * samples
    steps = np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.int32}[narrow], total, at)
    v = np.frombuffer(data[at + narrow * total :], {1: np.uint8, 2: np.uint16, 8: np.float64}[kind], total)
    upto = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    return np.repeat(np.arange(samples), counts), upto[1:] - np.repeat(upto[np.cumsum(counts) - counts], counts), v


def _packed(values: np.ndarray) -> bytes:
    """A matrix in few bytes: where it has at most 65,536 different values, these and two bytes a place."""
    few, at = np.unique(values, return_inverse=True)
    if len(few) > 1 << 16:
        return np.zeros(1, np.int64).tobytes() + np.ascontiguousarray(values).tobytes()
    return np.array([len(few)], np.int64).tobytes() + few.tobytes() + at.astype(np.uint16).tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    few = int(np.frombuffer(data, np.int64, 1)[0])
    if not few:
        values = np.frombuffer(data[8:])
        return values.reshape(rows, len(values) // max(rows, 1))
    return np.frombuffer(data, np.float64, few, 8)[np.frombuffer(data[8 + 8 * few :], np.uint16)].reshape(rows, -1)


class _Tile:
    """Running sums over the records of one pair of blocks, which come by replicate, chunk of features and block."""

    def __init__(self, key: tuple, kind: str, width: int, change: Callable | None):
        self.key, self.kind, self.width, self.change = key, kind, width, change
        self.heads: dict[int, tuple] = {}
        self.at = None
        self.sides: dict[int, np.ndarray] = {}
        self.names: list[pa.Array] = []
        self.about: list[tuple[np.ndarray, pa.Table]] = []

    def head(self, block: int, names: pa.Array, about: pa.Array | None, columns: list[str]) -> None:
        """Names of a block, and of the rows about its samples the places and the rows."""
        rows = None
        if columns:
            if about is None:
                rows = np.zeros(0, np.int64), None
            else:
                order = np.argsort(about.field("__s").to_numpy(), kind="stable")
                rows = about.field("__s").to_numpy()[order], pa.table({c: about.field(c).take(pa.array(order)) for c in columns})
        self.heads[block] = names, rows
        if set(self.key[:2]) == set(self.heads):
            sizes = [len(self.heads[b][0]) for b in self.key[:2]]
            self.shared = np.zeros(sizes)
            self.totals = {b: np.zeros(n) for b, n in zip(self.key[:2], sizes, strict=True)}
            self.total, self.n = np.zeros(sizes), np.zeros(sizes, np.int64)

    def take(self, r: int, chunk: int, block: int, data: bytes) -> None:
        if self.at is not None and self.at != (r, chunk):
            self.add()
            if self.at[0] != r:
                self.close()
        self.at = (r, chunk)
        s, f, v = _decoded(data)
        dense = np.zeros((len(self.heads[block][0]), self.width))
        np.add.at(dense, (s, f), v)
        self.sides[block] = dense

    def add(self) -> None:
        """The chunk's part of the shared amounts and totals."""
        p, q = self.key[:2]
        for block, dense in self.sides.items():
            self.totals[block] += (dense > 0).sum(axis=1) if self.kind == "jaccard" else dense.sum(axis=1)
        if p in self.sides and q in self.sides:
            self.shared += _shared(self.sides[p], self.sides[q], self.kind)
        self.sides = {}

    def close(self) -> None:
        """One replicate is complete: its distances enter the means."""
        p, q = self.key[:2]
        a, b = self.totals[p][:, None], self.totals[q][None, :]
        both = (a > 0) & (b > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            distance = _distance(self.shared, a, b, self.kind)
        self.total += np.where(both, distance, 0.0)
        self.n += both
        self.shared[:] = 0
        for block in (p, q):
            self.totals[block][:] = 0

    def ended(self) -> _Tile:
        """All replicates are in; ``total`` over ``n`` is the mean distance."""
        self.add()
        self.close()
        if self.change is not None:
            self.total = self.change(np.maximum(self.total, 0.0))
        self.names = [self.heads[b][0] for b in self.key[:2]]
        self.about = [self.heads[b][1] for b in self.key[:2] if self.heads[b][1] is not None]
        if any(rows is None for _, rows in self.about):
            self.n[:] = 0  # of one block nothing is told, so none of its pairs is met
            self.about = []
        return self

    def known(self) -> np.ndarray:
        """Which places are pairs."""
        return np.triu(self.n, 1) if self.key[0] == self.key[1] else self.n

    def squares(self) -> np.ndarray:
        """Squared distances, 0 where a place is no pair; of pairs without replicates."""
        return np.where(self.known() > 0, self.total, 0.0) ** 2


def _distance(shared, total_a, total_b, kind: str):
    if kind == "jaccard":
        return 1 - shared / (total_a + total_b - shared)
    return 1 - 2 * shared / (total_a + total_b)


def relation(a: Column, b: Column) -> Column:
    """``same-x`` when both ends share the group x, else ``different``; null when one is unknown."""
    return F.when(a == b, F.concat(F.lit("same-"), a.cast("string"))).when(a != b, F.lit("different"))
