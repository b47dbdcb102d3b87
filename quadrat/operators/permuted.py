"""Products of a long table with permuted designs, in blocks bounded in both directions.

Samples and features are numbered and cut into blocks, permutations into chunks.  The cells of one
block of samples and one block of features are one packed record, and so are the design's values of one block of samples
in one chunk of permutations.  A task takes a block of features and a chunk, and the
blocks of samples stream by: it holds the sums for its features and permutations, and one block of samples.
What it does with the sums (compare, square, add over features) happens there, so features x
permutations never leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadrat.operators.rank import number_rows
from quadrat.operators.resample import PACKED_KEYS, numbered_rows, permutations, permuted_chunks
from quadrat.session import cut_lineage

#: Samples and features of a block; design values (8 bytes each) of a block in one chunk.
BLOCK_SAMPLES, BLOCK_FEATURES, CHUNK_VALUES = 2048, 1024, 4_000_000

Finish = Callable[[list, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


@dataclass
class Shuffled:
    """The designs that :func:`~quadrat.operators.resample.permutations` makes of the rows of one, before they are a table.

    What is sent to a task is the design itself and, for each permutation, the row whose values a sample receives.
    """

    rows: DataFrame
    count: int
    seed: int

    def table(self, sample: str, columns: list[str]) -> DataFrame:
        return permutations(self.rows, sample, columns, self.count, self.seed)

    def packable(self, sample: str) -> bool:
        rows, known = self.rows.agg(F.count("*"), F.count_distinct(sample)).first()
        return rows == known <= PACKED_KEYS


def _numbered(df: DataFrame, key: str) -> DataFrame:
    return cut_lineage(number_rows(df.select(key).distinct(), [key], "__i").select(key, (F.col("__i") - 1).alias("__i")))


def products(
    cells: DataFrame,
    sample: str,
    feature: str,
    value: str,
    designs: DataFrame | Shuffled,
    columns: list[str],
    finish: Finish,
    schema: T.StructType,
    observed: bool = False,
) -> DataFrame:
    """Sums of value x design over the samples, handed to ``finish`` block by block.

    ``designs`` has one row per ``perm`` and sample with the design's ``columns``.  ``finish`` gets the names of a
    block's features, the sums and the sums by presence (columns x features x permutations), and the numbers of the permutations;
    with ``observed`` permutation 0 is the first of every chunk.  Its rows make the result.  Samples without a
    design and missing values take no part.
    """
    shuffled = designs if isinstance(designs, Shuffled) and designs.packable(sample) else None
    if shuffled:
        numbered = numbered_rows(shuffled.rows.select(sample, *(F.col(c).cast("double").alias(c) for c in columns)), sample)
    else:
        designs = designs.table(sample, columns) if isinstance(designs, Shuffled) else designs
        designs = cut_lineage(designs.select("perm", sample, *columns))
    cells = cut_lineage(cells.where(F.col(value).isNotNull()).select(sample, feature, F.col(value).cast("double").alias("__v")))
    samples = numbered.select(sample, F.col("__i").cast("long").alias("__i")) if shuffled else _numbered(designs.where("perm = 0"), sample)
    features = _numbered(cells, feature)
    count = shuffled.count if shuffled else designs.agg(F.coalesce(F.max("perm"), F.lit(0))).first()[0]
    wide = len(columns)
    width = min(max(samples.count(), 1), BLOCK_SAMPLES)
    each = max(CHUNK_VALUES // (width * wide), 2)
    blocks = max(-(-features.count() // BLOCK_FEATURES), 1)
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # enough chunks to busy the tasks, few enough that the cells aren't repeated for little work
    each = min(each, max(-(-(count + 1) // max(tasks // blocks, 1)), 16))
    own = each - 1 if observed else each
    chunks = max(-(-(count if observed else count + 1) // own), 1)
    chunk = F.floor((F.col("perm") - 1) / own) if observed else F.floor(F.col("perm") / own)
    shift = 1 if observed else 0

    located = cells.join(samples.withColumnRenamed("__i", "__s"), sample).join(features.withColumnRenamed("__i", "__f"), feature)
    located = located.select(
        F.floor(F.col("__s") / BLOCK_SAMPLES).cast("int").alias("sb"), F.floor(F.col("__f") / BLOCK_FEATURES).cast("int").alias("fb"),
        (F.col("__s") % BLOCK_SAMPLES).cast("int").alias("s"), (F.col("__f") % BLOCK_FEATURES).cast("int").alias("f"), F.col(feature).alias("name"), "__v",
    )
    record = T.StructType([T.StructField(n, T.IntegerType()) for n in ("fb", "chunk", "sb", "kind")] + [T.StructField("data", T.BinaryType())])

    def pack_cells(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((BLOCK_FEATURES, width))
        np.add.at(dense, (pdf["f"].to_numpy(), pdf["s"].to_numpy()), pdf["__v"].to_numpy())
        f, s = np.nonzero(dense)
        data = f.astype(np.int32).tobytes() + s.astype(np.int32).tobytes() + dense[f, s].tobytes()
        return pd.DataFrame({"fb": [pdf["fb"].iloc[0]], "chunk": [-1], "sb": [pdf["sb"].iloc[0]], "kind": [1], "data": [data]}).astype({"chunk": "int32", "kind": "int32"})

    def pack_designs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((wide, each, width))
        k, s = pdf["k"].to_numpy(), pdf["s"].to_numpy()
        for i in range(wide):
            out[i, k, s] = pdf[f"__d{i}"].to_numpy()
        return pd.DataFrame({"fb": [-1], "chunk": [pdf["chunk"].iloc[0]], "sb": [pdf["sb"].iloc[0]], "kind": [0], "data": [out.tobytes()]}).astype({"fb": "int32", "kind": "int32"})

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def pack_moved(table: pa.Table, perms: np.ndarray, to: np.ndarray) -> pa.Table:
        c = int(perms[shift] - shift) // own if len(perms) > shift else 0
        values = np.column_stack([table.column(n).to_numpy() for n in columns])
        begins = range(0, to.shape[1], BLOCK)
        data = [values.tobytes(), *(to[:, b : b + BLOCK].tobytes() for b in begins)]
        blocks_of = pa.array([-1, *range(len(begins))], pa.int32())
        fixed = {n: pa.array([v] * len(data), pa.int32()) for n, v in (("fb", -1), ("chunk", c))}
        return pa.table({**fixed, "sb": blocks_of, "kind": pa.array([-1] + [0] * len(begins), pa.int32()), "data": pa.array(data, pa.binary())})

    BLOCK = BLOCK_SAMPLES  # noqa: N806 - a task doesn't see a changed module
    if shuffled:
        designs_packed = permuted_chunks(numbered, sample, columns, count, each, shuffled.seed, pack_moved, record, observed)
    else:
        placed = designs.join(samples.withColumnRenamed("__i", "__s"), sample).select(
            "perm", F.floor(F.col("__s") / BLOCK_SAMPLES).cast("int").alias("sb"), (F.col("__s") % BLOCK_SAMPLES).cast("int").alias("s"),
            *(F.col(c).cast("double").alias(f"__d{i}") for i, c in enumerate(columns)),
        )
        drawn = placed.where("perm > 0") if observed else placed
        drawn = drawn.withColumn("chunk", chunk.cast("int")).withColumn("k", (F.col("perm") - F.col("chunk") * own).cast("int"))
        if observed:
            drawn = drawn.unionByName(placed.where("perm = 0").select("*", every(chunks).alias("chunk"), F.lit(0).alias("k")))
        designs_packed = drawn.groupBy("chunk", "sb").applyInPandas(pack_designs, record)
    cells_packed = located.groupBy("fb", "sb").applyInPandas(pack_cells, record)
    names = located.select("fb", "f", "name").distinct().groupBy("fb").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "name"))), lambda x: x["name"]).alias("names"))
    out = cells_packed.drop("chunk").select("fb", every(chunks).alias("chunk"), "sb", "kind", "data").unionByName(
        designs_packed.drop("fb").select(every(blocks).alias("fb"), "chunk", "sb", "kind", "data")
    )
    out = out.join(names, "fb")
    arrow, moved = to_arrow_schema(schema), shuffled is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, seen, matrix, values = None, None, None, None, None

        def done() -> pa.RecordBatch:
            (_, c), taxa = held
            first = c * own + shift
            perms = np.arange(first, min(first + own, count + 1))
            perms = np.r_[0, perms] if observed else perms
            used = (slice(None), slice(0, len(taxa)), slice(0, len(perms)))
            return pa.RecordBatch.from_pandas(finish(taxa, sums[used], seen[used], perms), schema=arrow, preserve_index=False)

        for batch in batches:
            for row in range(batch.num_rows):
                fb, c, kind, data, taxa = (batch.column(n)[row].as_py() for n in ("fb", "chunk", "kind", "data", "names"))
                if held is None or held[0] != (fb, c):
                    if held is not None:
                        yield done()
                    held = ((fb, c), taxa)
                    sums, seen = np.zeros((2, wide, len(taxa), each))
                if kind == -1:
                    values = np.frombuffer(data).reshape(-1, wide)
                    continue
                if kind == 0 and moved:
                    upto = min(own, count + 1 - shift - c * own) + shift
                    at = np.frombuffer(data, np.int32).reshape(max(upto, 1), -1)
                    matrix = np.zeros((wide, each, width))
                    matrix[:, : len(at), : at.shape[1]] = np.moveaxis(values[at], 2, 0)
                    continue
                if kind == 0:
                    matrix = np.frombuffer(data).reshape(wide, each, width)
                    continue
                size = len(data) // 16
                f, s = np.frombuffer(data, np.int32, size), np.frombuffer(data, np.int32, size, 4 * size)
                dense = np.zeros((len(taxa), width))
                dense[f, s] = np.frombuffer(data, np.float64, size, 8 * size)
                shown = (dense != 0).astype(float)
                for i in range(wide):
                    sums[i] += dense @ matrix[i].T
                    seen[i] += shown @ matrix[i].T
        if held is not None:
            yield done()

    # a block's design comes before its cells
    order = ["fb", "chunk", "sb", "kind"]
    return out.repartition(tasks, "fb", "chunk").sortWithinPartitions(*order).select(*order, "data", "names").mapInArrow(run, schema)


def gram(cells: DataFrame, sample: str, feature: str, value: str, designs: DataFrame | Shuffled, columns: list[str]) -> DataFrame:
    """``perm`` and the matrix (row by row) of sums over features of products of the design columns' sums with each feature."""
    wide = len(columns)
    schema = T.StructType([T.StructField("perm", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def square(taxa: list, sums: np.ndarray, seen: np.ndarray, perms: np.ndarray) -> pd.DataFrame:
        found = np.einsum("ifk,jfk->kij", sums, sums).reshape(-1)
        return pd.DataFrame({"perm": np.repeat(perms, wide * wide).astype("int32"), "cell": np.tile(np.arange(wide * wide, dtype="int32"), len(perms)), "v": found})

    parts = products(cells, sample, feature, value, designs, columns, square, schema)
    added = parts.groupBy("perm", "cell").agg(F.sum("v").alias("v"))
    return added.groupBy("perm").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda x: x["v"]).alias("gram"))


def grams(cells: DataFrame, sample: str, feature: str, value: str, designs: Shuffled, columns: list[str]) -> DataFrame:
    """``perm``, the matrix of :func:`gram`, and ``cross``, that of products of permutation 0 with the permutation."""
    wide = len(columns)
    schema = T.StructType([T.StructField("perm", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def square(taxa: list, sums: np.ndarray, seen: np.ndarray, perms: np.ndarray) -> pd.DataFrame:
        found = np.stack([np.einsum("ifk,jfk->kij", sums, sums), np.einsum("if,jfk->kij", sums[:, :, 0], sums)], axis=1)
        kept = slice(None) if len(perms) < 2 or perms[1] == 1 else slice(1, None)  # permutation 0 is in every chunk
        found, perms = found[kept].reshape(-1), perms[kept]
        size = 2 * wide * wide
        return pd.DataFrame({"perm": np.repeat(perms, size).astype("int32"), "cell": np.tile(np.arange(size, dtype="int32"), len(perms)), "v": found})

    parts = products(cells, sample, feature, value, designs, columns, square, schema, observed=True)
    added = parts.groupBy("perm", "cell").agg(F.sum("v").alias("v"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda x: x["v"])
    both = added.groupBy("perm").agg(every.alias("x"))
    return both.select("perm", F.slice("x", 1, wide * wide).alias("gram"), F.slice("x", wide * wide + 1, wide * wide).alias("cross"))


def own_products(designs: Shuffled, sample: str, columns: list[str]) -> DataFrame:
    """``perm`` and ``own``, the products of the design itself with each permutation of it, row by row; for designs that are packable."""
    wide = len(columns)
    numbered = numbered_rows(designs.rows.select(sample, *columns), sample)
    tasks = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(min(-(-(designs.count + 1) // tasks), CHUNK_VALUES // max(numbered.count(), 1)), 1)

    def run(table: pa.Table, perms: np.ndarray, to: np.ndarray) -> pa.Table:
        values = np.column_stack([table.column(c).to_numpy() for c in columns])
        found = [(values.T @ values[at]).ravel().tolist() for at in to]
        return pa.table({"perm": pa.array(perms, pa.int32()), "own": pa.array(found, pa.list_(pa.float64()))})

    schema = T.StructType([T.StructField("perm", T.IntegerType()), T.StructField("own", T.ArrayType(T.DoubleType()))])
    return permuted_chunks(numbered, sample, columns, designs.count, each, designs.seed, run, schema)
