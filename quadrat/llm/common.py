"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What separates words: space and the control characters 9 to 13, as bytes.split() does.
SPACES = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def schema_of(df: DataFrame, *columns: str, **added: T.DataType) -> T.StructType:
    """Fields of ``columns`` as they are in ``df``, then the added ones; all may be null."""
    own = [T.StructField(c, df.schema[c].dataType) for c in columns]
    return T.StructType(own + [T.StructField(name, kind) for name, kind in added.items()])


def map_rows(
    df: DataFrame, columns: list[str], schema: T.StructType, fn: Callable[[Iterator[list[list]]], Iterator[list[list]]]
) -> DataFrame:
    """``fn`` turns lists of column values, batch after batch, into lists (or Arrow arrays) of the schema's columns.

    Only ``columns`` are read, so other columns, whatever their names, never reach the task.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = ([batch.column(c).to_pylist() for c in columns] for batch in batches)
        for out in fn(values):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow
            )

    return df.select(*columns).mapInArrow(run, schema)


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(parts))


def bounded_sample(df: DataFrame, key: str, rows: int, by: str | None = None) -> DataFrame:
    """About ``rows`` rows (of each value of ``by``), chosen by a hash of the key.

    Which rows are taken depends on the keys and the counts alone, not on partitions or
    retries.  A table with fewer rows is taken whole.  Rows whose key or group is null are
    never taken.
    """
    known = df.filter(F.col(key).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True)))
    spot = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    if by is None:
        total = known.count()
        return known.filter(spot < rows / max(total, 1))
    counts = {r[0]: r[1] for r in known.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, total in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(by) == F.lit(value), F.lit(rows / total)).otherwise(share)
    return known.filter(spot < share)
