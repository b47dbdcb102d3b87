"""Weighted rendezvous hashing of records over shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that one numbering task should hold, on average.
ROWS_PER_SLICE = 20_000
#: Hex digits of an md5 digest that fit a long and are exact as a double.
_DIGITS = 13


def _unit(key: Column, shard: int) -> Column:
    """A number strictly between 0 and 1 that the key and the shard decide."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard))))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard whose weighted draw for the key is best.

    Shard i draws -ln(u) / weight from its own hash of the key, and the smallest draw wins.  A
    further shard changes no other draw, so it can only take rows to itself.  A tie goes to
    the lower number; a null key is a key like any other; weight 0 takes nothing.
    """
    draws = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("no shard has a weight")
    best = F.least(*(F.struct((-F.log(_unit(key, i)) / F.lit(float(w))).alias("draw"), F.lit(i).alias("shard")) for i, w in draws)) if len(draws) > 1 else None
    return F.lit(draws[0][0]) if best is None else best["shard"]


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown: float = 1.0) -> DataFrame:
    """Shard, place inside the shard, size and checksum of each row.

    Returns the key, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``law``,
    ``shard``, ``slot`` and ``grown_shard`` (with one more shard of weight ``grown``).  A null
    text has size 1 and the checksum of the empty text.  Rows with a null key share a shard.
    Repeated rows get slots of their own; an empty table gives an empty one.

    Slots follow a hash of the key and the text, then the key.  Rows are numbered in slices of
    that hash, and each slice starts after the rows of those before it, so neither a shard nor a
    key that many rows share is ever sorted in one task unless those rows are equal throughout.
    Only hashes and sizes are shuffled, never texts.
    """
    weights = weights or [1.0] * 8
    slices = max(1, df.count() // (ROWS_PER_SLICE * len(weights)))
    value = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(key),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value).alias("text_crc32"),
        F.xxhash64(F.col(key).cast("string"), value).alias("__place"),
    )
    rows = rows.select(
        "*",
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), [*weights, grown]).cast("int").alias("grown_shard"),
        F.pmod("__place", F.lit(slices)).alias("__slice"),
    )
    sizes = rows.groupBy("shard", "__slice").agg(F.count("*").alias("__rows"))
    before = W.partitionBy("shard").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "__slice", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy("shard", "__slice").orderBy("__place", key, "size", "text_crc32")
    placed = rows.withColumn("__inside", F.row_number().over(inside)).join(starts, ["shard", "__slice"])
    return placed.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__start") + F.col("__inside") - 1).cast("long").alias("slot"), "grown_shard",
    )
