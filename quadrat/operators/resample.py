"""Repeatable resampling: order comes from a digest of the keys, not from a random state.

A digest gives the same order on every engine, on every retry of a lost task and
under any partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.operators.rank import hash_rank, number_rows, slice_digits
from quadrat.session import cut_lineage, spread


def digest(seed: int, *parts: Column | str) -> Column:
    """md5 of the seed and the parts as 32 hex digits."""
    columns = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


# ---------------------------------------------------------------- rarefaction

CHUNK_READS = 100_000


def rarefy(
    cells: DataFrame, sample: str, feature: str, value: str, depth: Column, iterations: int, seed: int = 1
) -> DataFrame:
    """Draw ``depth`` reads per sample without replacement, ``iterations`` times.

    Every read has a digest; a draw keeps the reads with the smallest ones.
    Digests are uniform, so counting reads by leading hex digits finds the slice in
    which the draw ends.  Reads in earlier slices are counted on the map side,
    and only reads of that one slice (about the square root of the sample) are
    ordered.  Reads as such are never shuffled.  Samples below ``depth`` drop out.
    """
    totals = cells.groupBy(sample).agg(F.sum(value).alias("__total"))
    deep = totals.withColumn("__depth", depth.cast("long")).where(F.col("__total") >= F.col("__depth"))
    deep = deep.withColumn("__digits", slice_digits(F.col("__total")))
    base = cells.where(F.col(value) > 0).select(sample, feature, value).join(deep.drop("__total"), sample)

    def reads_of(rows: DataFrame, *carried: Column) -> DataFrame:
        # one row per iteration and stretch of reads, spread out, so that a cell with
        # very many reads is unfolded by many tasks
        last = F.floor((F.col(value) - 1) / F.lit(CHUNK_READS))
        pieces = rows.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
        pieces = pieces.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        pieces = pieces.select("iter", sample, feature, value, "__piece", "__digits", *carried)
        pieces = spread(pieces, sample, feature, "iter", "__piece")
        first = F.col("__piece") * CHUNK_READS + 1
        until = F.least(first + CHUNK_READS - 1, F.col(value).cast("long"))
        units = pieces.withColumn("__unit", F.explode(F.sequence(first, until)))
        units = units.withColumn("__digest", digest(seed, "iter", sample, feature, "__unit"))
        return units.withColumn("__slice", F.substring(F.col("__digest"), F.lit(1), F.col("__digits")))

    sizes = reads_of(base, F.col("__depth")).groupBy(sample, "__depth", "iter", "__slice").agg(F.count("*").alias("__rows"))
    upto = F.sum("__rows").over(
        W.partitionBy(sample, "iter").orderBy("__slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    last = (
        sizes.withColumn("__upto", upto)
        .where((F.col("__upto") >= F.col("__depth")) & (F.col("__upto") - F.col("__rows") < F.col("__depth")))
        .groupBy(sample)
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        "iter",
                        F.struct(
                            F.col("__slice").alias("slice"),
                            (F.col("__depth") - F.col("__upto") + F.col("__rows")).alias("missing"),
                        ),
                    )
                )
            ).alias("__last")
        )
    )
    end = F.col("__last")[F.col("iter")]
    units = reads_of(base.join(last, sample), end["slice"].alias("__end"), end["missing"].alias("__missing"))
    # reads of earlier slices fold into one row per feature; only reads of the last slice keep their digest
    edge = F.when(F.col("__slice") == F.col("__end"), F.col("__digest"))
    folded = (
        units.where(F.col("__slice") <= F.col("__end"))
        .groupBy("iter", sample, feature, "__missing", edge.alias("__edge"))
        .agg(F.count("*").alias("__n"))
    )
    order = W.partitionBy("iter", sample, F.col("__edge").isNull()).orderBy("__edge", feature)
    kept = folded.withColumn("__rank", F.row_number().over(order)).where(
        F.col("__edge").isNull() | (F.col("__rank") <= F.col("__missing"))
    )
    return kept.groupBy("iter", sample, feature).agg(F.sum("__n").alias(value))


#: Draws beyond this many standard deviations from the mean have a chance below 1e-30 and are left out of the sums.
REACH = 12.0
#: Samples that one task draws from at once, about.
PACKED_SAMPLES = 16


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in (0, 1) from the first 13 digits of the digest of the parts."""
    return (F.conv(F.substring(digest(seed, *parts), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(u: np.ndarray, total: np.ndarray, good: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The smallest x of which the distribution reaches u: hits among ``take`` of ``total`` items of which ``good`` count.

    All arguments are arrays of one length.  The chances are summed over the whole support or, where that is
    wide, over REACH standard deviations on either side of the mean.
    """
    total, good, take = (np.asarray(x, dtype=np.float64) for x in (total, good, take))
    low, high = np.maximum(0.0, take - (total - good)), np.minimum(good, take)
    mean = take * good / np.maximum(total, 1)
    spread = np.sqrt(np.maximum(mean * (1 - good / np.maximum(total, 1)) * (total - take) / np.maximum(total - 1, 1), 0.0))
    first = np.maximum(low, np.floor(mean - REACH * spread - REACH))
    last = np.minimum(high, np.ceil(mean + REACH * spread + REACH))
    out = np.empty(len(u), np.int64)
    width = (last - first).astype(np.int64)
    # rows of like width together, so that few cells of a block are idle
    for level in np.unique(np.ceil(np.log2(width + 1)).astype(int)):
        here = np.flatnonzero(np.ceil(np.log2(width + 1)).astype(int) == level)
        for begin in range(0, len(here), max(1_000_000 >> level, 1)):
            at = here[begin : begin + max(1_000_000 >> level, 1)]
            n, g, k, begin_at, end_at = (v[at, None] for v in (total, good, take, first, last))
            x = begin_at + np.arange(int(width[at].max()))
            # the chance of x + 1 over that of x; beyond the last it is nothing
            with np.errstate(divide="ignore"):
                steps = np.log(np.where(x < end_at, (g - x) * (k - x) / ((x + 1) * np.maximum(n - g - k + x + 1, 1)), 0.0))
            logs = np.concatenate([np.zeros((len(at), 1)), np.cumsum(steps, axis=1)], axis=1)
            logs -= logs.max(axis=1, keepdims=True)
            sums = np.cumsum(np.exp(logs), axis=1)
            out[at] = (first[at] + (sums < u[at, None] * sums[:, -1:]).sum(axis=1)).astype(np.int64)
    return np.minimum(out, last.astype(np.int64))


def draw_counts(u: np.ndarray, counts: np.ndarray, take: np.ndarray) -> np.ndarray:
    """How many of ``take`` reads drawn without replacement are of each feature, for each draw (features x draws).

    Feature after feature: what one takes is hypergeometric among the reads of it and all later features.
    ``u`` holds a uniform number for each feature and draw; ``counts`` has one column, or one for each draw.
    """
    take = np.asarray(take, dtype=np.int64).copy()
    counts = np.broadcast_to(counts if counts.ndim == 2 else counts[:, None], (len(counts), len(take)))
    left = counts.sum(axis=0)
    out = np.zeros(counts.shape, dtype=np.int64)
    for i, own in enumerate(counts):
        got = hypergeometric(u[i], left, own, take)
        out[i], left, take = got, left - own, take - got
    return out


def rarefy_draw(
    cells: DataFrame,
    sample: str,
    feature: str,
    value: str,
    depth: Column,
    iterations: int,
    seed: int = 1,
    bucket_features: int = 1000,
) -> DataFrame:
    """``depth`` reads per sample without replacement, ``iterations`` times, drawn from the counts themselves.

    Time follows the cells and the draws, not the reads.  The features of a sample are numbered in their order and cut
    into buckets of bounded size; a first draw shares the depth among the buckets, in their order, then each
    bucket draws on its own, which is the same distribution as one draw over all features.  A draw
    inverts the distribution at a uniform number that is a digest of seed, draw, sample and feature, so it is
    the same on every engine and retry.  Samples below ``depth`` drop out.
    """
    known = cells.where(F.col(value) > 0).select(sample, feature, F.col(value).cast("long").alias("__c"))
    stats = known.groupBy(sample).agg(F.sum("__c").alias("__total"), F.count("*").alias("__n"))
    deep = stats.withColumn("__depth", depth.cast("long")).where("__total >= __depth")
    # numbers inside a sample come from a sort by ranges, so no task orders a whole sample
    placed = number_rows(known.join(deep, sample), [sample, feature], "__r")
    first = placed.groupBy(sample).agg((F.min("__r")).alias("__first"))
    base = placed.join(first, sample).withColumn("__bucket", F.floor((F.col("__r") - F.col("__first")) / bucket_features))
    base = base.select(sample, feature, "__c", "__n", "__depth", "__bucket")
    sample_type, feature_type = cells.schema[sample].dataType, cells.schema[feature].dataType
    share_schema = T.StructType(
        [T.StructField(sample, sample_type), T.StructField("__bucket", T.LongType()), T.StructField("__take", T.ArrayType(T.LongType()))]
    )
    each = F.sequence(F.lit(1), F.lit(iterations))

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__bucket")
        takes = draw_counts(np.stack(rows["__u"].to_list()), rows["__reads"].to_numpy(), np.full(iterations, int(rows["__depth"].iloc[0])))
        return pd.DataFrame({sample: rows[sample].to_numpy(), "__bucket": rows["__bucket"].to_numpy(), "__take": list(takes)})

    # most samples fit one bucket, which takes the whole depth; only the others need a draw among buckets
    split = base.where(F.col("__n") > bucket_features).groupBy(sample, "__depth", "__bucket").agg(F.sum("__c").alias("__reads"))
    split = split.withColumn("__u", F.transform(each, lambda i: uniform(seed, i, F.col(sample), F.lit("bucket"), F.col("__bucket"))))
    shares = spread(split, sample).groupBy(sample).applyInPandas(share, share_schema)
    whole = deep.where(F.col("__n") <= bucket_features).select(
        sample, F.lit(0).cast("long").alias("__bucket"), F.array_repeat("__depth", F.lit(iterations)).alias("__take")
    )
    shares = shares.unionByName(whole)
    out_schema = T.StructType(
        [
            T.StructField("iter", T.IntegerType()),
            T.StructField(sample, sample_type),
            T.StructField(feature, feature_type),
            T.StructField(value, T.LongType()),
        ]
    )

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        # several samples at once, their draws side by side
        units = [own.sort_values(feature) for _, own in rows.groupby([sample, "__bucket"], dropna=False)]
        u, counts = (np.zeros((max(map(len, units)), len(units) * iterations), kind) for kind in (np.float64, np.int64))
        for n, own in enumerate(units):
            columns = slice(n * iterations, (n + 1) * iterations)
            u[: len(own), columns] = np.stack(own["__u"].to_list())
            counts[: len(own), columns] = own["__c"].to_numpy()[:, None]
        drawn = draw_counts(u, counts, np.concatenate([np.asarray(own["__take"].iloc[0]) for own in units]))
        frames = []
        for n, own in enumerate(units):
            part = drawn[: len(own), n * iterations : (n + 1) * iterations]
            j, i = np.nonzero(part)
            frames.append(pd.DataFrame({"iter": (i + 1).astype("int32"), sample: own[sample].iloc[0], feature: own[feature].to_numpy()[j], value: part[j, i]}))
        return pd.concat(frames)

    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = max(8 * tasks, -(-deep.count() // PACKED_SAMPLES))
    together = base.select(sample, feature, "__c", "__bucket").join(shares, [sample, "__bucket"])
    together = together.withColumn("__pack", F.pmod(F.xxhash64(sample, "__bucket"), F.lit(packs)))
    together = spread(together, "__pack").withColumn("__u", F.transform(each, lambda i: uniform(seed, i, F.col(sample), F.col(feature))))
    return together.groupBy("__pack").applyInPandas(pick, out_schema)


def replicate_mean(drawn: DataFrame, sample: str, feature: str, value: str, iterations: int, distinct_values: bool = False):
    """Mean count over all iterations; a draw without the feature counts as zero.

    ``distinct_values`` gives the mean of the different values instead, zero among
    them when some draw missed the feature.
    """
    if not distinct_values:
        return drawn.groupBy(sample, feature).agg((F.sum(value) / F.lit(iterations)).alias("mean_reads"))
    seen = F.count("*")
    per_value = drawn.groupBy(sample, feature, value).agg(seen.alias("__times"))
    missed = F.when(F.sum("__times") < iterations, 1).otherwise(0)
    return per_value.groupBy(sample, feature).agg((F.sum(value) / (F.count("*") + missed)).alias("mean_reads"))


# ---------------------------------------------------------------- permutations


def permutations(members: DataFrame, key: str, carried: list[str], count: int, seed: int = 1) -> DataFrame:
    """``count`` reshuffles of the carried columns over the keys; ``perm`` 0 is the table itself.

    In permutation p the key ranked r by its digest receives the values of the key
    ranked r by the base digest.  Ranks are exact and no task sees a whole permutation.
    """
    total = members.agg(F.count("*").alias("n")).scalar()
    rows = members.withColumn("__digits", slice_digits(total))
    base = hash_rank(
        rows.withColumn("__digest", digest(seed, F.lit(0), key)), [], "__digest", "__rank", F.col("__digits"), [key]
    ).select("__rank", *carried)
    shuffled = rows.select(key, "__digits").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(count))))
    shuffled = shuffled.withColumn("__digest", digest(seed, "perm", key))
    ranked = hash_rank(shuffled, ["perm"], "__digest", "__rank", F.col("__digits"), [key])
    drawn = ranked.join(base, "__rank").select("perm", key, *carried)
    return members.select(F.lit(0).alias("perm"), key, *carried).unionByName(drawn)


#: Keys of which one task orders whole permutations; more of them go through :func:`permutations`.
PACKED_KEYS = 1_000_000


def numbered_rows(members: DataFrame, key: str) -> DataFrame:
    """The rows with ``__i``, their number from 0 in the order of the keys."""
    return cut_lineage(number_rows(members, [key], "__i").withColumn("__i", (F.col("__i") - 1).cast("int")))


def _by_digest(start: str, ends: list[bytes]) -> np.ndarray:
    """Numbers of the rows in the order of their digests; of equal ones in their own."""
    begin = start.encode()
    both = np.frombuffer(b"".join([hashlib.md5(begin + e).digest() for e in ends]), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.lexsort((both[:, 1], both[:, 0]))


def permuted_chunks(
    rows: DataFrame, key: str, columns: list[str], count: int, each: int, seed: int, run: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: T.StructType, observed: bool = False
) -> DataFrame:
    """The reshuffles of :func:`permutations`, a chunk of ``each`` in a task, as numbers of rows.

    ``rows`` come from :func:`numbered_rows`, at most ``PACKED_KEYS`` of them.  ``run`` gets their columns in the order of the numbers, the
    permutations of the chunk (0 is the table itself), and for each of them the row whose values each row receives.  So keys are
    sent once to each chunk, and no row is multiplied by the permutations.  With ``observed`` permutation 0 is the first of every chunk.
    """
    own, shift = (each - 1, 1) if observed else (each, 0)
    chunks = max(-(-(count + 1 - shift) // own), 1)
    end = F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit(""))
    sent = rows.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("__chunk"), "__i", end.alias("__end"), *columns)

    def chunk_of(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("__i").to_numpy(), kind="stable")))
        first = int(table.column("__chunk")[0].as_py()) * own + shift
        perms = np.arange(first, min(first + own, count + 1))
        perms = np.r_[0, perms] if observed else perms
        ends = [e.encode() for e in table.column("__end").to_pylist()]
        base = _by_digest(f"{seed}|0", ends).astype(np.int32)
        to = np.empty((len(perms), len(ends)), np.int32)
        for k, perm in enumerate(perms.tolist()):
            if perm:
                to[k, _by_digest(f"{seed}|{perm}", ends)] = base
            else:
                to[k] = np.arange(len(ends))
        return run(table.select(columns), perms, to)

    return spread(sent, "__chunk").groupBy("__chunk").applyInArrow(chunk_of, schema)


def permutation_sql(source: str, key: str, carried: list[str], count: int, seed: int = 1, name: str = "perms") -> str:
    """The same reshuffles as SQL table expressions."""
    columns = ", ".join(carried)
    return f"""{name}_base as (select *, row_number() over (order by md5('{seed}|0|' || {key}), {key}) as r from {source}),
{name}_rank as (select p.perm, {key}, row_number() over (partition by p.perm order by md5('{seed}|' || p.perm || '|' || {key}), {key}) as r
  from {source}, (select unnest(range(1, {count + 1})) as perm) p),
{name} as (select 0 as perm, {key}, {columns} from {source}
  union all select k.perm, k.{key}, {', '.join('b.' + c for c in carried)} from {name}_rank k join {name}_base b on k.r = b.r)"""


def rarefy_sql(source: str, depth: str, iterations: int, seed: int = 1, name: str = "rare") -> str:
    """The draw from counts as recursive SQL, for samples whose features fit one bucket: feature after feature."""
    pmf = "exp({top} - lgamma(x + 1) - lgamma(own - x + 1) - lgamma(take - x + 1) - lgamma(rest - own - take + x + 1))"
    top = "lgamma(own + 1) + lgamma(take + 1) + lgamma(rest - own + 1) + lgamma(rest - take + 1) - lgamma(rest + 1)"
    return f"""{name}_cells as (select sample, feature, cast(reads as bigint) as own, row_number() over (partition by sample order by feature) as i,
  cast(sum(reads) over (partition by sample) as bigint) as total from {source} where reads > 0),
{name}_chain as (
  select cast(iter as integer) as iter, sample, cast(0 as bigint) as i, any_value(feature) as feature, any_value(total) as rest, cast(any_value(dep) as bigint) as take,
         cast(0 as bigint) as got
  from {name}_cells, ({depth}) t(dep), (select unnest(range(1, {iterations + 1})) as iter) where total >= dep group by iter, sample
  union all
  select iter, sample, i, feature, rest - own, take - got, got from (
    select iter, sample, i, feature, own, rest, take,
           cast(low + list_sum(list_transform(range(1, len(chances) + 1), lambda n: case when list_sum(chances[1:n]) < u * list_sum(chances) then 1 else 0 end)) as bigint) as got
    from (select *, list_transform(range(low, least(own, take) + 1), lambda x: {pmf.format(top=top)}) as chances from (
      select k.iter, k.sample, c.i, c.feature, c.own, k.rest, k.take, greatest(0, k.take - (k.rest - c.own)) as low,
             (('0x' || substr(md5('{seed}|' || k.iter || '|' || k.sample || '|' || c.feature), 1, 13))::bigint + 0.5) / 4503599627370496.0::double as u
      from {name}_chain k join {name}_cells c on c.sample = k.sample and c.i = k.i + 1))
  )
),
{name} as (select iter, sample, feature, got as reads from {name}_chain where i > 0 and got > 0)"""


def rarefy_digest_sql(source: str, depth: str, iterations: int, seed: int = 1, name: str = "rare") -> str:
    """The digest draw as SQL: every read ordered, the first ``depth`` kept."""
    return f"""{name}_units as (
  select sample, feature, iter, md5('{seed}|' || iter || '|' || sample || '|' || feature || '|' || unit) as h, unit, dep
  from (select sample, feature, unnest(range(1, reads + 1)) as unit from {source} where reads > 0) u,
       (select unnest(range(1, {iterations + 1})) as iter) i, ({depth}) t(dep)),
{name}_ranked as (select *, row_number() over (partition by iter, sample order by h, feature, unit) as rk,
                         count(*) over (partition by iter, sample) as total from {name}_units),
{name} as (select cast(iter as integer) as iter, sample, feature, count(*) as reads from {name}_ranked
           where rk <= dep and total >= dep group by 1, 2, 3)"""


def at_least_as_large(statistics: DataFrame, keys: list[str], statistic: str, perm: str = "perm") -> DataFrame:
    """Permutation p-value: (1 + permuted values not below the observed) / (1 + permutations).

    Values equal up to rounding count as ties.  Without ``keys`` there must be one observed value.
    """
    observed = statistics.where(F.col(perm) == 0).select(*keys, F.col(statistic).alias("observed"))
    permuted = statistics.where(F.col(perm) > 0)
    both = permuted.join(observed, keys) if keys else permuted.withColumn("observed", observed.scalar())
    tolerance = 1e-9 * F.greatest(F.lit(1.0), F.abs("observed"))
    return both.groupBy(*keys, "observed").agg(
        F.count("*").alias("permutations"),
        ((F.count_if(F.col(statistic) >= F.col("observed") - tolerance) + 1) / (F.count("*") + 1)).alias("p_value"),
    )
