"""Ordination and clustering of a pair table."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.operators.pairs import BLOCK_SAMPLES, CommunityPairs, _packed, _unpacked, block_of
from quadrat.session import cut_lineage, remove, shared_folder, written

#: Directions in which each group's extremes are taken.
DIRECTIONS = 16
#: Points that one task takes a hull of at once.
HULL_POINTS = 100_000


def gower_center(pairs: DataFrame | CommunityPairs, members: DataFrame, key: str, distance: str) -> DataFrame:
    """Doubly centred inner products for ``id_a <= id_b``, the diagonal included.

    Row means come from one aggregate over the pair table; the centred value of a
    pair then needs only its two row means and the grand mean.  Members without any pair
    have no place among the others and are left out; a pair without a distance is an error.
    Pairs that are no table yet are made twice, for the sums and for the result, instead of being written.
    """
    if isinstance(pairs, CommunityPairs):
        return _centred_in_tiles(pairs, members, key)
    known = F.when(F.col(distance).isNull(), F.raise_error(F.lit("a pair has no distance"))).otherwise(F.col(distance))
    squared = pairs.select("id_a", "id_b", (known * known).alias("d2"))
    ends = squared.select(F.explode(F.array("id_a", "id_b")).alias(key), "d2")
    sums = members.select(key).join(ends.groupBy(key).agg(F.sum("d2").alias("__s")), key)
    n = sums.agg(F.count("*")).scalar()
    means = sums.select(key, (F.col("__s") / n).alias("__m"))
    grand = means.agg(F.avg("__m")).scalar()
    a = means.select(F.col(key).alias("id_a"), F.col("__m").alias("__ma"))
    b = means.select(F.col(key).alias("id_b"), F.col("__m").alias("__mb"))
    g = -0.5 * (F.col("d2") - F.col("__ma") - F.col("__mb") + grand)
    off = squared.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", g.alias("g"))
    own = means.select(F.col(key).alias("id_a"), F.col(key).alias("id_b"), (-0.5 * (grand - 2 * F.col("__m"))).alias("g"))
    return off.unionByName(own)


def _centred_in_tiles(pairs: CommunityPairs, members: DataFrame, key: str) -> DataFrame:
    """:func:`gower_center` tile by tile."""

    def row_sums(tile) -> Iterator[dict]:
        squares, known = tile.squares(), tile.known() > 0
        for side in (0, 1):
            some = np.flatnonzero(known.any(axis=1 - side))
            yield {key: tile.names[side].take(pa.array(some)), "__d2": squares.sum(axis=1 - side)[some]}

    ends = pairs.visit(row_sums, T.StructType([T.StructField(key, pairs.id_type), T.StructField("__d2", T.DoubleType())]))
    sums = written(members.select(key).join(ends.groupBy(key).agg(F.sum("__d2").alias("__s")), key))
    n, total = sums.agg(F.count("*"), F.sum("__s")).first()
    if not n:
        grand = 0.0
    else:
        grand = total / n / n
    means = written(sums.select(key, (F.col("__s") / F.lit(float(max(n, 1)))).alias("__m")))
    g = -0.5 * (F.col("__d") * F.col("__d") - F.col("__m_a") - F.col("__m_b") + F.lit(grand))
    off = pairs.table("__d", means, key).select("id_a", "id_b", g.alias("g"))
    own = means.select(F.col(key).alias("id_a"), F.col(key).alias("id_b"), (-0.5 * (F.lit(grand) - 2 * F.col("__m"))).alias("g"))
    return off.unionByName(own)


def pcoa(
    pairs: DataFrame | CommunityPairs, members: DataFrame, key: str, distance: str, axes: int = 2, rounds: int = 60, tolerance: float = 1e-7
) -> tuple[DataFrame, list[float], float]:
    """Principal coordinates: scores per sample, eigenvalues, and the share of variance they hold.

    Block subspace iteration.  The centred table is cut into blocks of samples that
    stay on the executors; a round multiplies every block with its slice of the current
    axes and adds the products.  The driver only sees matrices as wide as the number
    of axes, never one as long as the number of samples.  Use a Euclidean distance
    (the square root of Bray-Curtis is one): axes with a negative eigenvalue are dropped.
    Pairs that are no table yet are made once and kept as packed tiles, which no round shuffles.
    """
    width = axes + 4
    if isinstance(pairs, CommunityPairs):
        base, image, trace, done = _packed_tiles(pairs, members, key, width)
    else:
        base, image, trace = _tiles_of_table(pairs, members, key, distance, width)
        done = None
    inner_products = _inner_products(width)

    def whitener(square: np.ndarray) -> np.ndarray:
        """Matrix that makes axes with these inner products orthonormal."""
        values, vectors = np.linalg.eigh((square + square.T) / 2)
        keep = values > values.max() * 1e-14
        return vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)

    # the axes are always ``base @ matrix``; only the product with the table is written out
    matrix = whitener(inner_products(base, base)[1])
    previous = np.zeros(width)
    for _ in range(rounds):
        moved = written(image(base, matrix))  # a checkpoint would make it twice
        cross, own = inner_products(base, moved)
        projected = matrix.T @ cross
        values, vectors = np.linalg.eigh((projected + projected.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        final, best = base, matrix @ vectors
        settled = np.max(np.abs(values[:axes] - previous[:axes])) <= tolerance * max(abs(values[0]), 1e-300)
        previous = values
        if settled:
            break
        base, matrix = moved, whitener(own)
    else:
        warnings.warn(f"principal coordinates have not settled to {tolerance:g} in {rounds} rounds", RuntimeWarning, stacklevel=2)
    if done is not None:
        done()
    kept = [i for i in range(axes) if previous[i] > 0]
    scale = [float(np.sqrt(previous[i])) for i in kept]
    score_schema = T.StructType([members.schema[key]] + [T.StructField(f"axis{i + 1}", T.DoubleType()) for i in kept])

    def scores(frames):
        for frame in frames:
            for names, v in zip(frame["ids"], frame["v"], strict=True):
                v = np.asarray(v).reshape(-1, width) @ best
                columns = {f"axis{i + 1}": v[:, i] * s for i, s in zip(kept, scale, strict=True)}
                yield pd.DataFrame({key: np.asarray(names), **columns})

    return final.mapInPandas(scores, score_schema), [float(previous[i]) for i in kept], float(sum(previous[i] for i in kept) / trace)


def _axis_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("__block", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("v", T.ArrayType(T.DoubleType()))])


def _started(listed: DataFrame, width: int, schema: T.StructType) -> DataFrame:
    """Random axes for blocks of ids; those of a block depend on its number only."""

    def start(frames):
        for frame in frames:
            values = []
            for block, names in zip(frame["__block"], frame["ids"], strict=True):
                rng = np.random.default_rng(int(block))
                values.append(rng.standard_normal((len(names), width)).ravel())
            yield frame.assign(v=values)

    return listed.mapInPandas(start, schema)


def _hash_blocks(members: DataFrame, key: str) -> DataFrame:
    """``__block`` and the sorted ``ids`` of hash blocks of the members."""
    blocks = members.agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SAMPLES)), F.lit(1)).alias("b")).scalar()
    ids = members.select(key).withColumn("__block", block_of(F.col(key), blocks))
    return ids.groupBy("__block").agg(F.sort_array(F.collect_list(key)).alias("ids"))


def _inner_products(width: int):
    def inner_products(base: DataFrame, moved: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """``base' moved`` and ``moved' moved``, two matrices as wide as the axes."""
        met = base.select("__block", F.col("v").alias("a")).join(moved.select("__block", F.col("v").alias("b")), "__block")

        def inner(frames):
            for frame in frames:
                total = np.zeros((2, width, width))
                for a, b in zip(frame["a"], frame["b"], strict=True):
                    a, b = np.asarray(a).reshape(-1, width), np.asarray(b).reshape(-1, width)
                    total += np.stack([a.T @ b, b.T @ b])
                yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

        sums = met.select("a", "b").mapInPandas(inner, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
        out = np.zeros(2 * width * width)
        for r in sums.collect():
            out[r["i"]] = r["x"]
        cross, own = out.reshape(2, width, width)
        return cross, own

    return inner_products


def _tiles_of_table(pairs: DataFrame, members: DataFrame, key: str, distance: str, width: int):
    """First axes, the product of the centred table with axes, and its trace."""
    pairs = cut_lineage(pairs.select("id_a", "id_b", distance))
    paired = pairs.select(F.explode(F.array("id_a", "id_b")).alias(key)).distinct()
    members = members.select(key).join(paired, key, "left_semi")
    blocks = members.agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SAMPLES)), F.lit(1)).alias("b")).scalar()
    centred = gower_center(pairs, members, key, distance)
    here, there = F.struct("id_a", "id_b"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))
    ways = F.when(F.col("id_a") == F.col("id_b"), F.array(here)).otherwise(F.array(here, there))
    both = centred.select(F.explode(ways).alias("e"), "g").select("e.id_a", "e.id_b", "g")
    squares = pairs.agg(F.sum(F.col(distance) * F.col(distance)).alias("s")).withColumn(
        "n", members.agg(F.count("*")).scalar()
    )
    trace = squares.select(F.col("s") / F.col("n")).first()[0]
    id_list = T.ArrayType(members.schema[key].dataType)
    numbers = T.ArrayType(T.DoubleType())
    tile_schema = T.StructType(
        [T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType())]
        + [T.StructField("rows", id_list), T.StructField("cols", id_list), T.StructField("m", numbers)]
    )

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        a, i = np.unique(rows["id_a"].to_numpy(), return_inverse=True)
        b, j = np.unique(rows["id_b"].to_numpy(), return_inverse=True)
        m = np.zeros((len(a), len(b)))
        m[i, j] = rows["g"].to_numpy()
        return pd.DataFrame({"p": [rows["p"].iloc[0]], "q": [rows["q"].iloc[0]], "rows": [a], "cols": [b], "m": [m.ravel()]})

    placed = both.withColumns({"p": block_of(F.col("id_a"), blocks), "q": block_of(F.col("id_b"), blocks)})
    tiles = cut_lineage(placed.groupBy("p", "q").applyInPandas(pack, tile_schema))

    axis_schema = _axis_schema(members.schema[key].dataType)

    def image(base: DataFrame, matrix: np.ndarray) -> DataFrame:
        """Product of the centred table with the axes ``base @ matrix``."""

        def multiply(frames):
            for frame in frames:
                out = []
                for m, v in zip(frame["m"], frame["v"], strict=True):
                    v = np.asarray(v).reshape(-1, width)
                    out.append((np.asarray(m).reshape(-1, len(v)) @ (v @ matrix)).ravel())
                yield pd.DataFrame({"__block": frame["p"], "ids": frame["rows"], "v": out})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.sum(np.stack(rows["v"].to_list()), axis=0)
            return pd.DataFrame({"__block": [rows["__block"].iloc[0]], "ids": [rows["ids"].iloc[0]], "v": [total]})

        met = tiles.join(base.select(F.col("__block").alias("q"), "v"), "q").select("p", "rows", "m", "v")
        return met.mapInPandas(multiply, axis_schema).groupBy("__block").applyInPandas(add, axis_schema)

    return _started(_hash_blocks(members, key), width, axis_schema), image, trace


def _packed_tiles(pairs: CommunityPairs, members: DataFrame, key: str, width: int):
    """First axes, the product of the centred table with axes, its trace, and how to remove the tiles.

    The squared distances of the members are written as packed tiles, in buckets by tile, so each round sends the axes to
    them and never them.  Row and grand means are taken off the product instead of every place of the table.
    """
    spark, known = pairs.spark, pairs.prepared()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paired = known["samples"] if known["count"] > 1 else known["samples"].limit(0)
    own = members.select(F.col(key).alias("__sample")).distinct().withColumn("__own", F.lit(True))
    every = written(paired.join(own, "__sample", "left").select(F.col("__sample").alias(key), F.col("s").alias("__s"), F.coalesce("__own", F.lit(False)).alias("__own")))
    inside = every.where("__own")
    n = inside.count()
    whole = T.IntegerType()
    tile_schema = T.StructType([T.StructField("p", whole), T.StructField("q", whole), *(T.StructField(c, T.BinaryType()) for c in ("m", "sums_p", "sums_q")), T.StructField("total", T.DoubleType())])

    def pack(tile) -> Iterator[dict]:
        if not tile.about:
            return
        squares, sides = tile.squares(), []
        for (at, table), size in zip(tile.about, squares.shape, strict=True):
            sides.append(np.zeros(size, bool))  # a sample without a name has no row
            sides[-1][at] = table.column("__own").to_numpy()
        a, b = sides
        sums = [squares.sum(axis=1 - side)[some].tobytes() for side, some in ((0, a), (1, b))]
        yield {"p": [tile.key[0]], "q": [tile.key[1]], "m": [_packed(squares[a][:, b])], "sums_p": [sums[0]], "sums_q": [sums[1]], "total": [float(squares.sum())]}

    name = f"tiles_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    made = pairs.visit(pack, tile_schema, every.select(key, "__own"), key)
    made.write.bucketBy(tasks, "p", "q").option("path", path).format("parquet").saveAsTable(name)
    tiles = spark.table(name)

    block = F.floor(F.col("__s") / known["size"]).cast("int").alias("__block")
    id_type = members.schema[key].dataType
    schema = _axis_schema(id_type)
    lone = _started(_hash_blocks(inside, key), width, schema)
    numbers = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.struct(F.element_at("ids", i + 1).alias(key), F.slice("v", i * width + 1, width).alias("v")))
    lone = lone.select(F.inline(numbers)).join(inside.select(key, "__s"), key)
    ordered = F.array_sort(F.collect_list(F.struct("__s", key, "v")))
    base = lone.groupBy(block).agg(ordered.alias("x")).select("__block", F.col(f"x.{key}").alias("ids"), F.flatten("x.v").alias("v"))
    base = cut_lineage(base)

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in rows["sums"]], axis=0)
        return pd.DataFrame({"__block": [rows["__block"].iloc[0]], "m": [total / n]})

    ends = tiles.select(F.col("p").alias("__block"), F.col("sums_p").alias("sums")).unionByName(tiles.select(F.col("q").alias("__block"), F.col("sums_q").alias("sums")))
    means = cut_lineage(ends.where(F.length("sums") > 0).groupBy("__block").applyInPandas(added, "__block int, m array<double>"))
    # ``avg`` of the row means, and the sum of all squares over the number of members
    grand = (means.agg(F.sum(F.aggregate("m", F.lit(0.0), lambda t, x: t + x))).first()[0] or 0.0) / max(n, 1)
    trace = (tiles.agg(F.sum("total")).first()[0] or 0.0) / max(n, 1)

    def image(base: DataFrame, matrix: np.ndarray) -> DataFrame:
        """Product of the centred table with the axes ``base @ matrix``."""

        def sums(frames):
            for frame in frames:
                out = np.zeros((2, width))
                for v, m in zip(frame["v"], frame["m"], strict=True):
                    v = np.asarray(v).reshape(-1, width)
                    out += np.stack([v.sum(axis=0), np.asarray(m) @ v])
                yield pd.DataFrame({"i": np.arange(out.size), "x": out.ravel()})

        ones = np.zeros(2 * width)
        for r in base.join(means, "__block").select("v", "m").mapInPandas(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            ones[r["i"]] = r["x"]
        in_all, by_means = ones.reshape(2, width) @ matrix

        partner = F.explode(F.sequence(F.lit(0), F.lit(known["blocks"] - 1))).alias("j")
        sent = base.select("__block", "v", partner).select("v", F.least("__block", "j").alias("p"), F.greatest("__block", "j").alias("q"), "__block")
        first = sent.where("__block = p").select("p", "q", F.col("v").alias("vp"))
        second = sent.where("__block = q").select("p", "q", F.col("v").alias("vq"))

        def multiply(frames):
            for frame in frames:
                blocks, out = [], []
                for p, q, m, vp, vq in zip(frame["p"], frame["q"], frame["m"], frame["vp"], frame["vq"], strict=True):
                    vp, vq = (np.asarray(v).reshape(-1, width) @ matrix for v in (vp, vq))
                    m = _unpacked(m, len(vp))
                    blocks += [p, q]
                    out += [(m @ vq).ravel(), (m.T @ vp).ravel()]
                yield pd.DataFrame({"__block": blocks, "v": out})

        def centre(rows: pd.DataFrame) -> pd.DataFrame:
            about = rows[rows["ids"].notna()].iloc[0]
            total = np.sum(np.stack(rows.loc[rows["ids"].isna(), "v"].to_list()), axis=0).reshape(-1, width)
            total = -0.5 * (total - np.outer(about["v"], in_all) - by_means + grand * in_all)
            return pd.DataFrame({"__block": [rows["__block"].iloc[0]], "ids": [about["ids"]], "v": [total.ravel()]})

        met = tiles.select("p", "q", "m").join(first.join(second, ["p", "q"]), ["p", "q"]).select("p", "q", "m", "vp", "vq")
        parts = met.mapInPandas(multiply, "__block int, v array<double>").select("__block", F.lit(None).cast(T.ArrayType(id_type)).alias("ids"), "v")
        about = base.select("__block", "ids").join(means, "__block").select("__block", "ids", F.col("m").alias("v"))
        return parts.unionByName(about).groupBy("__block").applyInPandas(centre, schema)

    def done() -> None:
        spark.sql(f"drop table {name}")
        remove(spark, path)

    return base, image, trace, done


def _draws(rows: np.ndarray, restarts: int, seed: int, turn: int) -> np.ndarray:
    """A number in (0, 1) for each row, by its hash, and restart."""
    with np.errstate(over="ignore"):
        salt = np.arange(1, restarts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + turn)
        x = rows.view(np.uint64)[:, None] + salt * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def kmeans(
    points: DataFrame, columns: list[str], k: int = 2, restarts: int = 100, seed: int = 1, name: str = "cluster", rounds: int = 50, tolerance: float = 1e-8
) -> DataFrame:
    """The best of several k-means runs by within-cluster sum of squares.

    All restarts go through the points together: a pass finds the next centre of each (in proportion to the squared
    distance from those it has, by a hash of the row), or moves the centres of those that haven't settled.  The driver
    sees a few numbers per restart and centre.
    """
    data = cut_lineage(points)
    if data.where(" or ".join(f"`{c}` is null or isnan(`{c}`)" for c in columns)).limit(1).count():
        raise ValueError("a point has no place")
    wide, each = len(columns), max(1_000_000 // (restarts * k), 1)
    hashed = data.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), F.xxhash64(*data.columns).alias("row"))

    def squared(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances: points x restarts x centres."""
        return sum((x[:, i, None, None] - at[:, :, i]) ** 2 for i in range(wide))

    def portions(frames) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for frame in frames:
            x, row = frame[[f"x{i}" for i in range(wide)]].to_numpy(), frame["row"].to_numpy(np.int64)
            for begin in range(0, len(x), each):
                yield x[begin : begin + each], row[begin : begin + each]

    def next_centres(known: np.ndarray, turn: int) -> np.ndarray:
        def best(frames):
            for x, row in portions(frames):
                far = squared(x, known).min(axis=2) if turn else np.ones((len(x), restarts))
                with np.errstate(divide="ignore"):
                    late = np.where(far > 0, -np.log(_draws(row, restarts, seed, turn)) / far, np.inf)
                first = late.argmin(axis=0)
                yield pd.DataFrame({"r": np.arange(restarts), "late": late[first, np.arange(restarts)], "x": list(x[first])})

        found = hashed.mapInPandas(best, "r int, late double, x array<double>").groupBy("r").agg(F.min(F.struct("late", "x")).alias("m")).collect()
        return np.array([r["m"]["x"] for r in sorted(found, key=lambda r: r["r"])]).reshape(len(found), 1, wide)

    def passed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and sums of the clusters around these centres, restarts x centres x (1 + columns), and the costs."""
        runs = len(at)

        def add(frames):
            total = np.zeros((runs * k, wide + 2))
            for x, _ in portions(frames):
                far = squared(x, at)
                near = far.argmin(axis=2)
                place = (near + np.arange(runs) * k).ravel()
                parts = [np.ones(near.size), *(np.repeat(x[:, i], runs) for i in range(wide)), far.min(axis=2).ravel()]
                total += np.stack([np.bincount(place, p, runs * k) for p in parts], axis=1)
            yield pd.DataFrame({"i": np.arange(runs * k), "s": list(total)})

        sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(wide + 2)]
        out = np.zeros((runs * k, wide + 2))
        for r in hashed.mapInPandas(add, "i int, s array<double>").groupBy("i").agg(*sums).collect():
            out[r["i"]] = r[1:]
        out = out.reshape(runs, k, wide + 2)
        return out[:, :, :-1], out[:, :, -1].sum(axis=1)

    centres = next_centres(np.zeros((restarts, 0, wide)), 0)
    if not len(centres):
        return data.withColumn(name, F.lit(None).cast("int"))
    for turn in range(1, k):
        centres = np.concatenate([centres, next_centres(centres, turn)], axis=1)
    moving = np.arange(restarts)
    for _ in range(rounds):
        sums, _ = passed(centres[moving])
        size = sums[:, :, :1]
        new = np.where(size > 0, sums[:, :, 1:] / np.maximum(size, 1), centres[moving])
        moved = ((new - centres[moving]) ** 2).sum(axis=2).max(axis=1) > tolerance**2
        centres[moving] = new
        moving = moving[moved]
        if not len(moving):
            break
    best = centres[passed(centres)[1].argmin()]
    far = [sum(((F.col(c).cast("double") - float(x)) * (F.col(c).cast("double") - float(x)) for c, x in zip(columns, at, strict=True)), F.lit(0.0)) for at in best]
    near = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far))))
    return data.withColumn(name, near["i"])


def nearest_center(points: DataFrame, key: str, vector: str, centers: DataFrame, center_id: str) -> DataFrame:
    """Assign every point to the nearest of a few fixed centers.

    ``centers`` is a table of k rows, one array each; k is chosen by the caller, so
    the list of centers is carried to the points as one value.
    """
    listed = centers.agg(F.sort_array(F.collect_list(F.struct(F.col(center_id).alias("id"), F.col(vector).alias("c"))))).scalar()

    def squared(center):
        return F.aggregate(
            F.zip_with(F.col(vector), center["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
        )

    distances = F.transform(F.col("__centers"), lambda c: F.struct(squared(c).alias("d2"), c["id"].alias("id")))
    out = points.withColumn("__centers", listed).withColumn("__near", F.array_min(distances))
    return out.select(key, F.col("__near.id").alias(center_id), F.sqrt("__near.d2").alias("distance"))


def group_centroid(scores: DataFrame, group: str, axes: list[str]) -> DataFrame:
    """Mean score per group."""
    return scores.groupBy(group).agg(*[F.avg(a).alias(a) for a in axes])


def hull_points(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the convex hull corners, counter-clockwise."""
    order = np.lexsort((y, x))
    if len(order) < 3:
        return order

    def half(sequence):
        chain: list[int] = []
        for i in sequence:
            while len(chain) >= 2:
                a, b = chain[-2], chain[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                chain.pop()
            chain.append(int(i))
        return chain

    lower, upper = half(order), half(order[::-1])
    return np.array(lower[:-1] + upper[:-1])


def _outer(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """The points that aren't clearly inside the polygon of the extremes of their group."""
    angles = [2 * np.pi * i / DIRECTIONS for i in range(DIRECTIONS)]
    along = [F.col(x) * float(np.cos(a)) + F.col(y) * float(np.sin(a)) for a in angles]
    far = points.groupBy(group).agg(*[F.max(v).alias(f"__m{i}") for i, v in enumerate(along)]).withColumnRenamed(group, "__group")
    same = F.col(group).eqNullSafe(F.col("__group"))
    reached = F.filter(F.array(*[F.when(v >= F.col(f"__m{i}"), F.lit(i)) for i, v in enumerate(along)]), lambda i: i.isNotNull())
    # a few rows of each group: one of those that reach furthest in each direction
    ends = points.join(far, same).select("__group", F.col(x).alias("x"), F.col(y).alias("y"), F.explode(reached).alias("i"))
    ends = ends.groupBy("__group", "i").agg(F.min(F.struct("x", "y")).alias("p"))
    polygon = ends.groupBy("__group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda e: e["p"]).alias("__p"))
    after = F.transform("__p", lambda p, i: F.struct(p.alias("a"), F.element_at("__p", F.pmod(i + 1, F.size("__p")) + 1).alias("b")))
    edges = F.filter(after, lambda e: (e["a"]["x"] != e["b"]["x"]) | (e["a"]["y"] != e["b"]["y"]))
    polygon = cut_lineage(polygon.select("__group", edges.alias("__edges")))

    def left_of(e):
        along_x, along_y = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        off_x, off_y = F.col(x) - e["a"]["x"], F.col(y) - e["a"]["y"]
        # clearly left: by more than rounding could make of nothing
        return along_x * off_y - along_y * off_x > 1e-9 * (F.abs(along_x * off_y) + F.abs(along_y * off_x))

    inside = (F.size("__edges") >= 3) & F.forall("__edges", left_of)
    return points.join(polygon, same, "left").where(~F.coalesce(inside, F.lit(False))).select(points.columns)


def group_hull(points: DataFrame, group: str, key: str, x: str, y: str, size: int = HULL_POINTS) -> DataFrame:
    """Corners of the convex hull of every group, numbered counter-clockwise; a corner that several keys share has the smallest.

    Points strictly inside the polygon of each group's extremes in ``DIRECTIONS`` directions can't be corners; they are
    dropped by built-in functions.  A corner of the whole is a corner of any part that has it.  So hulls are first taken
    of the batches in which the points are read, then of parts of about ``size`` of the
    corners that are left, and last of each group.
    """
    schema = T.StructType([points.schema[c] for c in (group, key, x, y)])
    final = T.StructType([*schema.fields, T.StructField("corner", T.IntegerType())])
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, key, x, y)
    known = _outer(known, group, x, y)

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key).drop_duplicates([x, y])
        return rows.iloc[hull_points(rows[x].to_numpy(), rows[y].to_numpy())][[group, key, x, y]]

    def batches(frames):
        for frame in frames:
            parts = [part(rows) for _, rows in frame.groupby(group, dropna=False)]
            if parts:
                yield pd.concat(parts)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = part(rows)
        return out.assign(corner=np.arange(1, len(out) + 1, dtype="int32"))

    corners = cut_lineage(known.mapInPandas(batches, schema))
    sizes = corners.groupBy(group).agg(F.ceil(F.count("*") / F.lit(size)).alias("__parts")).withColumnRenamed(group, "__group")
    salted = corners.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).withColumn("__salt", F.pmod(F.xxhash64(x, y), F.col("__parts")))
    return salted.groupBy(group, "__salt").applyInPandas(part, schema).groupBy(group).applyInPandas(whole, final)
