"""Permutation tests over long tables.

The permuted labels of a sample are one array per sample, so data rows are never
multiplied by the number of permutations before they are shuffled.  Blocks of
samples and features meet their labels in one task and a matrix product does many
permutations at once; what leaves the task is one partial sum per permutation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.scalars import ratio
from quadrat.operators.grouping import kth_row
from quadrat.operators.joins import beside
from quadrat.operators.pairs import BLOCK_SAMPLES, MOST_SAMPLES, CommunityPairs, block_of, tiles_of
from quadrat.operators import permuted
from quadrat.operators.resample import PACKED_KEYS, at_least_as_large, numbered_rows, permutations, permuted_chunks
from quadrat.session import cut_lineage, spread, written

#: Places of permuted rows (4 bytes each) that one task holds.
CHUNK_CELLS = 16_000_000


def label_arrays(perms: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """One array per key and column with the value in each permutation, permutation 0 first."""
    drawn = F.array_sort(F.collect_list(F.struct("perm", *columns)))
    packed = perms.groupBy(key).agg(drawn.alias("__drawn"))
    return packed.select(key, *[F.col(f"__drawn.{c}").alias(name) for c, name in columns.items()])


def _group_codes(members: DataFrame, group: str) -> DataFrame:
    """Number and size of each group; a handful of rows after the aggregate."""
    sizes = members.groupBy(group).agg(F.count("*").alias("__n"))
    return sizes.withColumn("__code", F.row_number().over(W.orderBy(group)) - 1)


def _blocks(members: DataFrame):
    return members.agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SAMPLES)), F.lit(1)).alias("b")).scalar()


# ---------------------------------------------------------------- differences between group centroids


def permanova(
    pairs: DataFrame | CommunityPairs, members: DataFrame, key: str, group: str, distance: str, count: int, seed: int = 1
) -> DataFrame:
    """Permutational analysis of variance on a pair table: one row with df, R2, pseudo-F and p."""
    stats = cut_lineage(permanova_statistics(pairs, members, key, group, distance, count, seed))
    p = at_least_as_large(stats, [], "f")
    observed = stats.where("perm = 0").select("df1", "df2", "ss_total", "ss_within", "r2", "f")
    return beside(observed, p.select("permutations", "p_value"), [])


def permanova_statistics(
    pairs: DataFrame | CommunityPairs, members: DataFrame, key: str, group: str, distance: str, count: int, seed: int = 1
) -> DataFrame:
    """Pseudo-F of the table itself (``perm`` 0) and of every permutation.

    Pairs that are no table yet are never made one: what leaves a tile is one partial sum per permutation.
    """
    members = cut_lineage(members.select(key, group))
    codes = _group_codes(members, group)
    coded = members.join(codes.select(group, "__code"), group).select(key, "__code")
    if isinstance(pairs, CommunityPairs):
        if coded.count() <= PACKED_KEYS:
            others = members.where(F.col(group).isNull()).select(key)
            return _pseudo_f(_sums_in_tiles(pairs, coded, others, codes, key, count, seed), codes)
        pairs = pairs.table(distance)
    perms = permutations(coded, key, ["__code"], count, seed)
    sizes = codes.agg(F.transform(F.array_sort(F.collect_list(F.struct("__code", "__n"))), lambda s: s["__n"])).scalar()
    blocks = _blocks(members)
    labels = label_arrays(perms, key, {"__code": "__codes"}).withColumn("__blocks", blocks)
    labels = labels.withColumn("__sizes", sizes).withColumn("__block", block_of(F.col(key), F.col("__blocks")))
    tile = F.explode(tiles_of(F.col("__block"), F.col("__blocks")))
    labels = labels.withColumn("__tile", tile).select(
        key, "__codes", "__sizes", "__block", F.col("__tile.p").alias("__p"), F.col("__tile.q").alias("__q")
    )
    own = members.select(key)
    known = pairs.join(own.withColumnRenamed(key, "id_a"), "id_a", "left_semi").join(
        own.withColumnRenamed(key, "id_b"), "id_b", "left_semi"
    )
    a, b = block_of(F.col("id_a"), blocks), block_of(F.col("id_b"), blocks)
    placed = known.select("id_a", "id_b", F.col(distance).alias("__d"), F.least(a, b).alias("__p"), F.greatest(a, b).alias("__q"))
    schema = T.StructType(
        [T.StructField("perm", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("total", "within")]
    )

    def sums(rows: pd.DataFrame, tags: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or tags.empty:
            return pd.DataFrame({"perm": np.array([], dtype="int32"), "total": [], "within": []})
        ids = pd.Index(tags[key].to_numpy())
        code = np.stack(tags["__codes"].to_list())
        n = np.asarray(tags["__sizes"].iloc[0])
        square, squares = np.zeros((len(ids), len(ids))), rows["__d"].to_numpy() ** 2
        a, b = ids.get_indexer(rows["id_a"]), ids.get_indexer(rows["id_b"])
        coded = (a >= 0) & (b >= 0)  # members without a group count in the total only
        square[a[coded], b[coded]] = squares[coded]
        within = np.zeros(code.shape[1])
        for g, size in enumerate(n):
            member = (code == g).astype(float)
            within += (member * (square @ member)).sum(axis=0) / size
        total = np.full(code.shape[1], squares.sum() / n.sum())
        return pd.DataFrame({"perm": np.arange(code.shape[1], dtype="int32"), "total": total, "within": within})

    placed, labels = spread(placed, "__p", "__q"), spread(labels, "__p", "__q")
    by_tile = placed.groupBy("__p", "__q").cogroup(labels.groupBy("__p", "__q")).applyInPandas(sums, schema)
    return _pseudo_f(by_tile, codes)


def _sums_in_tiles(pairs: CommunityPairs, coded: DataFrame, others: DataFrame, codes: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``perm`` and each tile's part of the total and the sum within groups; a sample brings its codes in all permutations.

    ``others`` are members without a group, which count in the total only.
    """
    size = np.array([r["__n"] for r in codes.orderBy("__code").select("__n").collect()], dtype=float)  # one row a group
    narrow = np.uint8 if len(size) < 256 else np.int32
    tasks = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered_rows(coded, key)
    each = max(min(-(-(count + 1) // tasks), CHUNK_CELLS // max(rows.count(), 1)), 1)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def moved(table: pa.Table, perms: np.ndarray, to: np.ndarray) -> pa.Table:
        code = table.column("__code").to_numpy().astype(narrow)
        begins = range(0, to.shape[1], MOST_SAMPLES)
        data = [code[to[:, b : b + MOST_SAMPLES]].tobytes() for b in begins]
        return pa.table({"part": pa.array(range(len(data)), pa.int32()), "first": pa.array([int(perms[0])] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    def unpacked(frames):
        for frame in frames:
            for part, found in zip(frame["part"], frame["found"], strict=True):
                every = np.concatenate([np.frombuffer(x["data"], narrow).reshape(min(each, count + 1 - x["first"]), -1) for x in found]).T
                yield pd.DataFrame({"__i": np.arange(len(every), dtype=np.int32) + part * MOST_SAMPLES, "__codes": [x.tobytes() for x in every]})

    packed = permuted_chunks(rows, key, ["__code"], count, each, seed, moved, schema)
    packed = packed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("first", "data"))).alias("found"))
    about = rows.select(key, "__i").join(packed.mapInPandas(unpacked, "__i int, __codes binary"), "__i").drop("__i")
    about = about.unionByName(others.withColumn("__codes", F.lit(np.full(count + 1, len(size), narrow).tobytes())))

    def sums(tile) -> Iterator[dict]:
        square, sides = tile.squares(), []
        for at, table in tile.about:
            sides.append(np.frombuffer(b"".join(table.column("__codes").to_pylist()), narrow).reshape(len(at), count + 1))
        if not sides:
            return
        if any(len(at) != n or (np.diff(at) != 1).any() for (at, _), n in zip(tile.about, square.shape, strict=True)):
            square = square[tile.about[0][0]][:, tile.about[1][0]]
        within = np.zeros(count + 1)
        for g, n in enumerate(size):
            within += np.einsum("ij,ij->j", (sides[0] == g).astype(float), square @ (sides[1] == g).astype(float)) / n
        yield {"perm": np.arange(count + 1, dtype=np.int32), "total": np.full(count + 1, square.sum() / size.sum()), "within": within}

    out = T.StructType([T.StructField("perm", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("total", "within")])
    return pairs.visit(sums, out, written(about), key)


def _pseudo_f(parts: DataFrame, codes: DataFrame) -> DataFrame:
    """Statistics of each permutation from the parts of its sums."""
    added = parts.groupBy("perm").agg(F.sum("total").alias("ss_total"), F.sum("within").alias("ss_within"))
    shape = codes.agg(F.struct(F.count("*").alias("k"), F.sum("__n").alias("n"))).scalar()
    out = added.withColumn("__shape", shape)
    out = out.withColumns({"df1": F.col("__shape.k") - 1, "df2": F.col("__shape.n") - F.col("__shape.k")}).drop("__shape")
    between = F.col("ss_total") - F.col("ss_within")
    return out.withColumns(
        {
            "r2": 1 - ratio(F.col("ss_within"), F.col("ss_total")),
            "f": F.try_divide(between / F.col("df1"), F.col("ss_within") / F.col("df2")),
        }
    )


def group_tests(
    tables: dict[str, DataFrame | CommunityPairs], comparisons: dict[str, tuple[DataFrame, str]], key: str, distance: str, count: int, seed: int = 1
) -> DataFrame:
    """Dispersion and differences of centroids, one row for each pair table and comparison.

    ``comparisons`` maps a name to the samples that take part and the column that groups them.  ``dispersion_*``
    is the analysis of variance of the distances to the group centroids; the others are those of :func:`permanova`.
    Each pair table is written once, whatever the number of comparisons; pairs that are no table yet are made for the samples of each, and never written.
    """
    from quadrat.operators import inference

    rows = []
    for table, pairs in tables.items():
        whole = pairs if isinstance(pairs, CommunityPairs) else cut_lineage(pairs.select("id_a", "id_b", distance))
        for name, (members, group) in comparisons.items():
            members = cut_lineage(members.select(key, group))
            some = whole.among(members, key) if isinstance(whole, CommunityPairs) else whole
            z = cut_lineage(inference.centroid_distances(some, members, key, group, distance))
            spread_of = inference.one_way(z, [], group, "z")
            spread_of = spread_of.select(*[F.col(c).alias(f"dispersion_{c}") for c in ("df1", "df2", "f", "p_value")])
            test = permanova(some, members, key, group, distance, count, seed).drop("ss_total", "ss_within")
            rows.append(beside(test, spread_of, []).select(F.lit(table).alias("distance"), F.lit(name).alias("comparison"), "*"))
    return reduce(DataFrame.unionByName, rows)


# ---------------------------------------------------------------- indicator values


def indicator_value(cells: DataFrame, members: DataFrame, sample: str, feature: str, group: str, value: str) -> DataFrame:
    """Specificity, fidelity and indicator value of every feature for every group it occurs in."""
    from quadrat.operators.composition import group_means
    from quadrat.operators.grouping import with_group

    means = group_means(cells, members, sample, feature, group, value)
    out = with_group(means, [feature], {"__sum": F.sum("mean")})
    out = out.withColumn("specificity", ratio(F.col("mean"), F.col("__sum"))).drop("__sum")
    return out.withColumn("stat", F.sqrt(F.col("specificity") * F.col("fidelity")))


def indicator_test(
    cells: DataFrame,
    members: DataFrame,
    sample: str,
    feature: str,
    group: str,
    value: str,
    levels: list[str],
    count: int,
    seed: int = 1,
    all_groups: bool = True,
) -> DataFrame:
    """Best group of every feature with a permutation p-value.

    The combination of all groups competes too (specificity 1, fidelity the overall
    prevalence) unless ``all_groups`` is off; where it wins the group is null and no
    p-value is given.  ``levels`` declares the groups.
    """
    members = cut_lineage(members.select(sample, group).where(F.col(group).isin(levels)))
    code = F.lit(0)
    for i, level in enumerate(levels):
        code = F.when(F.col(group) == level, F.lit(i)).otherwise(code)
    coded = members.select(sample, code.cast("int").alias("__code"))
    drawn = permutations(coded, sample, ["__code"], count, seed)
    columns = [f"g{i}" for i in range(len(levels))]
    designs = drawn.select("perm", sample, *[(F.col("__code") == i).cast("double").alias(c) for i, c in enumerate(columns)])
    sizes = {r["__code"]: r["n"] for r in coded.groupBy("__code").agg(F.count("*").alias("n")).collect()}  # one row a level
    size = np.array([sizes.get(i, 0) for i in range(len(levels))], dtype=float)[:, None, None]
    here = cells.where(F.col(value) > 0)
    kinds = {"best": T.IntegerType(), "stat": T.DoubleType(), "stat_all": T.DoubleType(), "above": T.LongType(), "permutations": T.LongType()}
    schema = T.StructType([cells.schema[feature], *(T.StructField(n, k) for n, k in kinds.items())])

    def compare(taxa: list, sums: np.ndarray, seen: np.ndarray, perms: np.ndarray) -> pd.DataFrame:
        """Indicator value of the best group in each permutation, counted against that of permutation 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(size > 0, sums / size, 0.0)
            value_of = np.where(size > 0, mean * seen / size, -1.0)
            best = value_of[::-1].argmax(axis=0)  # of equal groups the last one
            stat = np.sqrt(value_of.max(axis=0) / mean.sum(axis=0))
        met = np.flatnonzero(seen[:, :, 0].sum(axis=0) > 0)
        stat, best = stat[met], len(size) - 1 - best[met]
        first = stat[:, :1]
        above = (stat[:, 1:] >= first - 1e-9 * np.maximum(1.0, np.abs(first))).sum(axis=1)
        everywhere = np.sqrt(seen[:, met, 0].sum(axis=0) / size.sum())
        return pd.DataFrame(
            {feature: [taxa[i] for i in met], "best": best[:, 0].astype("int32"), "stat": first[:, 0], "stat_all": everywhere, "above": above, "permutations": len(perms) - 1}
        )

    parts = permuted.products(here, sample, feature, value, designs, columns, compare, schema, observed=True)
    observed = parts.groupBy(feature).agg(
        *(F.first(c).alias(c) for c in ("best", "stat", "stat_all")), ((F.sum("above") + 1) / (F.sum("permutations") + 1)).alias("p_value")
    )
    name = F.lit(None).cast("string")
    for i, level in enumerate(levels):
        name = F.when(F.col("best") == i, F.lit(level)).otherwise(name)
    everywhere = (F.col("stat_all") > F.col("stat") + 1e-9) if all_groups else F.lit(False)
    return observed.select(
        feature,
        F.when(~everywhere, name).alias("indicator_for"),
        F.greatest("stat", F.when(everywhere, F.col("stat_all")).otherwise(F.col("stat"))).alias("stat"),
        F.when(~everywhere, F.col("p_value")).alias("p_value"),
    )


# ---------------------------------------------------------------- constrained ordination


def orthogonal_terms(members: DataFrame, sample: str, terms: list[str]) -> DataFrame:
    """Centred regressors, each made orthogonal to the ones before it (Gram-Schmidt).

    Sequential sums of squares then need no matrix inverse.  Each step takes one-row
    sums from the sample table as subqueries; nothing is collected.
    """
    out = members.select(sample, *[F.col(t).cast("double").alias(t) for t in terms])
    for t in terms:
        out = out.withColumn(t, F.col(t) - out.agg(F.avg(t)).scalar())
    for i, t in enumerate(terms):
        if i == 0:
            continue
        slopes = out.agg(
            F.struct(*[F.try_divide(F.sum(F.col(t) * F.col(p)), F.sum(F.col(p) * F.col(p))).alias(p) for p in terms[:i]])
        ).scalar()
        out = out.withColumn("__b", slopes)
        rest = F.col(t)
        for p in terms[:i]:
            rest = rest - F.coalesce(F.col(f"__b.{p}"), F.lit(0.0)) * F.col(p)
        out = out.withColumn(t, rest).drop("__b")
    return out


def redundancy(
    response: DataFrame,
    members: DataFrame,
    sample: str,
    feature: str,
    value: str,
    terms: list[str],
    count: int = 0,
    seed: int = 1,
) -> DataFrame:
    """Variance of a response table explained by regressors, term by term and in total.

    One row per term, plus ``model`` for all together: variance, df, F, and with
    permutations p.  ``response`` is long and may leave out zeros: sums of cross
    products do not need them.  ``members`` holds the samples with complete regressors.
    """
    x = cut_lineage(orthogonal_terms(members, sample, terms))
    cells = response.join(x.select(sample), sample, "left_semi").select(sample, feature, F.col(value).alias("__v"))
    n = x.agg(F.count("*")).scalar()
    # total sum of squares about the feature means, zeros included through n
    per_feature = cells.groupBy(feature).agg(
        F.sum(F.col("__v") * F.col("__v")).alias("__yy"), F.sum("__v").alias("__y")
    )
    total = per_feature.agg(F.sum(F.col("__yy") - F.col("__y") * F.col("__y") / n)).scalar()
    # the sample table is one checkpointed row per sample, so its many uses below are cheap scans
    perms = permuted.Shuffled(x, count, seed) if count else x.withColumn("perm", F.lit(0))
    squares = permuted.gram(cells, sample, feature, "__v", perms, terms)
    norms = x.agg(F.struct(*[F.sum(F.col(t) * F.col(t)).alias(t) for t in terms])).scalar()
    explained = squares.select("perm", *[F.col("gram")[i * (len(terms) + 1)].alias(f"__{t}") for i, t in enumerate(terms)])
    wide = explained.withColumns({"__norms": norms, "ss_total": total, "n": n})
    used = F.lit(0)
    for t in terms:
        used = used + F.when(F.col(f"__norms.{t}") > 1e-12, 1).otherwise(0)
    wide = wide.withColumn("__q", used)
    ss = {t: F.coalesce(F.try_divide(F.col(f"__{t}"), F.col(f"__norms.{t}")), F.lit(0.0)) for t in terms}
    model = sum(ss.values(), F.lit(0.0))
    rows = [F.struct(F.lit("model").alias("term"), model.alias("ss"), F.col("__q").alias("df"))]
    rows += [F.struct(F.lit(t).alias("term"), s.alias("ss"), F.lit(1).alias("df")) for t, s in ss.items()]
    long = wide.select("perm", "n", "ss_total", "__q", model.alias("__model"), F.inline(F.array(*rows)))
    df_rest = F.col("n") - 1 - F.col("__q")
    rest = F.col("ss_total") - F.col("__model")
    stats = long.withColumns(
        {
            "df_residual": df_rest,
            "variance": F.col("ss") / (F.col("n") - 1),
            "total_variance": F.col("ss_total") / (F.col("n") - 1),
            "r2": ratio(F.col("ss"), F.col("ss_total")),
            "f": F.try_divide(F.col("ss") / F.col("df"), rest / df_rest),
        }
    )
    adjusted = 1 - (1 - F.col("r2")) * (F.col("n") - 1) / F.col("df_residual")
    stats = stats.withColumn("r2_adjusted", F.when(F.col("term") == "model", adjusted))
    columns = ["term", "df", "df_residual", "variance", "total_variance", "r2", "r2_adjusted", "f"]
    if not count:
        return stats.where("perm = 0").select(*columns)
    stats = cut_lineage(stats)
    observed = stats.where("perm = 0").select(*columns)
    p = at_least_as_large(stats.select("perm", "term", "f"), ["term"], "f")
    return observed.join(p.select("term", "p_value"), "term")


def coefficients(
    response: DataFrame, members: DataFrame, sample: str, feature: str, value: str, terms: list[str]
) -> DataFrame:
    """Regression of every feature on the orthogonalised terms: fitted cross products and slopes."""
    x = orthogonal_terms(members, sample, terms)
    cells = response.select(sample, feature, F.col(value).cast("double").alias("__v")).join(x, sample)
    sums = cells.groupBy(feature).agg(*[F.sum(F.col(t) * F.col("__v")).alias(t) for t in terms])
    norms = x.agg(F.struct(*[F.sum(F.col(t) * F.col(t)).alias(t) for t in terms])).scalar()
    out = sums.withColumn("__norms", norms)
    return out.select(feature, *[F.try_divide(F.col(t), F.col(f"__norms.{t}")).alias(t) for t in terms])


def best_group(indicator: DataFrame, feature: str, group: str) -> DataFrame:
    """The group with the largest indicator value; ties go to the first name."""
    return kth_row(indicator, [feature], [F.col("stat").desc(), F.col(group)], 1)


def constrained_axes(
    response: DataFrame, members: DataFrame, sample: str, feature: str, value: str, terms: list[str]
) -> DataFrame:
    """Eigenvalues of the fitted part of a redundancy analysis, one row per axis.

    Fitted values live in the space of the terms, so the eigenvalues are those of a
    matrix as wide as the number of terms: sums over features of products of the
    coefficients, scaled by the lengths of the orthogonal terms.
    """
    x = cut_lineage(orthogonal_terms(members, sample, terms))
    slopes = cut_lineage(coefficients(response, members, sample, feature, value, terms))
    lengths = x.agg(F.count("*").alias("n"), *[F.sum(F.col(t) * F.col(t)).alias(t) for t in terms]).first()
    products = slopes.agg(
        *[
            F.sum(F.coalesce(F.col(a), F.lit(0.0)) * F.coalesce(F.col(b), F.lit(0.0))).alias(f"{i}_{j}")
            for i, a in enumerate(terms)
            for j, b in enumerate(terms)
        ]
    ).first()
    size = len(terms)
    scale = np.sqrt([max(lengths[t], 0.0) for t in terms])
    square = np.array([[products[f"{i}_{j}"] for j in range(size)] for i in range(size)]) * np.outer(scale, scale)
    values = np.linalg.eigvalsh(square)[::-1] / (lengths["n"] - 1)
    rows = [(i + 1, float(v), float(v / values.sum())) for i, v in enumerate(values)]
    return response.sparkSession.createDataFrame(rows, "axis int, eigenvalue double, share double")


def axis_tests(
    response: DataFrame, members: DataFrame, sample: str, feature: str, value: str, terms: list[str], count: int, seed: int = 1
) -> DataFrame:
    """Sequential test of the axes of a redundancy analysis: ``axis``, ``eigenvalue``, ``share``, ``f``, ``permutations``, ``p_value``.

    Each axis is tested with the axes before it as conditions.  The residuals of the response on those are permuted:
    permuting the design instead and taking its part off the conditions gives the same sums, so the response
    is never residualised.  The statistic is the largest eigenvalue of what the remaining terms explain over the residual mean square.
    The eigenproblems are as wide as the number of terms; the driver sees those of permutation 0 only.
    """
    x = cut_lineage(orthogonal_terms(members, sample, terms))
    cells = cut_lineage(response.join(x.select(sample), sample, "left_semi").select(sample, feature, F.col(value).cast("double").alias("__v")))
    lengths = x.agg(F.count("*").alias("n"), *[F.sum(F.col(t) * F.col(t)).alias(t) for t in terms]).first()
    n, used = lengths["n"], [t for t in terms if lengths[t] is not None and lengths[t] > 1e-12]
    unit = cut_lineage(x.select(sample, *[(F.col(t) / F.lit(lengths[t] ** 0.5)).alias(t) for t in used]))
    sums = cells.groupBy(feature).agg(F.sum(F.col("__v") * F.col("__v")).alias("yy"), F.sum("__v").alias("y"))
    total = sums.agg(F.sum(F.col("yy") - F.col("y") * F.col("y") / n)).first()[0]
    size = len(used)
    matrix = permuted.gram(cells, sample, feature, "__v", unit.withColumn("perm", F.lit(0)), used).first()
    values, turn = np.linalg.eigh(np.array(matrix["gram"]).reshape(size, size))
    values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
    axes = [f"__a{i}" for i in range(size)]
    scores = unit.select(sample, *[sum((F.col(t) * F.lit(float(turn[j, i])) for j, t in enumerate(used)), F.lit(0.0)).alias(a) for i, a in enumerate(axes)])
    scores = cut_lineage(scores)
    # one pass for all axes: taking the conditions off a permuted design takes their sums off its sums
    drawn = permuted.Shuffled(scores, count, seed)
    if not drawn.packable(sample):
        return _axes_beside(_statistics_by_axis(cells, drawn, sample, feature, axes, total, values, n), values, n)
    squares = permuted.grams(cells, sample, feature, "__v", drawn, axes).join(permuted.own_products(drawn, sample, axes), "perm")
    stats = cut_lineage(_axis_statistics(cut_lineage(squares), size, float(total), values.tolist(), n - 1 - size))
    return _axes_beside(stats, values, n)


def _axes_beside(stats: DataFrame, values: np.ndarray, n: int) -> DataFrame:
    """The tests next to the axes' eigenvalues."""
    tested = at_least_as_large(stats, ["axis"], "f")
    shares = values / values.sum() if values.sum() > 0 else values
    rows = [(i + 1, float(v / (n - 1)), float(s)) for i, (v, s) in enumerate(zip(values, shares, strict=True))]
    about = stats.sparkSession.createDataFrame(rows, "axis int, eigenvalue double, share double")
    return about.join(tested.withColumnRenamed("observed", "f"), "axis")


def _statistics_by_axis(cells: DataFrame, drawn: permuted.Shuffled, sample: str, feature: str, axes: list[str], total: float, values: np.ndarray, n: int) -> DataFrame:
    """The same where samples repeat or are too many to order whole permutations: a table of permutations, a pass for each axis."""
    scores, drawn = drawn.rows, cut_lineage(drawn.table(sample, axes))
    size, parts = len(axes), []
    for i in range(size):
        before = axes[:i]
        design = drawn
        if before:
            own = scores.select(sample, *[F.col(a).alias(f"{a}_own") for a in before])
            both = drawn.join(own, sample)
            onto = both.groupBy("perm").agg(*[F.sum(F.col(f"{b}_own") * F.col(a)).alias(f"{b}{a}") for b in before for a in axes])
            off = [(F.col(a) - sum((F.col(f"{b}_own") * F.col(f"{b}{a}") for b in before), F.lit(0.0))).alias(a) for a in axes]
            design = both.join(onto, "perm").select("perm", sample, *off)
        zeros = F.array_repeat(F.lit(0.0), size * size)
        squares = permuted.gram(cells, sample, feature, "__v", design, axes).select("perm", "gram", zeros.alias("cross"), zeros.alias("own"))
        parts.append(_axis_statistics(squares, size, float(total), values.tolist(), n - 1 - size).where(F.col("axis") == i + 1))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def _axis_statistics(squares: DataFrame, size: int, total: float, values: list[float], df: int) -> DataFrame:
    """F of the first axis beyond the conditions, for each permutation and number of conditions, from the cross products."""
    first = squares.where("perm = 0").first()
    start = np.array(first["gram"]).reshape(size, size) if first else np.zeros((size, size))

    def f_of(frames):
        for frame in frames:
            out = []
            for perm, gram, cross, own in zip(frame["perm"], frame["gram"], frame["cross"], frame["own"], strict=True):
                gram, cross, own = (np.array(m).reshape(size, size) for m in (gram, cross, own))
                for i in range(size):
                    on = own[:i]
                    taken = on.T @ cross[:i]
                    square = gram - taken - taken.T + on.T @ start[:i, :i] @ on
                    rest = total - sum(values[:i]) - np.trace(square)
                    largest = np.linalg.eigvalsh(square[i:, i:])[-1]
                    out.append((i + 1, perm, largest / (rest / df) if df > 0 and rest > 0 else None))
            yield pd.DataFrame(out, columns=["axis", "perm", "f"]).astype({"axis": "int32", "perm": "int32", "f": "float64"})

    return squares.select("perm", "gram", "cross", "own").mapInPandas(f_of, "axis int, perm int, f double")
