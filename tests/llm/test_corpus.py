"""Operators that compare texts or learn from them: brute force, held-out accuracy and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import jaccard, ranking, shards, substring, toxicity
from quadrat.llm import shingles as shingles_of
from quadrat.llm.components import connected
from tests.llm.conftest import PROSE, crc


def test_components_of_a_path_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (60, 61), (61, 60)]
    out = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {60: 60, 61: 60}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute_components(rows, size, percent):
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        smallest[top(i)] = min(key, smallest.get(top(i), key))
    return {key: (len(sets[i]), smallest[top(i)]) for i, (key, _) in enumerate(rows)}


def near_copies(seed, groups=12):
    """Groups of edited copies, common passages, and texts of their own."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = rnd.choices(vocabulary, k=30)
    rows = []
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.randint(3, 90)) + (common if rnd.random() < 0.5 else [])
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                copy = copy[: max(1, int(len(copy) * 0.95))]
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, size, percent):
    rows = near_copies(size)
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), rule=jaccard.Rule(size, percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, size, percent)


def test_jaccard_of_odd_rows(odd, none):
    out = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd).collect())
    n = len(shingles(PROSE, 4))
    assert out == Counter(
        {(0, n, 0): 1, (1, n, 0): 2, (2, 0, 2): 1, (3, 0, 3): 1, (4, 0, 4): 1, (None, n + 1, None): 1, (5, 1, 5): 1, (6, 1, 6): 1, (7, 1, 7): 1, (8, 1, 8): 1, (9, 4, 9): 1, (10, n, 0): 1, (None, 0, None): 1}
    )
    assert jaccard.join(none).collect() == []


def test_prefixes_agree_with_a_full_sort():
    rng = np.random.default_rng(1)
    load = rng.integers(1, 9, 1 << 16).astype(np.int32)
    own = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    for order in range(3):
        ranked = own[np.lexsort((own, jaccard.order_by(own, load, order)))]
        for count in (1, 40, 400):
            assert (jaccard._first(own, load, order, count) == ranked[:count]).all()


def test_every_subsequence_has_one_window():
    rng = np.random.default_rng(2)
    for values in (60, 3):
        hashes = rng.integers(0, values, 60).astype(np.uint64)
        found = substring.compact_windows(hashes, 5)
        for i in range(60):
            for j in range(i + 4, 60):
                own = [w for w in found if w[0] <= i <= w[1] <= j <= w[2]]
                assert len(own) == 1 and hashes[own[0][1]] == hashes[i : j + 1].min()


def test_texts_in_a_row_are_parted():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 9, n)) for n in (70, 3, 0, 55, 400)]
    ((keys, starts, own),) = substring.joined([1, 2, 3, 4, 5], texts, 5, 50)
    assert keys == [1, 4, 5] and starts.tolist() == [0, 67, 119] and len(own) == 516
    together = substring.compact_windows(own, 46)
    together = together[own[together[:, 1]] > 0]
    alone = [substring.compact_windows(substring.sequence(texts[k - 1], 5), 46) + s for k, s in zip(keys, starts, strict=True)]
    assert sorted(map(tuple, together)) == sorted(map(tuple, np.concatenate(alone)))


def test_words_are_equal_where_the_bytes_are():
    rng = np.random.default_rng(8)
    texts = [None, "", " \t ", "É é", *("".join(rng.choice(list("abAB \n\x0b\u00e9\u3000"), n)) for n in range(1, 200))]
    numbers, begins = shingles_of.words_in_a_row(texts)
    own = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len({*zip(numbers.tolist(), own, strict=True)}) == len(set(own)) == len(set(numbers.tolist()))
    assert np.diff(begins).tolist() == [len((t or "").encode().split()) for t in texts]
    assert [len(substring.sequence(t, 3)) for t in ("", "a", "a b c", "a b c d")] == [0, 1, 1, 2]


def test_a_passage_stretches_one_way_or_another():
    for least in (2, 3, 17, 46):
        for steps in range(4):
            for behind in range(least):
                assert any(b <= behind and a <= least - 1 - behind for b, a in substring.reaches(least, steps))


def test_spans_are_equal_where_the_words_are(spark):
    rnd = random.Random(9)
    fresh = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    passage = fresh(52)
    rows = [(1, " ".join(fresh(30) + passage + fresh(30))), (2, " ".join(fresh(77) + passage + fresh(9)))]
    places = spark.createDataFrame([(1, 0, 50, 0, 107), (2, 0, 97, 0, 133)], "doc_id long, fn int, centre int, left int, right int")
    out = substring.whole_spans(spark.createDataFrame(rows, "doc_id long, text string"), places, "doc_id", "text", 5, 46).collect()
    assert Counter(r.doc_id for r in out) == {1: 46, 2: 37}  # the second ends before all spans do
    for name in ("ends", "exact"):
        one, two = ({r[name] for r in out if r.doc_id == k} for k in (1, 2))
        assert len(one) == 46 and len(one & two) == 3  # 48 places in common hold three spans of 46


def test_longest_span_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        match = rng.random(40) < 0.9
        centre = int(rng.integers(40))
        begin, end = substring.longest_span(match, centre, 80)
        assert substring.reachable(match, 20, 80)[centre] or end - begin < 20
        good = [(j - i) for i in range(centre + 1) for j in range(centre + 1, 41) if match[i] and match[j - 1] and 9 * match[i:j].sum() >= 8 * (j - i) + 1e-6]
        assert end - begin == max(good, default=0) or 9 * match[begin:end].sum() >= 8 * (end - begin) - 1e-6


def test_repeated_passages(spark, odd, none):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    fresh = lambda n: rnd.choices(vocabulary, k=n)
    passage, short = fresh(60), fresh(30)
    edited = list(passage)
    edited[30] = "changed"
    rows = [(i, " ".join(fresh(80) + passage + fresh(40))) for i in range(6)]
    rows += [(10, " ".join(fresh(20) + edited + fresh(70))), (11, " ".join(passage))]
    rows += [(20 + i, " ".join(fresh(90) + short + fresh(90))) for i in range(4)]
    rows += [(30, rows[0][1]), (31, " ".join(fresh(200))), (32, " ".join(fresh(60) + fresh(70)))]
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} | {r.first_doc_id for r in out} == {*range(6), 10, 11, 30}
    text = dict(rows)
    for r in out:
        assert r.doc_id != r.first_doc_id and r.n_words >= 50 and r.first_n_words >= 50
        a = " ".join(text[r.doc_id].split()[r.begin_word : r.begin_word + r.n_words])
        b = " ".join(text[r.first_doc_id].split()[r.first_begin_word : r.first_begin_word + r.first_n_words])
        x, y = shingles(a, 5), shingles(b, 5)
        assert len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8
    found = substring.repeated_passages(odd).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(1, 0), (10, 0)}
    assert substring.repeated_passages(none).collect() == []


def test_shards(spark, odd, none):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('é', cast(id % 7 as int)) as text")
    out = shards.assign(df).collect()
    text = {i: "é" * (i % 7) for i in range(4000)}
    for r in out:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()), "key")
        assert r.grown_shard in (r.shard, 8)
    moved = sum(r.grown_shard == 8 for r in out)
    assert 4000 / 9 * 0.8 < moved < 4000 / 9 * 1.2
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and 400 < len(slots) < 600
    assert {r.doc_id: r.shard for r in out} == {r.doc_id: r.shard for r in shards.assign(df.repartition(7)).collect()}
    weighted = Counter(r.shard for r in shards.assign(df, weights=[3.0, 1.0, 0.0]).collect())
    assert 2800 < weighted[0] < 3200 and weighted[2] == 0
    rows = shards.assign(odd).collect()
    assert len(rows) == odd.count() and all(r.size == 1 and r.text_crc32 == 0 for r in rows if r.doc_id == 2)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shards.assign(none).collect() == []


def test_slices_don_t_change_slots(spark, monkeypatch):
    df = spark.range(500).selectExpr("id as doc_id", "'x' as text")
    monkeypatch.setattr(shards, "ROWS_PER_SLICE", 5)
    out = shards.assign(df).collect()
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def labelled(spark, bad, rows=900):
    rnd = random.Random(8)
    words = PROSE.split()
    data, labels = [], []
    for i in range(rows):
        worse = i % 4 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 90))]
        data.append((i, bad(rnd, text) if worse else " ".join(text)))
        labels.append((i, int(not worse), int(worse)))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ranking_tells_held_out_rows_apart(spark, odd, none):
    docs, labels = labelled(spark, lambda rnd, text: " ".join(w + rnd.choice(["###", "$$$", ""]) for w in text))
    out = ranking.rank_quality(docs, labels).collect()
    assert len(out) == 900 and all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) > 0.95 * len(held)
    assert len(ranking.rank_quality(odd, labels).collect()) == odd.count()
    assert ranking.rank_quality(none, labels).collect() == []
    assert {r.score for r in ranking.rank_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_ranking_learns_from_every_taught_row(spark, monkeypatch):
    docs, labels = labelled(spark, lambda rnd, text: " ".join(w + rnd.choice(["###", "$$$", ""]) for w in text), rows=300)
    # texts of one word make some 25,000 more rows, beyond any sample of 12,000
    more = spark.range(300, 25_300).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    marks = more.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    learned, held = [], ranking.fit

    def spied(taught, *args):
        learned.append({r[0] for r in taught.select("doc_id").collect()})
        return held(taught, *args)

    monkeypatch.setattr(ranking, "fit", spied)
    out = ranking.rank_quality(docs.unionByName(more), labels.unionByName(marks))
    assert learned == [{i for i in range(25_300) if crc(i, 4) != 2}]
    assert out.count() == 25_300 and {r.held_out for r in out.filter("doc_id % 4 = 0").collect()} == {True, False}


def test_ranking_fits_exact_pairs_and_threshold(spark):
    rnd = random.Random(3)
    data = [(i % 500, [rnd.random() + (i % 3 > 0) * 0.3 for _ in range(17)], int(i % 3 > 0)) for i in range(600)]
    found = ranking.fit(spark.createDataFrame(data, "doc_id long, features array<double>, __label int"))
    turned = ranking.fit(spark.createDataFrame(data[::-1], "doc_id long, features array<double>, __label int").repartition(7))
    assert np.allclose(found.weights, turned.weights, atol=1e-6)
    x = np.array([row[1] for row in data])
    raw = np.concatenate([x, np.sqrt(x), x * x], axis=1) @ np.array(found.weights)
    assert found.threshold == pytest.approx(np.quantile(raw, 200 / 600))
    assert found.scale == pytest.approx(4 / (np.quantile(raw, 0.9) - np.quantile(raw, 0.1)))


def test_toxicity_tells_held_out_rows_apart(spark, odd, none):
    insults = ["grumbo", "snarfle", "blorked"]
    docs, labels = labelled(spark, lambda rnd, text: " ".join([*text[:10], "you", rnd.choice(insults), *text[10:]]))
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == 900 and all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) > 0.95 * len(held)
    assert len(toxicity.score_toxicity(odd, labels.join(docs, "doc_id", "left_semi")).collect()) == odd.count()
    assert toxicity.score_toxicity(none, labels).collect() == []
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_disguised_words():
    assert toxicity.plain("gr.um-b0") == "grumbo"
    lexicon = {"=grumbo": 5.0}
    assert toxicity.Featurizer(lexicon)("you GR.UM-B0 there")[7] > 0


def test_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline
    from quadrat.llm import pieces, secrets
    from quadrat.llm.queries import tokenizer_path

    rnd = random.Random(9)
    words = PROSE.split()
    rows = [(i, " ".join(rnd.choices(words, k=60)), "en", "s", 1) for i in range(40)]
    rows += [(40, rows[3][1], "en", "s", 1), (41, rows[4][1] + " more", "en", "s", 1), (42, "123 456 !!", "en", "s", 1), (43, None, None, None, None)]
    item = " ".join(f"q{i}x" for i in range(30)).replace("0", "zero")
    rows += [(44, rows[5][1] + " " + " ".join(rnd.choices(words, k=90)) + " " + item, "en", "s", 1), (45, " ".join(rnd.choices(words, k=60)) + ' password = "hunter2hunter2"', "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(40), 45}
    codec = pieces.Codec(pieces.load_vocabulary(tokenizer_path()))
    texts = {r[0]: secrets._masked(r[1], "[secret]") for r in rows if r[0] in out}
    assert "hunter2" not in texts[45]
    assert all(out[k].n_tokens == len(codec.encode(texts[k])) for k in out)


def compared(first, second, ca, cb):
    """What ``compare`` says of two lists of words around the shingles at ca and cb."""
    a, b = (substring.sequence(" ".join(words), 5) for words in (first, second))
    numbers, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    return substring.compare(a, b, substring.held(a, b, len(numbers)), len(numbers), ca, cb, 46, 80)


def test_a_passage_beside_a_repeated_line():
    passage, line = [f"p{i}" for i in range(50)], [f"l{i}" for i in range(10)]
    first, second = (passage + [f"{own}{i}" for i in range(30)] + line * 40 for own in "xy")
    assert compared(first, second, 20, 20) == (0, 46, 0, 46, 1.0)
    a, b, c, d, share = compared(first, second, 200, 200)
    assert (a, c, share) == (80, 80, 1.0) and b == d == 476


def test_a_passage_of_two_lengths():
    passage = [f"p{i}" for i in range(50)]
    longer = passage[:25] + [f"x{i}" for i in range(6)] + passage[25:]  # 42 of 46 and of 52 places, 42 of 56 in all: too few
    assert compared(passage, longer, 10, 10) is None
    longer = passage[:25] + ["x0", "x1"] + passage[25:]
    assert compared(passage, longer, 10, 10) == (0, 46, 0, 48, 42 / 52)


def near_copy(rnd, passage, kind):
    """The words with one or two edits; those that keep 0.8 of the shingles of 50 words."""
    words = list(passage)
    for _ in range(rnd.choice([1, 2]) if len(words) > 80 else 1):
        at = rnd.randrange(5, len(words) - 5) if len(words) > 80 else len(words) // 2
        words[at : at + (kind != "insert")] = [] if kind == "delete" else [f"new{rnd.random()}"]
    return words


def test_near_copies_share_signatures(spark):
    rnd = random.Random(5)
    rows, kinds = [], {}
    for i in range(600):
        kinds[i] = kind, size = ("insert", "delete", "substitute")[i % 3], (50, 54, 100, 160)[i // 3 % 4]
        passage = [f"w{rnd.randrange(10**9)}" for _ in range(size)]
        around = [[f"v{rnd.randrange(10**9)}" for _ in range(30)] for _ in range(4)]
        copy = near_copy(rnd, passage, kind)
        pair = [" ".join(around[0] + passage + around[1]), " ".join(around[2] + copy + around[3])]
        x, y = shingles(" ".join(passage), 5), shingles(" ".join(copy), 5)
        assert len(copy) < 50 or len(x & y) >= 0.8 * len(x | y) or size == 50
        if len(copy) < 50 or len(x & y) < 0.8 * len(x | y):
            del kinds[i]
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
    met: dict = {}
    for r in substring.windows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 50, 3).collect():
        met.setdefault((r.doc_id // 2, r.signature), set()).add(r.doc_id)
    found = {i for (i, _), members in met.items() if len(members) == 2}
    for kind in ("insert", "delete", "substitute"):
        for size in (50, 54, 100, 160):
            of_kind = [i for i, x in kinds.items() if x == (kind, size)]
            share = sum(i in found for i in of_kind) / max(len(of_kind), 1)
            print(kind, size, len(of_kind), share)
            assert not of_kind or share >= 0.85
    assert len(found & set(kinds)) >= 0.95 * len(kinds)


def families(count):
    """Rows of which 10i + 4 and 10i + 5 are near copies, and 10i to 10i + 3 hold pieces that are too short."""
    rnd = random.Random(11)
    rows = []
    for i in range(count):
        fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
        passage = fresh(60)
        one, two = list(passage), list(passage)
        one[30], two[31] = "one", "two"
        pieces = [passage[:42], passage[18:], passage[5:47], passage[12:54]]
        rows += [(10 * i + k, " ".join(fresh(30) + words + fresh(30))) for k, words in enumerate([*pieces, one, two])]
    return rows


def test_near_copies_unlike_the_smallest_key(spark):
    out = substring.repeated_passages(spark.createDataFrame(families(40), "doc_id long, text string")).collect()
    linked = {(r.first_doc_id, r.doc_id) for r in out}
    assert len(linked & {(10 * i + 4, 10 * i + 5) for i in range(40)}) >= 38


def test_one_row_of_each_group_stays(spark, tmp_path):
    """Repeated rows, rows without an id and two texts of one id, as a table that is read twice."""
    import corpus_pipeline

    other = " ".join(reversed(PROSE.split()))
    rows = [(1, PROSE), (1, PROSE), (None, PROSE), (None, PROSE), (2, PROSE), (3, other), (3, other + " and some more"), (None, ""), (None, ""), (4, None), (4, None), (5, "one two")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __n string").repartition(3).write.parquet(str(tmp_path / "docs"))
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out)
    assert [k[:2] for k in kept] == [(False, 1), (False, 3), (False, 4), (False, 4), (False, 5), (True, 0), (True, 0)]
    assert kept[0][2] == PROSE and kept[1][2] in (other, other + " and some more")


def test_centres_met_equals_all_pairs_of_windows():
    rnd = np.random.default_rng(4)

    def windows():
        left = rnd.integers(0, 50, 60)
        centre = left + rnd.integers(0, 40, 60)
        return np.column_stack([rnd.integers(-3, 4, 60), rnd.integers(0, 3, 60), centre, left, centre + rnd.integers(0, 40, 60), rnd.integers(0, 2, 60)])

    one, two = windows(), windows()
    in_a, in_b = rnd.random(100) < 0.8, rnd.random(100) < 0.8
    brute = {
        (c, d)
        for s, _, c, l, r, o in one.tolist()
        for t, _, d, m, q, p in two.tolist()
        if s == t and (o or p) and min(c - l, d - m) + min(r - c, q - d) + 1 >= 36.8 and in_a[c] and in_b[d]
    }
    assert brute and substring.centres_met(one, two, in_a, in_b, 36.8, 1) == sorted(brute)
    assert substring.centres_met(one, two, in_a, in_b, 36.8, 4) == []


def test_documents_meet_by_blocks(spark, monkeypatch):
    """Passages of documents with many windows of one signature; the number of blocks changes nothing."""
    rnd = random.Random(5)
    near = [f"n{i}" for i in range(60)]
    edited = near[:30] + ["other"] + near[31:]
    rows = [(1, " ".join([f"a{i}" for i in range(70)] + near)), (2, " ".join(edited + [f"b{i}" for i in range(70)])), (3, "again " * 300), (4, " ".join(f"c{rnd.random()}" for _ in range(200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    least, windows = 46, substring.windows(docs, "doc_id", "text", 5, 50, 3).withColumn("open", F.lit(True))
    found = []
    for size in (16_000_000, 500):
        monkeypatch.setattr(substring, "BLOCK_BYTES", size)
        out = substring._passages_by_blocks(windows, docs, "doc_id", "text", 5, least, 80, 1).collect()
        found.append(sorted(tuple(r) for r in out))
    assert found[0] == found[1] and {r[:2] for r in found[0]} == {(1, 2)}
    assert all(r[2] == 70 and r[4] == 0 and r[6] >= 0.8 for r in found[0])


def test_no_alike_span_is_lost():
    rng = np.random.default_rng(6)
    for values in (4, 12, 400):
        for _ in range(40):
            own = np.repeat(rng.integers(0, values, 30), rng.integers(1, 4, 30))[:45]
            match = rng.random(values)[own] < 0.85
            before = substring.previous(own)
            assert before.tolist() == [max((j for j in range(i) if own[j] == x), default=-1) for i, x in enumerate(own)]
            inside = substring.alike(match, before, 8, 80)
            for i in range(len(own)):
                for j in range(i + 8, len(own) + 1):
                    both, alone = len(set(own[i:j][match[i:j]].tolist())), len(set(own[i:j][~match[i:j]].tolist()))
                    if both >= 4 * alone and match[i:j].sum() > 0.8 * (j - i) + 1e-6:  # as longest_span asks for
                        assert inside[i:j].all()


def test_a_word_many_times_in_a_row(spark, monkeypatch):
    """One window and a few comparisons for a run of one shingle, not one for each place; runs of different lengths are linked."""
    fresh = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = [(1, " ".join(fresh("a", 40) + ["the"] * 300 + fresh("b", 40))), (2, " ".join(fresh("c", 70) + ["the"] * 60 + fresh("d", 20)))]
    rows += [(3, " ".join(fresh("e", 30) + ["of"] * 45 + fresh("f", 30))), (4, " ".join(fresh("g", 30) + ["of"] * 47 + fresh("h", 30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.windows(docs.filter("doc_id = 1"), "doc_id", "text", 5, 50, 3).groupBy("signature").count().agg(F.max("count")).first()[0]
    assert found <= 30  # 232 of them begin at a place of the run
    out = substring.repeated_passages(docs).collect()
    assert {(r.first_doc_id, r.doc_id) for r in out} == {(1, 2)} and all(r.n_words >= 50 and r.similarity >= 0.8 for r in out)
    calls, compare = [], substring.compare
    monkeypatch.setattr(substring, "compare", lambda *x: calls.append(x) or compare(*x))
    one, two = ((substring.sequence(rows[k][1], 5) >> np.uint64(32)).astype(np.uint32).tobytes() for k in (2, 3))
    every = [(ca, cb) for ca in range(30, 71) for cb in range(30, 73)]
    assert substring.between(one, two, lambda in_a, in_b: every, 46, 80) == [] and len(calls) <= 4


def test_stretches_that_other_documents_repeat(spark, monkeypatch):
    """A phrase too short for a passage leaves nothing to compare, however many documents have it."""
    rnd = random.Random(12)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    phrase, passage = fresh(13), fresh(60)
    copy = [*passage[:30], "other", *passage[31:]]
    rows = [(i, " ".join(fresh(50) + phrase + fresh(50))) for i in range(30)]
    rows += [(40, " ".join(fresh(20) + passage + fresh(50))), (41, " ".join(fresh(90) + copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sequences = substring._sequences(docs, docs.select("doc_id"), "doc_id", "text", 5)
    for size in (16_000_000, 300):
        monkeypatch.setattr(substring, "COUNTED_BYTES", size)
        out = {r.doc_id: r.stretches for r in substring._stretches(sequences, "doc_id", 46, 80).collect()}
        assert set(out) == {40, 41}
        assert any(s.p <= 20 and s.q >= 76 for s in out[40]) and any(s.p <= 90 and s.q >= 146 for s in out[41])
