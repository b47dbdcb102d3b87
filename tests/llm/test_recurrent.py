"""The recurrent model: gradients, probabilities, base scores against brute force, held-out likelihood and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quadrat.llm import recurrent
from tests.llm.conftest import crc


def lexicon(words=5000, texts=50):
    own = [0, texts, *(max(words - i, 1) for i in range(words))]
    return recurrent.Lexicon(b" ".join(b"w%d" % i for i in range(words)), np.array(own), sum(own), words + 1)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {n: (x + rng.normal(0, 0.1, x.shape)).astype(np.float32) for n, x in recurrent.fresh_weights(lexicon(), 5).items()}
    texts = [rng.integers(0, recurrent.SHORT, rng.integers(1, 9)) for _ in range(7)]
    before, target, _, _ = recurrent.laid_out(texts, 3)
    state = rng.normal(0, 0.5, (before.shape[1], 5)).astype(np.float32)
    grads, _, _ = recurrent.gradients(w, before, target, state)

    def loss(name, place, step):
        moved = {n: x.copy() for n, x in w.items()}
        moved[name].ravel()[place] += step
        return -recurrent.gradients(moved, before, target, state)[2]

    for name, g in grads.items():
        for place in np.argsort(-np.abs(g.ravel()))[:4]:
            slope = (loss(name, place, 4e-3) - loss(name, place, -4e-3)) / 8e-3
            assert slope == pytest.approx(g.ravel()[place], rel=0.12, abs=0.01), name


def test_probabilities_of_the_next_token_sum_to_one_and_states_are_carried():
    rng = np.random.default_rng(1)
    w = {n: (x + rng.normal(0, 0.2, x.shape)).astype(np.float32) for n, x in recurrent.fresh_weights(lexicon()).items()}
    start = rng.integers(0, recurrent.SHORT, 300)
    one = recurrent.scores(w, [start])[0]
    every = recurrent.scores(w, [np.append(start, i) for i in range(0, recurrent.SHORT)])
    assert np.sum(10.0 ** (every - one)) == pytest.approx(1.0, rel=1e-3)
    # packed with others, in whatever lane, a text has the same score
    others = [rng.integers(0, recurrent.SHORT, n) for n in (1, 2, 700, 40, 5)]
    assert recurrent.scores(w, [*others, start])[-1] == pytest.approx(one, rel=1e-5)


def test_lanes_hold_every_token_once():
    rnd = random.Random(2)
    texts = [np.arange(rnd.randint(1, 50)) + 1 for _ in range(90)]
    before, target, owner, busy = recurrent.laid_out(texts, 8)
    assert busy.tolist() == [(row >= 0).sum() for row in target]
    for n, ids in enumerate(texts):
        at = np.argwhere((owner == n) & (target >= 0))
        at = at[np.argsort(at[:, 0])]
        assert (target[at[:, 0], at[:, 1]] == ids).all() and len(set(at[:, 1])) == 1
        assert before[tuple(at[0])] == -1 and (before[at[1:, 0], at[1:, 1]] == ids[:-1]).all()


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute_base(rows):
    counts = Counter(t for key, text in rows if key is not None and crc(key, 10) for t in tokens(text))
    total = sum(counts.values())
    under = total + 0.1 * (len(counts) + 1)
    out = []
    for key, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / under) for t in own)
        out.append((key, key is None or crc(key, 10) == 0, len(own), sum(counts[t] > 0 for t in own), total, base))
    return out


@pytest.mark.parametrize("head", [recurrent.HEAD, 40])
def test_base_scores_equal_brute_force(spark, odd, none, monkeypatch, head):
    monkeypatch.setattr(recurrent, "HEAD", head)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    out = sorted((tuple(r) for r in recurrent.score_texts(odd).collect()), key=key)
    want = sorted(brute_base([(r.doc_id, r.text) for r in odd.collect()]), key=key)
    assert [r[:5] for r in out] == [r[:5] for r in want]
    assert [r[5] for r in out] == pytest.approx([r[5] for r in want])
    assert all(r[6] < 0 for r in out)
    assert recurrent.score_texts(none).collect() == []


def test_held_out_texts_are_likelier_than_under_word_counts(spark):
    rnd = random.Random(4)
    after = {w: rnd.sample([f"w{i}" for i in range(60)], 4) for w in (f"w{i}" for i in range(60))}

    def text():
        word, out = "w0", []
        for _ in range(rnd.randint(20, 60)):
            word = rnd.choice(after[word])
            out.append(word)
        return " ".join(out) + rnd.choice([" rare%d" % rnd.randint(0, 10**6), ""])

    frame = spark.createDataFrame([(i, text()) for i in range(3000)], "doc_id long, text string").repartition(2)
    sums = recurrent.score_texts(frame).filter("held_out").groupBy().sum("score", "base_score").first()
    assert sums[0] > 0.85 * sums[1]  # both are negative


def test_nothing_to_learn_from(spark):
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    (row,) = recurrent.score_texts(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).collect()
    assert row.held_out and (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0.0) and math.isfinite(row.score)
