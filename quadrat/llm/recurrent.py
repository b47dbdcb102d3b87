"""Scoring of texts by a gated recurrent language model.

The model is trained on all texts of the training fold, in numpy, by backpropagation that is cut off at windows of ``STEPS``
tokens while the state is carried on from window to window.  Its output is factored: first the class of
the next token, then the token among those of its class.  The most frequent words have a place of their own; a rarer
word is the token "other", followed by its share among all rarer words of the training fold, so every
token of a text is paid for and the score is the log-likelihood of the whole text.

Training is data-parallel: in each round every task starts from the same weights, learns from its own
texts, and Spark averages the weights by tokens.  Word counts cover the whole training fold; those of rare
words meet the texts in a join, since only a bounded head of them may travel to every task.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadrat.llm.common import fold, map_rows, schema_of
from quadrat.session import written

#: Size of the state; classes of the output and tokens of each; class 0 holds "other" alone.
HIDDEN, CLASSES, IN_CLASS = 16, 41, 40
#: Tokens with a place of their own: 0 is "other", 1 is the end, then words by falling count.
OTHER, END, SHORT = 0, 1, 1 + (CLASSES - 1) * IN_CLASS
#: Most frequent words whose counts every task knows; the others are joined.
HEAD = 1 << 18
#: Lanes that are stepped together, steps after which backpropagation is cut off, and steps of a window in scoring.
LANES, STEPS, SCORE_STEPS = 512, 32, 96
#: A task that learns from few tokens has fewer lanes, so that it still has about this many windows.
LEAST_WINDOWS = 60
#: Tokens of the texts that a task packs into lanes at once.
PACK_TOKENS = 3_000_000
#: Adagrad's step; rounds end where these shares of the training fold have been read.
RATE, ROUNDS = 0.15, (20, 100)
#: Numbers of a slice of the weights, which are averaged slice by slice.
SLICE = 1 << 14
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000
ADDED, LOG10 = 0.1, float(np.log(10.0))

Weights = dict[str, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes.split() parts at space and 9 to 13


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``c`` of all rows, counted in the tasks before they are shuffled."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        found: Counter = Counter()
        for (texts,) in batches:
            for value in texts:
                found.update(words_of(value))
                if len(found) > COUNTED:
                    yield [[w.decode() for w in found], list(found.values())]
                    found = Counter()
        yield [[w.decode() for w in found], list(found.values())]

    kind = T.StructType([T.StructField("word", T.StringType()), T.StructField("c", T.LongType())])
    return map_rows(df, [text], kind, run).groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """The head of the counts and the sums over all of them; bounded by HEAD."""

    head: bytes  # words of the head by falling count, joined by spaces
    counts: np.ndarray  # by id: other (0), end, words of the head
    tokens: int
    distinct: int

    def parts(self) -> tuple:
        return self.head, self.counts, self.tokens, self.distinct

    def ids(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.head.split(), 2)} if self.head else {}

    def total(self) -> float:
        """What base probabilities are divided by."""
        return self.tokens + ADDED * (self.distinct + 1)

    def rare_total(self) -> float:
        """The same among the words that have no place of their own."""
        own = self.counts[1:SHORT]
        return self.total() - float(own.sum()) - ADDED * int((own > 0).sum())


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """``texts`` is the number of training texts, each of which has one end."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # a histogram by powers of 2 ** (1 / 16) says down to which count the words are at most HEAD
    size = F.floor(F.log2(F.col("c").cast("double")) * 16)
    low, seen = None, 0
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        seen += r["count"]
        if seen > HEAD:
            break
        low = r["size"]
    head = [] if low is None else counts.filter(size >= low).select("word", "c").collect()  # HEAD rows at most
    head.sort(key=lambda r: (-r["c"], r["word"]))
    own = np.array([0, texts, *(r["c"] for r in head)], np.int64)
    return Lexicon(" ".join(r["word"] for r in head).encode(), own, sums[0] + texts, sums[1] + (texts > 0))


def fresh_weights(words: Lexicon, hidden: int = HIDDEN) -> Weights:
    """Small random weights for the state; the output begins with the shares of the training fold."""
    rng = np.random.default_rng(11)
    own = np.zeros(SHORT)
    known = words.counts[:SHORT].astype(float)
    own[: len(known)] = known
    own[OTHER] = max(words.tokens - known.sum(), 0)
    own = np.where(own > 0, own, 1e-3)
    own[[OTHER, END]] += 1.0
    inner = own[1:].reshape(CLASSES - 1, IN_CLASS)
    mass = np.concatenate([[own[OTHER]], inner.sum(axis=1)])
    return {
        "X": rng.normal(0, 0.3, (SHORT, 3 * hidden)).astype(np.float32),
        "U": rng.normal(0, 0.25, (hidden, 3 * hidden)).astype(np.float32),
        "Wc": np.zeros((hidden, CLASSES), np.float32),
        "bc": np.log(mass / mass.sum()).astype(np.float32),
        "Wo": np.zeros((SHORT, hidden), np.float32),
        "bo": np.concatenate([[0.0], np.log(inner / inner.sum(axis=1, keepdims=True)).ravel()]).astype(np.float32),
    }


def pack(lengths: list[int], most: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Lane and first step of each text, and the lanes' lengths: longest texts first, each to the lane that is free earliest.

    Lanes come by falling length, so that those still busy at a step are the first ones.
    """
    free = [(0, lane) for lane in range(max(min(most, len(lengths)), 1))]
    places = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at, lane = free[0]
        places[i] = (lane, at)
        heapq.heapreplace(free, (at + lengths[i], lane))
    order = sorted(free, reverse=True)
    moved = {lane: i for i, (_, lane) in enumerate(order)}
    return [(moved[lane], at) for lane, at in places], [length for length, _ in order]


def laid_out(texts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By step and lane: the token before, the token (-1: none), the text's number; and by step the lanes still busy."""
    places, loads = pack([len(x) for x in texts], most)
    steps, lanes = loads[0], len(loads)
    before = np.full((steps, lanes), END, np.int32)
    target = np.full((steps, lanes), -1, np.int32)
    owner = np.zeros((steps, lanes), np.int32)
    for n, (ids, (lane, at)) in enumerate(zip(texts, places, strict=True)):
        target[at : at + len(ids), lane] = ids
        before[at, lane] = -1  # the state begins anew
        before[at + 1 : at + len(ids), lane] = ids[:-1]
        owner[at : at + len(ids), lane] = n
    return before, target, owner, lanes - np.searchsorted(np.array(loads[::-1]), np.arange(steps), "right")


def windows(texts: list[np.ndarray], most: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The packed texts, ``steps`` at a time, only the lanes that are busy."""
    before, target, owner, busy = laid_out(texts, most)
    for t in range(0, len(busy), steps):
        yield tuple(x[t : t + steps, : busy[t]] for x in (before, target, owner))


def forward(w: Weights, before: np.ndarray, state: np.ndarray, keep: bool = True) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """States of a window (steps, lanes), what backpropagation needs of it (if ``keep``), and the last state."""
    steps, lanes = before.shape
    hidden = w["U"].shape[0]
    two = 2 * hidden
    ids = np.where(before < 0, END, before)
    # the logistic function of x is that of tanh(x / 2), moved and scaled; both parts lie side by side in memory of their own
    zrs, cs = (w["X"][:, :two] * np.float32(0.5))[ids], w["X"][:, two:][ids]
    turn_zr, turn_c = w["U"][:, :two] * np.float32(0.5), np.ascontiguousarray(w["U"][:, two:])
    states = np.empty((steps, lanes, hidden), np.float32)
    whence, inner = (np.empty_like(states) for _ in range(2)) if keep else (None, None)
    goes_on = (before >= 0).astype(np.float32)[:, :, None]
    for t in range(steps):
        h = state * goes_on[t]
        zr, c = zrs[t], cs[t]  # they take the places of their inputs
        zr += h @ turn_zr
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        a = h @ turn_c
        if keep:
            whence[t], inner[t] = h, a
        a *= zr[:, hidden:]
        c += a
        np.tanh(c, out=c)
        state = states[t]
        np.subtract(c, h, out=state)
        state *= zr[:, :hidden]
        state += h
    return states, {"zr": zrs, "c": cs, "from": whence, "inner": inner, "on": goes_on}, state


def _softmax(states: np.ndarray, turn: np.ndarray, bias: np.ndarray, at: np.ndarray, whole: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """Probabilities by row (if ``whole``), and the logarithm of the one at ``at``."""
    x = states @ turn
    x += bias
    rows = np.arange(len(x))
    wanted = x[rows, at]
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
        total = x @ np.ones(x.shape[1], x.dtype)
    if not np.isfinite(total).all() or not total.all():  # too large or small for the type as they are
        x = states @ turn + bias
        x -= x.max(axis=1, keepdims=True)
        wanted = x[rows, at]
        np.exp(x, out=x)
        total = x.sum(axis=1)
    if whole:
        x *= (1 / total)[:, None]
    return x if whole else None, wanted - np.log(total)


def output(w: Weights, states: np.ndarray, target: np.ndarray, grads: Weights | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability (natural) of each target; with ``grads`` also the gradient of the states, and of the output weights in ``grads``."""
    kind = (target + IN_CLASS - 1) // IN_CLASS
    # tokens of one class side by side
    order = np.argsort(kind.astype(np.int16), kind="stable")  # small numbers are sorted in linear time
    kind, target, states = kind[order], target[order], states[order]
    ends = np.searchsorted(kind, np.arange(CLASSES + 1))
    error, found = _softmax(states, w["Wc"], w["bc"], kind, grads is not None)
    back = None
    if grads is not None:
        error[np.arange(len(kind)), kind] -= 1
        grads["Wc"] = states.T @ error
        grads["bc"] = error.sum(axis=0)
        back = error @ w["Wc"].T
        grads["Wo"], grads["bo"] = np.zeros_like(w["Wo"]), np.zeros_like(w["bo"])
    for k in range(1, CLASSES):
        at = slice(ends[k], ends[k + 1])
        if at.start == at.stop:
            continue
        own = slice(1 + (k - 1) * IN_CLASS, 1 + k * IN_CLASS)
        place = target[at] - own.start
        error, inner = _softmax(states[at], w["Wo"][own].T, w["bo"][own], place, grads is not None)
        found[at] += inner
        if grads is not None:
            error[np.arange(len(place)), place] -= 1
            grads["Wo"][own] = error.T @ states[at]
            grads["bo"][own] = error.sum(axis=0)
            back[at] += error @ w["Wo"][own]
    whence = np.empty_like(order)
    whence[order] = np.arange(len(order))
    return found[whence], None if back is None else back[whence]


def backward(w: Weights, before: np.ndarray, kept: dict[str, np.ndarray], back: np.ndarray, grads: Weights) -> None:
    """Gradients of the state's weights over one window; nothing flows beyond its begin."""
    steps, lanes, hidden = back.shape
    of_gates = np.empty((steps, lanes, 3 * hidden), np.float32)
    of_state = np.empty_like(of_gates)
    carried = np.zeros((lanes, hidden), np.float32)
    turned = np.ascontiguousarray(w["U"].T)
    for t in range(steps - 1, -1, -1):
        h, a, c = (kept[n][t] for n in ("from", "inner", "c"))
        z, r = kept["zr"][t, :, :hidden], kept["zr"][t, :, hidden:]
        d = back[t] + carried
        dc = d * z * (1 - c * c)
        of_gates[t, :, :hidden] = d * (c - h) * z * (1 - z)
        of_gates[t, :, hidden : 2 * hidden] = dc * a * r * (1 - r)
        of_gates[t, :, 2 * hidden :] = dc
        of_state[t] = of_gates[t]
        of_state[t, :, 2 * hidden :] = dc * r
        carried = (d * (1 - z) + of_state[t] @ turned) * kept["on"][t]
    grads["U"] = kept["from"].reshape(-1, hidden).T @ of_state.reshape(-1, 3 * hidden)
    ids = np.where(before < 0, END, before).ravel()
    order = np.argsort(ids.astype(np.int16), kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    grads["X"] = np.zeros_like(w["X"])
    grads["X"][ids[first]] = np.add.reduceat(of_gates.reshape(-1, 3 * hidden)[order], first, axis=0)


def gradients(w: Weights, before: np.ndarray, target: np.ndarray, state: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """Gradients of the summed loss of a window, its last state, and its log-likelihood."""
    states, kept, last = forward(w, before, state)
    used = np.flatnonzero(target.ravel() >= 0)
    grads: Weights = {}
    found, part = output(w, states.reshape(-1, states.shape[2])[used], target.ravel()[used], grads)
    back = np.zeros((states.shape[0] * states.shape[1], states.shape[2]), np.float32)
    back[used] = part
    backward(w, before, kept, back.reshape(states.shape), grads)
    return grads, last, float(found.sum())


def learn(w: Weights, memory: Weights, texts: list[np.ndarray]) -> None:
    """Adagrad over the windows of the packed texts; ``w`` and ``memory`` change in place."""
    lanes = min(LANES, max(sum(map(len, texts)) // (STEPS * LEAST_WINDOWS), 16))
    state = np.zeros((lanes, w["U"].shape[0]), np.float32)
    for before, target, _ in windows(texts, lanes, STEPS):
        grads, state, _ = gradients(w, before, target, state[: before.shape[1]])
        scale = np.float32(1.0 / np.sqrt(max(int((target >= 0).sum()), 1)))
        for n, g in grads.items():
            g *= scale
            memory[n] += g * g
            w[n] -= np.float32(RATE) * g / np.sqrt(memory[n])


def scores(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's tokens, the state carried over all its windows."""
    total = np.zeros(len(texts))
    state = np.zeros((LANES, w["U"].shape[0]), np.float32)
    for before, target, owner in windows(texts, LANES, SCORE_STEPS) if texts else ():
        states, _, state = forward(w, before, state[: before.shape[1]], keep=False)
        used = np.flatnonzero(target.ravel() >= 0)
        found, _ = output(w, states.reshape(-1, states.shape[2])[used], target.ravel()[used])
        total += np.bincount(owner.ravel()[used], weights=found, minlength=len(texts))
    return total / LOG10


def _pieces(flat: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for i in range(0, len(flat), SLICE):
        yield i // SLICE, flat[i : i + SLICE].tobytes()


def averaged(df: DataFrame, w: Weights, words: Lexicon, text: str = "text") -> Weights:
    """One round: every task learns from its rows, beginning with ``w``; the mean of the weights by tokens.

    The driver gets one set of weights.  The sums are made slice by slice, streaming, so a task holds two slices.
    """
    sent = df.sparkSession.sparkContext.broadcast((w, words.parts()))
    names = list(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (head, counts, tokens, distinct) = sent.value
        own = {n: x.copy() for n, x in own.items()}
        start = {n: x.copy() for n, x in own.items()}
        get = Lexicon(b" ".join(head.split()[: SHORT - 2]), counts, tokens, distinct).ids().get
        memory = {n: np.full_like(x, 0.1) for n, x in own.items()}
        held, size, seen = [], 0, 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found = words_of(value)
                ids = np.empty(len(found) + 1, np.int32)
                ids[:-1] = np.fromiter(map(get, found, repeat(OTHER)), np.int32, len(found))
                ids[-1] = END
                held.append(ids)
                size += len(ids)
                if size >= PACK_TOKENS:
                    learn(own, memory, held)
                    seen, held, size = seen + size, [], 0
        if held:
            learn(own, memory, held)
            seen += size
        if seen:
            flat = np.concatenate([(own[n] - start[n]).ravel() for n in names])
            parts = list(_pieces(flat))
            yield pa.RecordBatch.from_pylist([{"slice": i, "tokens": seen, "data": x} for i, x in parts], schema=moved)

    kind = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("data", T.BinaryType())])
    moved = to_arrow_schema(kind)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, seen = None, None, 0
        for batch in batches:
            for i, tokens, data in zip(*(batch.column(c).to_pylist() for c in ("slice", "tokens", "data")), strict=True):
                part = np.frombuffer(data, np.float32) * float(tokens)
                if i != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([{"slice": at, "tokens": seen, "data": (total / seen).astype(np.float32).tobytes()}], schema=moved)
                    at, total, seen = i, np.zeros(len(part)), 0
                total += part
                seen += tokens
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"slice": at, "tokens": seen, "data": (total / seen).astype(np.float32).tobytes()}], schema=moved)

    learned = df.select(text).mapInArrow(run, kind).repartition("slice").sortWithinPartitions("slice").mapInArrow(summed, kind)
    rows = sorted(learned.collect(), key=lambda r: r["slice"])
    if not rows:
        return w
    flat = np.concatenate([np.frombuffer(r["data"], np.float32) for r in rows])
    out, begin = {}, 0
    for n in names:
        out[n] = w[n] + flat[begin : begin + w[n].size].reshape(w[n].shape)
        begin += w[n].size
    return out


def train(df: DataFrame, words: Lexicon, key: str = "doc_id", text: str = "text") -> Weights:
    """All rounds over the training fold; each text teaches once."""
    w = fresh_weights(words)
    spot = F.pmod(F.xxhash64(F.lit("round"), F.col(key).cast("string")), F.lit(100))
    low = 0
    for high in ROUNDS:
        w = averaged(df.filter((spot >= low) & (spot < high)), w, words, text)
        low = high
    return w


def scored(df: DataFrame, w: Weights, words: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, digest, counts and sums of each row over the tokens of the head, and its rare words with their numbers."""
    sent = df.sparkSession.sparkContext.broadcast((w, words.parts()))
    added = {"n_tokens": T.LongType(), "n_known": T.LongType(), "base": T.DoubleType(), "score": T.DoubleType()}
    added |= {"rare": T.ArrayType(T.StringType()), "times": T.ArrayType(T.IntegerType())}

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        own, parts = sent.value
        known = Lexicon(*parts)
        get = known.ids().get
        with np.errstate(divide="ignore"):
            base = np.log10((known.counts + ADDED) / known.total())
            rest = np.log10((known.counts + ADDED) / known.rare_total())
        rest[:SHORT] = 0.0
        rows, ids_of, size = [], [], 0

        def emit() -> list[list]:
            for row, s in zip(rows, scores(own, ids_of), strict=True):
                row[5] += float(s)
            return [list(x) for x in zip(*rows, strict=True)]

        for keys, digests, texts in batches:
            for k, digest, value in zip(keys, digests, texts, strict=True):
                found = words_of(value)
                ids = np.empty(len(found) + 1, np.int32)
                ids[:-1] = np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))
                ids[-1] = END
                rare = np.flatnonzero(ids < 0)
                strange = Counter(found[i].decode() for i in rare)
                held = ids[ids >= 0]
                rows.append([k, digest, len(ids), len(held) - (0 if known.counts[END] else 1), float(base[held].sum()), float(rest[held].sum()), list(strange), list(strange.values())])
                ids[(ids < 0) | (ids >= SHORT)] = OTHER
                ids_of.append(ids)
                size += len(ids)
                if size >= PACK_TOKENS:
                    yield emit()
                    rows, ids_of, size = [], [], 0
        if rows:
            yield emit()

    read = df.select(key, F.xxhash64(text).alias("__digest"), text)
    return map_rows(read, [key, "__digest", text], schema_of(read, key, "__digest", **added), run)


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row's whole text.

    Rows whose crc32(key as text) mod 10 is not 0 teach; the others, and those with a null key, are held out.
    Null texts count as empty: their one token is the end.  ``base_score`` is that of the smoothed word
    counts, ``score`` that of the recurrent model, both log10.  Repeated rows come back as often as they are there and with one
    result; rows with one key and different texts are rows of their own.  With nothing to learn from, the untrained model
    scores.  Weights depend on how the table is divided, so scores may differ in their decimals between divisions.
    Other columns aren't read.
    """
    held = F.coalesce(fold(key, 10) == 0, F.lit(True))
    taught = df.select(key, text).filter(~held)
    counts = written(count_words(taught, text))
    words = lexicon(counts, taught.count())
    rows = written(scored(df.select(key, text), train(taught, words, key, text), words, key, text))

    spread = rows.select(key, "__digest", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = spread.select(key, "__digest", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    met = rare.join(counts, "word", "left")
    share = F.coalesce("c", F.lit(0)) + ADDED

    def part(total: float) -> Column:
        return F.col("n") * F.log10(share / F.lit(total))

    sums = met.select(
        key, "__digest", F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).cast("long").alias("n_known"),
        part(words.total()).alias("base"), part(words.rare_total()).alias("score"), F.lit(0).alias("copies"),
    )
    every = rows.select(key, "__digest", "n_tokens", "n_known", "base", "score", F.lit(1).alias("copies")).unionByName(sums)
    # of rows that are equal each adds the same, so the mean is that of one
    by_row = every.groupBy(key, "__digest").agg(F.sum("copies").cast("int").alias("copies"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    copies = F.col("copies")
    out = by_row.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return out.select(
        key, held.alias("held_out"),
        (F.col("n_tokens") / copies).cast("long").alias("n_tokens"), (F.col("n_known") / copies).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / copies).alias("base_score"), (F.col("score") / copies).alias("score"),
    )
