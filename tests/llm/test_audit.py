"""Filter audit and conversation repair against brute force, and odd rows."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from quadrat.llm import audit, conversations

SPACES = " \t\n\r\x0b\x0c"
ROLE_PATHS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def hurt(rows):
    """Rows (conv, turn, role, text) after the damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def brute_repair(rows):
    """Uniform-cost search over whole paths, ordered by cost and then by the edits."""
    rows = hurt(rows)
    seen, kinds = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACES)[-1:]
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "good")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    result = {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)),
    }
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            text = "\n".join(f"{r}:{t}" for r, t in made)
            return result | {"cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        if (i, state) in done:
            continue
        done.add((i, state))
        for initial, role in (("u", "user"), ("a", "assistant")):
            after = ROLE_PATHS.get((state, initial))
            if after:
                heapq.heappush(heap, (cost + 3, edits + "I", i, after, (*made, (role, ""))))
                if i < len(rows) and kinds[i] in ("good", "truncated"):
                    heapq.heappush(heap, (cost + 3 + 3 * (kinds[i] == "truncated"), edits + "R", i + 1, after, (*made, (role, rows[i][2]))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state, made))
            after = ROLE_PATHS.get((state, initials[i]))
            if after and kinds[i] in ("good", "truncated"):
                heapq.heappush(heap, (cost + 3 * (kinds[i] == "truncated"), edits + "K", i + 1, after, (*made, rows[i][1:])))


def talks(seed, count, longest):
    rnd = random.Random(seed)
    out = []
    for conv in range(count):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "what? ", "cut", "", " \n", None, f"row {rnd.randint(0, 40)}.", "end.\t"])
            out.append((conv if conv else None, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    return out


TALK = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@pytest.mark.parametrize("rows_in_block", [128, 3])
def test_repair_equals_brute_force(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", rows_in_block)
    rows = talks(3, 60, 9) + talks(4, 1, 150)[:140] + [(99, 0, "user", "x.")] * 5
    frame = spark.createDataFrame(rows, TALK)
    for name in ("gone", "fault", "conv", "number", "cost"):
        frame = frame.withColumn(name, frame.turn)
    out = {r.conv_id: r.asDict() for r in conversations.audit(frame).collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    assert set(out) == set(by_conv)
    for conv, own in by_conv.items():
        got = out[conv]
        got.pop("conv_id")
        assert got == brute_repair(own), (conv, hurt(own))


def test_repair_of_one_conversation_in_many_tasks(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"line {t}." if t % 11 else "line") for t in range(700)]
    out = conversations.audit(spark.createDataFrame(rows, TALK).repartition(4)).collect()
    assert len(out) == 1
    got = out[0].asDict()
    got.pop("conv_id")
    assert got == brute_repair(rows)


def test_repair_of_nothing(spark):
    assert conversations.audit(spark.createDataFrame([], TALK)).collect() == []
    # a conversation of which the damage leaves no row
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = conversations.audit(spark.createDataFrame([(conv, 0, "user", "Hi.")], TALK)).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_searches_go_the_ascii_least_way():
    good = conversations.GOOD
    # u u: delete one (4) or rerole one (3)
    assert conversations.search([("u", good), ("u", good)], conversations.START, conversations.ACCEPTING, True) == (3, "KR")
    assert conversations.search([("u", good)], conversations.START, conversations.ACCEPTING, True) == (3, "KI")
    assert conversations.search([], conversations.USER, conversations.ACCEPTING, True) == (3, "I")
    assert conversations.search([("s", good)], conversations.USER, (conversations.SYSTEM,), False)[0] == conversations.NEVER


def brute_counts(text):
    words = text.encode().split()
    return len(words), len(set(words)), sum(65 <= b <= 90 for b in text.encode()), sum(c in "#$%&*|" for c in text), len(text)


def test_transducer_counts_equal_brute_force(spark, odd):
    rnd = random.Random(5)
    parts = ["a", "b", "AB", "é", "😀", " ", " ", "\n", "\t", "\x1c", "#", "&", "word", "thelongerword", "abcdefgh", "abcdefghi", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 300))) for _ in range(300)] + ["", " ", "x" * 100_000, "ab Cd " * 50_000, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in audit.counts(frame, ["doc_id"]).collect():
        assert tuple(r)[1:] == brute_counts(texts[r.doc_id])
    want = sorted((r.doc_id is None, r.doc_id or 0, *brute_counts(r.text or "")) for r in odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in audit.counts(odd, ["doc_id"]).collect()) == want


def test_equal_numbers_do_not_make_words_equal(monkeypatch):
    """Entries are verified: with one number for all spans the count is right all the same."""
    import numpy as np

    monkeypatch.setattr(audit.SpanTable, "hashes", lambda self, begin, size: np.zeros(len(begin), np.uint64))
    text = b"one two three one two onetwo"
    found = audit.count_block(np.frombuffer(text + bytes(8), np.uint8), np.array([len(text)]), audit._classes(), audit._outputs())
    assert found["distinct"].tolist() == [4]


def brute_interactions(docs, labels):
    quality, toxic = {}, {}
    for key, q, t in labels:
        quality[key], toxic[key] = quality.get(key) or q == 1, toxic.get(key) or t == 1
    rows = []
    for key, text, part in docs:
        words, distinct, caps, symbols, points = brute_counts(text or "")
        fails = {"A": words < 50, "B": 100 * distinct < 65 * words, "C": 100 * caps > 5 * points, "D": symbols > 0}
        fails["E"] = any(k is not None and key is not None and k < key and (t or "") == (text or "") for k, t, _ in docs)
        rows.append((part or "", {f for f in fails if fails[f]}, bool(key is not None and quality.get(key)), bool(key is not None and toxic.get(key))))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [r for r in own if f in r[1] and not r[1] & before]
                shapley[part, f] += len(removed)
                out[part, order, step] = [
                    sum(not r[1] & (before | {f}) for r in own), len(removed), sum(f in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_interactions_equal_brute_force(spark, odd, none):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (7, 1, 1), (8, None, None), (None, 1, 1), (500, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.interactions(odd, marks).collect()}
    assert got == brute_interactions([(r.doc_id, r.text, r.source) for r in odd.collect()], labels)
    assert audit.interactions(none, marks).collect() == []
    assert len(audit.interactions(odd, marks.limit(0)).collect()) == 600 * odd.na.fill("", ["source"]).select("source").distinct().count()
