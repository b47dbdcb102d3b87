"""Repair of the structure of conversations by iterative-deepening A*.

The roles of a repaired conversation read ``(s?(ua)+)?``.  The cheapest edits are found by a
depth-first search that tries the edits of a row in ASCII order under a bound of the cost;
the bound rises to the least cost that overran it, until a path is accepted.  The first accepted path
is the ASCII-least one of the cheapest.  A table keeps for each state what a failed search
has shown to be needed from there, so no state is searched again within that.

A conversation of any length is cut into blocks of rows.  Each block is searched on its own for
each grammar state in which it may begin and end; two passes over the blocks, which stream and
hold four numbers, then choose the states in between.  So no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadrat.llm.common import SPACES
from quadrat.session import written

#: Rows, and characters of text, of a block.
BLOCK_ROWS, BLOCK_CHARS = 128, 4_000_000
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where each role's initial leads from each state; what is missing is forbidden.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a rerole or an insert gives in each state; the grammar leaves one choice.
GIVEN = ("user", "user", "assistant", "user")
ACCEPTING = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: More than any cost.
NEVER = 1 << 60
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = frozenset(("su", "ua", "au"))


def search(rows: list[tuple[str, int]], entry: int, goals: tuple[int, ...], trailing: bool) -> tuple[int, str]:
    """Least cost and ASCII-least edits of rows (role initial, fault) from ``entry`` to one of ``goals``.

    ``trailing`` allows inserts after the last row.  Returns (NEVER, "") where no edits lead there.
    """
    count = len(rows)
    least = [0] * (count + 1)  # what the rows from here on cost at least, whatever their roles
    for i in range(count - 1, -1, -1):
        fault = rows[i][1]
        least[i] = least[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else CUT_OFF if fault == TRUNCATED else 0)
    needed: dict[tuple[int, int], int] = {}  # failed states: a proven lower bound of what is left to pay

    def moves(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """Edits in ASCII order: initial, cost, next row, next state."""
        out = []
        given = NEXT[state, GIVEN[state][0]]
        if i < count:
            initial, fault = rows[i]
            out.append(("D", DELETE, i + 1, state))
            out.append(("I", INSERT, i, given))
            if fault in (GOOD, TRUNCATED):
                more = CUT_OFF if fault == TRUNCATED else 0
                if (state, initial) in NEXT:
                    out.append(("K", KEEP + more, i + 1, NEXT[state, initial]))
                out.append(("R", REROLE + more, i + 1, given))
        elif trailing:
            out.append(("I", INSERT, i, given))
        return out

    def deepen(bound: int) -> str | None:
        """Depth-first under the bound, with a stack of its own; None when nothing is accepted."""
        path: list[str] = []
        # one frame a node: place, state, left to spend, its moves, the next move, least that a child needs
        stack = [[0, entry, bound, moves(0, entry), 0, NEVER]]
        if count == 0 and entry in goals:
            return ""
        while stack:
            frame = stack[-1]
            i, state, left, options, turn, _ = frame
            if turn == len(options):
                stack.pop()
                needed[i, state] = max(needed.get((i, state), least[i]), frame[5])
                if stack:
                    parent = stack[-1]
                    cost = parent[3][parent[4] - 1][1]
                    parent[5] = min(parent[5], cost + needed[i, state])
                    path.pop()
                continue
            frame[4] += 1
            initial, cost, row, after = options[turn]
            known = needed.get((row, after), least[row])
            if cost + known > left:
                frame[5] = min(frame[5], cost + known)
                continue
            path.append(initial)
            if row == count and after in goals:
                return "".join(path)
            stack.append([row, after, left - cost, moves(row, after), 0, NEVER])
        return None

    if not _reaches(rows, entry, goals, trailing):
        return NEVER, ""
    bound = least[0]
    while True:
        found = deepen(bound)
        if found is not None:
            return bound, found
        bound = max(needed[0, entry], bound + 1)


def _reaches(rows: list[tuple[str, int]], entry: int, goals: tuple[int, ...], trailing: bool) -> bool:
    """Whether any edits lead from ``entry`` to a goal; without this a bound could rise for ever."""
    states = {entry}

    def inserted(states: set[int]) -> set[int]:
        once = states | {NEXT[s, GIVEN[s][0]] for s in states}
        return once | {NEXT[s, GIVEN[s][0]] for s in once}

    for initial, fault in rows:
        states = inserted(states)  # what a rerole reaches, an insert and a delete reach as well
        states |= {NEXT[s, initial] for s in states if fault in (GOOD, TRUNCATED) and (s, initial) in NEXT}
    return bool((inserted(states) if trailing else states) & set(goals))


def repaired(rows: list[tuple[str | None, str | None]], edits: str, state: int) -> Iterator[tuple[str, str]]:
    """Role and text of each row that the edits leave or insert, beginning in a grammar state."""
    at = 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        if edit == "I":
            yield GIVEN[state], ""
            state = NEXT[state, GIVEN[state][0]]
            continue
        role, text = rows[at]
        at += 1
        if edit == "R":
            role = GIVEN[state]
        state = NEXT[state, role[0]]
        yield role, text


@dataclass
class Block:
    """Consecutive rows of one conversation, at most BLOCK_ROWS of them."""

    conv: object
    number: int
    first: bool  # surely the first block of its conversation
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)
    chars: int = 0

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS


def _statistics(block: Block) -> dict:
    """Counts of a block that add up over blocks, and its ends for what lies between blocks."""
    initials = [r[:1] for r in block.roles]
    turns = sorted(set(block.turns))
    return {
        "blank": block.faults.count(BLANK),
        "duplicate": block.faults.count(DUPLICATE),
        "truncated": block.faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "turns": len(turns),
        "low": turns[0] if turns else None,
        "high": turns[-1] if turns else None,
        "head": initials[0] if initials else None,
        "tail": initials[-1] if initials else None,
    }


def _table(block: Block, last: bool | None) -> list[dict]:
    """For each state in which the block may begin: cost and edits to each state in which it may end, and to the end.

    ``last`` says whether the block ends its conversation; None means that it may.
    """
    rows = [(r[:1], f) for r, f in zip(block.roles, block.faults, strict=True)]
    out = []
    for entry in (START,) if block.first else (START, SYSTEM, USER, ASSISTANT):
        if last is not True:
            for leave in (START, SYSTEM, USER, ASSISTANT):
                cost, edits = search(rows, entry, (leave,), trailing=False)
                if cost < NEVER:
                    out.append({"entry": entry, "leave": leave, "cost": cost, "edits": edits})
        if last is not False:
            cost, edits = search(rows, entry, ACCEPTING, trailing=True)
            out.append({"entry": entry, "leave": None, "cost": cost, "edits": edits})
    return out


_STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")]
    + [T.StructField(n, T.StringType()) for n in ("head", "tail")]
)
_PATHS = T.ArrayType(
    T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("edits", T.StringType())])
)


def plain(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows for :func:`repair` as they are; nulls of role and text count as one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *filled, F.lit(False).alias("gone"))


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows ``conv``, ``turn``, ``role``, ``text`` and ``gone`` after the damage that crc32 of ``conv:turn`` deals out.

    Of 20 remainders 0 drops a row (``gone``), 1 empties its text, 2 removes its full stops, exclamation and question
    marks, 3 repeats it, 4 makes its role user.  Nulls of any column count as one space.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat_ws(":", filled(conv), filled(turn))), F.lit(20))
    text_after = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(filled(text), ".!?", "")).otherwise(filled(text))
    return df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(filled(role)).alias("role"), text_after.alias("text"),
        (kind == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """The rows with their first ``fault``; ``rows`` are those of :func:`damage`.

    Equal rows (conversation, role, text) are grouped by a digest and counted by turn before they are
    shuffled, and only those that occur again are joined back.  Of equal rows the one of the
    smallest turn came first; of equal rows of one turn any may be taken as the first.
    """
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    rows = rows.withColumn("digest", F.when(~F.col("gone"), F.unhex(digest)))
    said = F.rtrim("text", F.lit(SPACES))
    blank, ends = said == "", F.right(said, F.lit(1)).isin(".", "!", "?")
    by_turn = rows.filter(~F.col("gone") & ~blank).groupBy("conv", "digest", "turn").agg(F.count(F.lit(1)).alias("n"))
    # a null turn stands before all others
    again = by_turn.groupBy("conv", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("turn")).alias("first")).filter("n > 1")
    at_first = by_turn.alias("b").join(again.alias("a"), F.col("b.conv").eqNullSafe(F.col("a.conv")) & (F.col("b.digest") == F.col("a.digest")))
    repeats = at_first.select("b.conv", "b.digest", "b.turn", F.col("b.turn").eqNullSafe(F.col("a.first.turn")).alias("leads"), F.col("b.n").alias("same"))
    x, y = rows.alias("x"), repeats.alias("y")
    met = x.join(
        y,
        F.col("x.conv").eqNullSafe(F.col("y.conv")) & (F.col("x.digest") == F.col("y.digest")) & F.col("x.turn").eqNullSafe(F.col("y.turn")),
        "left",
    )
    # the first of the equal rows of the first turn is found while the rows stream by, since they stand side by side
    fault = F.when(blank, F.lit(BLANK)).when(F.col("y.leads") == False, F.lit(DUPLICATE)).when(~ends, F.lit(TRUNCATED)).otherwise(F.lit(GOOD))  # noqa: E712
    return met.select("x.conv", "x.turn", "x.role", "x.text", "x.gone", fault.cast("int").alias("fault"))


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the rows of :func:`faults`, with their statistics and table of paths.

    The rows are sorted by ranges of (conversation, turn, role, text), so a long conversation
    lies in several tasks.  Texts stay with a block only if its conversation may go on before
    or after it; where it holds a whole conversation, the repair is done at once (``sha``).
    """
    name = [f.name for f in rows.schema]
    schema = T.StructType(
        [
            T.StructField("conv", rows.schema["conv"].dataType), T.StructField("number", T.LongType()), T.StructField("whole", T.BooleanType()),
            T.StructField("stats", _STATS), T.StructField("paths", _PATHS), T.StructField("sha", T.StringType()),
            T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def finish(block: Block, last: bool | None) -> dict:
        paths = _table(block, last)
        whole = block.first and last is True
        sha = None
        if whole:
            lines = (f"{role}:{text}" for role, text in repaired(list(zip(block.roles, block.texts, strict=True)), paths[0]["edits"], START))
            sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        kept = {"roles": None, "texts": None} if whole else {"roles": block.roles, "texts": block.texts}
        return {"conv": block.conv, "number": block.number, "whole": whole, "stats": _statistics(block), "paths": paths, "sha": sha} | kept

    def cut(values: Iterator[tuple], part: int) -> Iterator[dict]:
        block, before, number = None, None, part << 32
        for conv, turn, role, text, gone, fault in values:
            if block is None or conv != block.conv:
                if block is not None:
                    yield finish(block, True)
                block, before = Block(conv, number, first=block is not None), None
                number += 1
            elif block.full():
                yield finish(block, False)
                block = Block(conv, number, first=False)
                number += 1
            if gone:
                continue
            # equal rows of one turn stand side by side: all but the first repeat it
            if fault in (GOOD, TRUNCATED) and before == (turn, role, text):
                fault = DUPLICATE
            before = (turn, role, text)
            block.roles.append(role)
            block.texts.append(text)
            block.faults.append(fault)
            block.chars += len(text)
            if turn is not None:
                block.turns.append(turn)
        if block is not None:
            yield finish(block, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        values = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in name), strict=True))
        yield from _batches(cut(values, part), arrow)

    keys = ["conv", "turn", "role", "text"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _batches(found: Iterator[dict], arrow: pa.Schema, rows: int = 500, chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded in number and in characters."""
    held: list[dict] = []
    size = 0
    for row in found:
        held.append(row)
        size += sum(map(len, row.get("texts") or ()))
        if len(held) >= rows or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _streamed(df: DataFrame, schema: T.StructType, fold, columns: list[str], descending: bool = False) -> DataFrame:
    """``fold`` over the open blocks, the blocks of a conversation one after the other in one task, never held together."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from _batches(fold(rows), arrow)

    number = F.col("number").desc() if descending else F.col("number")
    return df.select(*columns).repartition("conv").sortWithinPartitions("conv", number).mapInArrow(run, schema)


def _ahead(rows: Iterator[dict]) -> Iterator[dict]:
    """For each block, last one first, the cost of all that follows from each state in which it may be left."""
    conv, after, begun = None, None, False
    for row in rows:
        if not begun or row["conv"] != conv:
            conv, after, begun = row["conv"], None, True
        yield {"conv": conv, "number": row["number"], "ahead": after}
        costs = [NEVER] * 4
        for p in row["paths"]:
            if (p["leave"] is None) == (after is None):
                costs[p["entry"]] = min(costs[p["entry"]], p["cost"] + (0 if after is None else after[p["leave"]]))
        after = [min(c, NEVER) for c in costs]


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """Results of conversations of several blocks, first block first; texts go into a running hash."""
    state = None

    def result() -> dict:
        gaps = state["high"] - state["low"] + 1 - state["turns"] if state["low"] is not None else 0
        counts = {n: state[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")}
        return {"conv": state["conv"], "gaps": gaps} | counts | {"audit": "".join(state["edits"]), "repaired_sha256": state["sha"].hexdigest()}

    for row in rows:
        if state is None or row["conv"] != state["conv"]:
            if state is not None:
                yield result()
            state = {
                "conv": row["conv"], "at": START, "edits": [], "sha": hashlib.sha256(), "empty": True, "cost": 0, "tail": None,
                "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
            }
        stats, after = row["stats"], row["ahead"]
        for n in ("blank", "duplicate", "truncated", "illegal", "turns"):
            state[n] += stats[n]
        if stats["head"] is not None:
            if state["tail"] is not None:
                state["illegal"] += state["tail"] + stats["head"] not in LEGAL
            state["tail"] = stats["tail"]
        if stats["low"] is not None:
            state["turns"] -= state["high"] == stats["low"]  # a turn that the cut divides
            state["low"] = stats["low"] if state["low"] is None else state["low"]
            state["high"] = stats["high"]
        ways = [p for p in row["paths"] if p["entry"] == state["at"] and (p["leave"] is None) == (after is None)]
        # two ways differ in an edit of this block, so its own edits decide between ties
        best = min(ways, key=lambda p: (p["cost"] + (0 if after is None else after[p["leave"]]), p["edits"]))
        for role, text in repaired(list(zip(row["roles"], row["texts"], strict=True)), best["edits"], state["at"]):
            state["sha"].update(f"{'' if state['empty'] else chr(10)}{role}:{text}".encode())
            state["empty"] = False
        state["edits"].append(best["edits"])
        state["cost"] += best["cost"]
        state["at"] = best["leave"]
    if state is not None:
        yield result()


def repair(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Faults, cheapest repair and digest of each conversation of the rows of :func:`damage` or :func:`plain`.

    Returns the conversation (named ``conv``), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``
    (long), ``audit`` and ``repaired_sha256``.  Rows are taken by turn, nulls first, and those of one turn by role and
    text.  A null role, which counts as one space, is never legal; rows without a conversation are one conversation of
    their own.  A conversation without rows after the damage has zeros, no audit and the hash of nothing; an
    empty table has no conversations.
    """
    # written once: the bounds of the ranges are found by sampling, and the steps below must see the same blocks
    cut = written(blocks(faults(rows)))
    span = F.col("stats.high") - F.col("stats.low") + 1 - F.col("stats.turns")
    only = F.col("paths")[0]
    whole = cut.filter("whole").select(
        "conv", F.coalesce(span, F.lit(0).cast("long")).alias("gaps"),
        *(F.col(f"stats.{n}").alias(n) for n in ("blank", "duplicate", "truncated", "illegal")),
        only["cost"].alias("cost"), only["edits"].alias("audit"), F.col("sha").alias("repaired_sha256"),
    )
    parts = cut.filter("not whole")
    key = T.StructField("conv", cut.schema["conv"].dataType)
    costs = T.StructType([key, T.StructField("number", T.LongType()), T.StructField("ahead", T.ArrayType(T.LongType()))])
    ahead = _streamed(parts, costs, _ahead, ["conv", "number", "paths"], descending=True)
    told = parts.join(ahead.select("number", "ahead"), "number")
    joined = _streamed(told, whole.schema, _joined, ["conv", "number", "stats", "paths", "roles", "texts", "ahead"])
    return whole.unionByName(joined).withColumnRenamed("conv", conv)


def audit(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`repair` after :func:`damage`; other columns aren't read."""
    return repair(damage(df, conv, turn, role, text), conv)
