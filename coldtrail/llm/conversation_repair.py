"""Repair of conversation structure: the cheapest edits to alternating turns, by an auction shortest-path algorithm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldtrail.llm.common import BLANKS

#: Costs of the edits, and of keeping or changing the role of a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STOPS = ".!?"
LEGAL = frozenset(("su", "ua", "au"))
#: States of the accepted pattern ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Initial of a role that may be kept, by state, and the state it leads to.
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
BLANK, DUPLICATE, CUT, FINE = "b", "d", "t", "."
BLOCK = 8  # rows between the origins of the auction
REMEMBERED = 64  # longest pattern kept in memory once solved

Arc = tuple[str, int, int]


class Lattice:
    """Nodes are (rows read, state); arcs are edits with integer costs, in the order of their letters. A pattern has two letters
    a row: the initial of its role (``x`` for any other) and its fault."""

    def __init__(self, pattern: str) -> None:
        self.rows = [(pattern[i], pattern[i + 1]) for i in range(0, len(pattern), 2)]
        self.end = STATES * (len(self.rows) + 1)

    def arcs(self, node: int) -> list[Arc]:
        row, state = divmod(node, STATES)
        insert = ("I", INSERT, STATES * row + NEXT[state])
        if row == len(self.rows):
            return [("", 0, self.end), insert] if state in (NOTHING, ASSISTANT) else [insert]
        initial, fault = self.rows[row]
        found = [("D", DELETE, node + STATES), insert]
        if fault in (BLANK, DUPLICATE):
            return found
        more = TRUNCATED if fault == CUT else 0
        if initial in KEEPS[state]:
            found.append(("K", more, STATES * (row + 1) + KEEPS[state][initial]))
        found.append(("R", REROLE + more, STATES * (row + 1) + NEXT[state]))
        return found

    def least_prices(self) -> list[int]:
        """Prices that no arc undercuts: what the rows from here on cost at least, whatever the state."""
        price, prices = 0, [0] * (STATES + 1)
        for initial, fault in reversed(self.rows):
            if fault in (BLANK, DUPLICATE):
                price += DELETE
            else:
                more = TRUNCATED if fault == CUT else 0
                price += min(DELETE, (0 if initial in "sua" else REROLE) + more)
            prices = [price] * STATES + prices
        return prices


def auction(lattice: Lattice) -> list[int]:
    """Node prices after the auction: no arc undercuts them (price <= cost + price ahead), and from the origin a path of
    arcs of equality leads to the end, so that the origin's price is the least cost.

    The path grows at its last node: where the price there is below the best arc's cost and price ahead, it rises to that
    and the path contracts by one node, else the path extends along the best arc. Origins move from the last rows to the
    first and keep the prices, so that a long conversation costs a bounded number of steps per row.
    """
    price, arcs = lattice.least_prices(), {}
    rows = len(lattice.rows)
    origins = [STATES * row + state for row in range(rows - 1, 0, -1) if row % BLOCK == 0 for state in range(STATES)]
    for origin in [*origins, NOTHING]:
        path = [origin]
        while path[-1] != lattice.end:
            node = path[-1]
            if node not in arcs:
                arcs[node] = lattice.arcs(node)
            best = min(arcs[node], key=lambda arc: arc[1] + price[arc[2]])
            ahead = best[1] + price[best[2]]
            if price[node] < ahead:
                price[node] = ahead
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best[2])
    return price


def traced(lattice: Lattice, price: list[int]) -> str:
    """The least string of letters along tight arcs from the origin to the end. Prices off the path may be too low, so a tight
    arc can lead nowhere: nodes without a tight way on are left for good."""
    dead, path = set(), [(NOTHING, iter(lattice.arcs(NOTHING)))]
    letters: list[str] = []
    while path:
        node, rest = path[-1]
        for letter, cost, ahead in rest:
            if price[node] == cost + price[ahead] and ahead not in dead:
                letters.append(letter)
                if ahead == lattice.end:
                    return "".join(letters)
                path.append((ahead, iter(lattice.arcs(ahead))))
                break
        else:
            dead.add(node)
            path.pop()
            if letters:
                letters.pop()
    raise AssertionError("an auction ends with a tight path")


def solved(pattern: str) -> tuple[int, str]:
    """(cost, audit) of a pattern."""
    lattice = Lattice(pattern)
    price = auction(lattice)
    return price[NOTHING], traced(lattice, price)


_remembered = lru_cache(1 << 16)(solved)


def pattern_of(rows: list[tuple[str, str]]) -> str:
    """Two letters for each (role, text): initial and first fault of blank, duplicate, truncated."""
    seen, letters = set(), []
    for role, text in rows:
        body = text.rstrip(BLANKS)
        if not body:
            fault = BLANK
        elif (role, text) in seen:
            fault = DUPLICATE
        else:
            fault = FINE if body[-1] in STOPS else CUT
        seen.add((role, text))
        letters.append((role[:1] if role[:1] in ("s", "u", "a") else "x") + fault)
    return "".join(letters)


def edited(rows: list[tuple[str, str]], audit: str) -> list[dict[str, str]]:
    """The rows after the edits."""
    state, at, out = NOTHING, 0, []
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append({"role": ROLES[state], "text": ""})
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            state = KEEPS[state][role[:1]]
            out.append({"role": role, "text": text})
        elif letter == "R":
            state = NEXT[state]
            out.append({"role": ROLES[state], "text": text})
    return out


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<struct<role:string,text:string>>"


def repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The values of ``RESULT`` for one conversation, its rows in order."""
    known = {t for t in turns if t is not None}
    pattern = pattern_of(rows)
    cost, audit = (_remembered if len(pattern) <= 2 * REMEMBERED else solved)(pattern)
    initials = [role[:1] for role, _ in rows]
    faults = pattern[1::2]
    return (
        max(known) - min(known) + 1 - len(known) if known else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), cost, audit, edited(rows, audit))


def repair_conversations(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", present: Column | None = None) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, and the repaired turns.

    Rows are taken by turn (nulls first), then role and text; a null role or text counts as one space, so the text is
    blank and the role cannot be kept. Rows for which ``present`` is false only name their conversation. A null id is one
    conversation. Repeated rows are duplicates of the first; a conversation without rows costs nothing; no rows give no
    rows; other columns are ignored. Texts are kept whole.

    Rows are sorted by conversation and read as a stream, one conversation at a time. The edits (Keep, Rerole, Delete,
    Insert) are arcs of a lattice over rows and states of ``(s?(ua)+)?``; ``auction`` prices its nodes, ``traced`` finds the
    least audit string along tight arcs.
    """
    space = F.lit(" ")
    named = rows.select(
        F.col(id_column).alias("conv_id"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_column).cast("string"), space).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    ordered = named.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = named.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, texts, name, begun, size = [], [], None, False, 0
        done: list[tuple] = []

        def given() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names)

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *([pa.int64()] * 6), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]
            for conv, turn, role, text, there in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv != name:
                    done.append((name, *repaired(turns, texts)))
                    turns, texts = [], []
                    if len(done) >= 1000 or size > 4_000_000:
                        yield given()
                        done, size = [], 0
                name, begun = conv, True
                if there:
                    turns.append(turn)
                    texts.append((role, text))
                    size += len(text)
        if begun:
            done.append((name, *repaired(turns, texts)))
            yield given()

    return ordered.mapInArrow(run, f"conv_id {kind}, {RESULT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): the rows damaged by crc32 of ``conv_id:turn`` modulo 20, nulls as one space: 0 loses
    the row (it stays, not present), 1 its text, 2 its stops; 3 repeats it; 4 makes its role user."""
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(case == 4, F.lit("user")).otherwise(said("role"))
    return conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (case != 0).alias("present"), F.explode(F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_")).drop("_")
