"""Repair of conversations by generalised LR parsing with weighted edits.

A conversation is right if its roles' initials read ``(s?(ua)+)?``. Its rows are parsed from left to right
over that grammar; each row may be kept, given another role or deleted, and turns without text may be
put in anywhere, each at its price. All ways are followed at once on a graph-structured stack: a stack
is a state with a link to the stack below it, stacks share what lies below, and of those with the same
state on top only the one of least (cost, audit) goes on. That is exact: what may follow depends on
the top alone (the two stacks below an open ``u``, with or without ``s``, accept the same rest), and of two
equally dear audits for the same rows neither begins the other, as all but their insertions are one
for each row and insertions cost; so their order stays whatever follows.

Spark deals the rows out by conversation and puts them in order; a task reads them as a stream and holds
the tops of the stack alone (each with its digest so far) and the audit, never the texts. A conversation's
digest is a chain over its rows, so one conversation is one task's stream, however long.

Defined results: null role or text is one space; rows go by turn (null first), then role, then text; an
empty role has no legal initial; a null conversation id is a conversation of its own; columns with
other names are left behind; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
# talk -> | turns | s turns    turns -> u a | turns u a
SHIFT = {0: {"s": 1, "turns": 2, "u": 3}, 1: {"turns": 5, "u": 3}, 2: {"u": 4}, 3: {"a": 6}, 4: {"a": 7}, 5: {"u": 4}}
POPS = {6: 2, 7: 3}  # symbols of the rule that is complete in this state; it makes "turns"
ACCEPTS = {0, 2, 5}
OUT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def read_symbol(stack: tuple, symbol: str) -> tuple | None:
    """The stack (state, stack below) after a symbol: one shift, and the reduction that it completes."""
    state = SHIFT[stack[0]].get(symbol)
    if state is None:
        return None
    stack = (state, stack)
    if state in POPS:
        for _ in range(POPS[state]):
            stack = stack[1]
        stack = (SHIFT[stack[0]]["turns"], stack)
    return stack


class Parse:
    """The tops of one conversation's stack. A top is (cost, order among tops, stack, audit, digest);
    audits are chains of (chain before, edits)."""

    def __init__(self) -> None:
        self.tops = [(0, 0, (0, None), None, None)]

    def inserted(self) -> list[tuple]:
        """Tops, and those after turns put in: (cost, order, edits, stack, top, roles put in)."""
        ways = {}
        queue = [(cost, order, "", stack, top, "") for top in self.tops for cost, order, stack in [top[:3]]]
        while queue:
            way = queue.pop()
            state = way[3][0]
            if state in ways and ways[state][:3] <= way[:3]:
                continue
            ways[state] = way
            for role in ROLES:
                if (stack := read_symbol(way[3], role)) is not None:
                    queue.append((way[0] + INSERT, way[1], way[2] + "I", stack, way[4], way[5] + role))
        return list(ways.values())

    def row(self, initial: str, must_go: bool, truncated: bool, role: bytes, text: bytes) -> None:
        best: dict[int, tuple] = {}
        for cost, order, edits, stack, top, put in self.inserted():
            ways = [(DELETE, "D", stack, None)]
            if not must_go:
                extra = TRUNCATED * truncated
                ways += [(extra, "K", read_symbol(stack, initial) if initial in ("s", "u", "a") else None, role)]
                ways += [(extra + REROLE, "R", read_symbol(stack, r), name.encode()) for r, name in ROLES.items()]
            for price, edit, to, said in ways:
                if to is not None and (to[0] not in best or (cost + price, order, edits + edit) < best[to[0]][:3]):
                    best[to[0]] = (cost + price, order, edits + edit, to, top, put, said)
        ranks = {key: i for i, key in enumerate(sorted((w[1], w[2]) for w in best.values()))}
        self.tops = [(w[0], ranks[w[1], w[2]], w[3], (w[4][3], w[2]), digest(w[4][4], w[5], w[6], text)) for w in best.values()]

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest way."""
        cost, _, edits, _, top, put = min((w for w in self.inserted() if w[3][0] in ACCEPTS), key=lambda w: w[:3])
        parts, chain = [edits], top[3]
        while chain is not None:
            chain, edits = chain
            parts.append(edits)
        done = digest(top[4], put, None, b"") or hashlib.sha256()
        return cost, "".join(reversed(parts)), done.hexdigest()


def digest(before: Any, put: str, role: bytes | None, text: bytes) -> Any:
    """The digest of what was said before (None: nothing), with turns put in and a row behind it."""
    said = [f"{ROLES[r]}:".encode() for r in put] + ([role + b":" + text] if role is not None else [])
    if not said:
        return before
    out = hashlib.sha256() if before is None else before.copy()
    out.update(b"\n".join(said) if before is None else b"\n" + b"\n".join(said))
    return out


class Talk:
    """What is known of a conversation so far."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parse, self.counts = conv_id, Parse(), [0, 0, 0, 0]
        self.low = self.turn = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, role: bytes, text: bytes, fault: int) -> None:
        initial = role.decode()[:1]
        if fault:
            self.counts[fault - 1] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.turns = turn, self.turns + 1
        self.parse.row(initial, fault in (1, 2), fault == 3, role, text)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts, *self.parse.end())


def with_faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each row: 1 blank, 2 duplicate (role and text are in an earlier row of the conversation), 3 truncated, else 0."""
    again = F.row_number().over(W.partitionBy("conv_id", "role", "text", "there").orderBy("turn", "copy")) > 1
    fault = F.when(~F.col("text").rlike(BLANK), 1).when(again, 2).when(~F.col("text").rlike(ENDED), 3).otherwise(0)
    return rows.withColumn("fault", fault)


def plain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column | None = None, copy: Column | None = None) -> DataFrame:
    """The columns that are read, with nulls as spaces; ``there`` false: a row of which only the conversation's id counts."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    ids = [F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn")]
    return rows.select(*ids, text(role_col).alias("role"), text(text_col).alias("text"), (F.lit(True) if there is None else there).alias("there"), (F.lit(0) if copy is None else copy).alias("copy"))


def in_order(rows: DataFrame) -> DataFrame:
    """Whole conversations to a task, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "copy")


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None, copy: Column | None = None) -> DataFrame:
    """A row for each conversation: counts of its faults, cost and audit of the cheapest repair (K keep,
    R new role, D delete, I insert) and the SHA-256 of the repaired ``role:text`` lines. ``there``: rows without it
    only keep their conversation in the result; ``copy`` orders rows that are equal otherwise."""
    ready = in_order(with_faults(plain(rows, conv_col, turn_col, role_col, text_col, there, copy)))
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, done = None, []
        for batch in batches:
            for conv_id, turn, role, text, there, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if talk is None or talk.conv_id != conv_id:
                    if talk is not None:
                        done.append(talk.result())
                    talk = Talk(conv_id)
                if there:
                    talk.add(turn, role, text, fault)
            if len(done) >= 1000:
                yield table(done)
                done = []
        if talk is not None:
            done.append(talk.result())
        yield table(done)

    def table(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate(kinds)], names)

    return ready.select("conv_id", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "there", "fault").mapInArrow(run, OUT)


def repaired_messages(rows: DataFrame, repaired: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations themselves (conv_id, place from 0, role, text), from the audits of ``repair`` over the
    same rows: each edit belongs to the row of its number among edits that are no insertions."""
    edits = repaired.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    w = W.partitionBy("conv_id").orderBy("at")
    edits = edits.withColumn("row_no", F.sum((F.col("edit") != "I").cast("int")).over(w)).where("edit <> 'D'").withColumn("place", F.row_number().over(w) - 1)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = plain(rows, conv_col, turn_col, role_col, text_col).withColumn("row_no", F.row_number().over(order)).select(F.col("conv_id").alias("_c"), "row_no", "role", "text")
    own = own.withColumnRenamed("row_no", "_n")
    both = edits.join(own, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("row_no") == F.col("_n")) & (F.col("edit") != "I"), "left")
    system = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(W.partitionBy("conv_id"))
    turn = F.when((F.col("place") + system) % 2 == 0, "user").otherwise("assistant")
    return both.select("conv_id", "place", F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
