"""Conversation structure repair: the cheapest edits that give every conversation legal turns, by a Viterbi search.

Rows are dealt by conversation and sorted, and one task streams past them a row at a time. Four states describe the
turns kept so far (none, system only, last one user, last one assistant); per state one survivor lives, the cheapest
way to reach it and of equal ones the least in ASCII. Survivors are leaves of a tree of backpointers; a node goes
with the last leaf below it, as its count of references tells. Once all survivors share an ancestor, the edits down
to it are final: they are handed out and forgotten, so memory holds the undecided suffixes alone. Equal costs are
settled by the whole undecided suffixes: of two survivors it is known from row to row which suffix is less, and no
suffix is the beginning of another, as each ends with the edit of the same row. A survivor that another one beats
whatever follows is dropped, or else the survivor that deletes all would keep every tree alive.

A conversation is searched and hashed in order, so its rows meet in one task, which holds one of them at a time, the
undecided edits and, for the repaired text's hash, one hash state per survivor. The rows are sorted outside of Python,
with spilling. What can grow with a conversation is the answer itself, its string of edits, and the undecided
suffixes of one whose ending decides its beginning, such as turns of a single role: two short strings a row.

Defined results: NULL role and text read as one space, so that such a turn is blank or has no legal role; turns
are taken in the order of turn (NULL first), role, text, so rows that tie are interchangeable; NULL conv_id is a conversation
of its own; an empty role fits nowhere; a very long text is one row as any other; rows that are no longer
``present`` only tell that their conversation exists; an empty table gives an empty table; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from proofledger.llm.common import by_rows

#: Text without the ASCII white space at its end.
ENDED = f"trim(TRAILING concat({', '.join(f'char({c})' for c in (32, *range(9, 14)))}) FROM text)"
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What the kept turns end with.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: Edits of a conversation that are handed out together.
PIECE = 1 << 16
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def after_insert(state: int) -> int:
    return ASSISTANT if state == USER else USER


def after_keep(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


@dataclass(eq=False)
class Node:
    """One row's edits. ``refs`` counts the nodes below and the survivor that ends here."""

    above: Node | None
    edits: str
    roles: str
    held: tuple[str, str] | None
    refs: int = 0
    below: list[Node] = field(default_factory=list)


@dataclass(eq=False)
class Survivor:
    """``rank``: its place among the survivors in ASCII order of their edits."""

    cost: int
    rank: int
    node: Node
    digest: object
    lines: int


class Search:
    """The search of one conversation. ``decided`` takes edits and roles (of what is kept or inserted, - where deleted)
    of each row once they are final, and with ``hold`` the row's own (role, text)."""

    def __init__(self, decided, hold: bool = False):
        self.decided, self.hold = decided, hold
        self.root = Node(None, "", "", None, refs=1)
        self.alive = {EMPTY: Survivor(0, 0, self.root, hashlib.sha256(), 0)}

    def row(self, role: str, text: str, fault: int) -> None:
        best: dict[int, tuple] = {}

        def offer(state: int, cost: int, source: Survivor, edits: str, roles: str) -> None:
            way = (cost, source.rank, edits, roles, source)
            if state not in best or way[:3] < best[state][:3]:
                best[state] = way

        kept = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, s in self.alive.items():
            put = after_insert(state)
            for at, cost, edits, roles in ((state, s.cost, "", ""), (put, s.cost + INSERT_COST, "I", "ua"[put == ASSISTANT])):
                offer(at, cost + DELETE_COST, s, edits + "D", roles + "-")
                if fault in (BLANK, DUPLICATE):
                    continue
                to = after_keep(at, role[:1])
                if to is not None:
                    offer(to, cost + kept, s, edits + "K", roles + role[:1])
                to = after_insert(at)
                offer(to, cost + kept + REROLE_COST, s, edits + "R", roles + "ua"[to == ASSISTANT])
        order = sorted(best, key=lambda state: best[state][1:3])
        ranks = {state: rank for rank, state in enumerate(order)}
        best = self.worth_keeping(best, ranks)
        old, self.alive = self.alive, {}
        for state, (cost, _, edits, roles, source) in best.items():
            node = Node(source.node, edits, roles, (role, text) if self.hold else None, refs=1)
            source.node.refs += 1
            source.node.below.append(node)
            digest, lines = source.digest.copy(), source.lines
            for line in written(edits, roles, role, text):
                digest.update((b"\n" if lines else b"") + line)
                lines += 1
            self.alive[state] = Survivor(cost, ranks[state], node, digest, lines)
        for s in old.values():
            self.release(s.node)
        self.hand_out()

    @staticmethod
    def worth_keeping(best: dict, ranks: dict) -> dict:
        """Without the survivors that another one beats whatever follows: it could do the same, at a lower total."""
        def cost(state: int) -> int:
            return best[state][0] if state in best else 1 << 60

        def beats(one: int, other: int) -> bool:
            return one in best and (best[one][0], ranks[one]) < (best[other][0], ranks[other])

        gone = set()
        if cost(EMPTY) > min(cost(ASSISTANT) + DELETE_COST, cost(USER) + INSERT_COST + DELETE_COST):
            gone.add(EMPTY)  # an assistant's turn goes on as no turn does, but for a system turn, which it deletes
        for state in (SYSTEM, ASSISTANT):
            if state in best and (cost(state) > cost(USER) + INSERT_COST or beats(EMPTY, state)
                                  or state == SYSTEM and beats(ASSISTANT, state)):
                gone.add(state)
        if cost(USER) > min(cost(EMPTY), cost(SYSTEM), cost(ASSISTANT)) + INSERT_COST:
            gone.add(USER)
        return {state: way for state, way in best.items() if state not in gone}

    @staticmethod
    def release(node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.above is not None:
            above = node.above
            above.below.remove(node)
            above.refs -= 1
            node = above

    def hand_out(self) -> None:
        while self.root.refs == 1 and self.root.below:
            self.root = self.root.below[0]
            self.root.above = None
            self.decided(self.root.edits, self.root.roles, self.root.held)

    def end(self) -> tuple[int, str]:
        """Cost and hash of the cheapest conversation; decides what is left."""
        ends = []
        for state, s in self.alive.items():
            more = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]
            ends.append((s.cost + INSERT_COST * len(more), s.rank, more, s))
        cost, _, more, s = min(ends, key=lambda e: e[:2])
        left, node = [], s.node
        while node is not None and node is not self.root:
            left.append(node)
            node = node.above
        for node in reversed(left):
            self.decided(node.edits, node.roles, node.held)
        roles = "ua"[-len(more):] if more else ""
        for line in written(more, roles, "", ""):
            s.digest.update((b"\n" if s.lines else b"") + line)
            s.lines += 1
        if more:
            self.decided(more, roles, None)
        return cost, s.digest.hexdigest()


def named(initial: str) -> str:
    return "user" if initial == "u" else "assistant"


def written(edits: str, roles: str, role: str, text: str) -> Iterator[bytes]:
    for edit, initial in zip(edits, roles, strict=True):
        if edit == "I":
            yield f"{named(initial)}:".encode()
        elif edit != "D":
            yield f"{role if edit == 'K' else named(initial)}:{text}".encode("utf-8", "surrogatepass")


def ordered(turns: DataFrame, present: Column | None) -> DataFrame:
    """conv_id, present, turn, role, text, fault: dealt by conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.coalesce(present if present is not None else F.lit(True), F.lit(False)).alias("present"),
                        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("same", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    again = Window.partitionBy("conv_id", "present", "same").orderBy(F.col("turn").asc_nulls_first())
    ended = F.expr(ENDED)
    # One exchange: rows of a conversation with equal text are rows of the conversation.
    return rows.repartition("conv_id").withColumn("earlier", F.row_number().over(again) > 1).withColumn(
        "fault", F.when(ended == "", BLANK).when(F.col("earlier"), DUPLICATE)
        .when(~F.substring(ended, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)).sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "earlier").select(
        "conv_id", "present", "turn", "role", "text", "fault")


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """First row?, and the row, of every row in the order of the table."""
    last, begun = None, False
    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in batch.columns]
            yield not begun or row[0] != last, row
            last, begun = row[0], True


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Edits of every conversation of ``turns`` (conv_id, turn, role, text), in pieces: conv_id, piece (from 0), audit
    (initials of Keep, Rerole, Delete, Insert), roles (initials, - where deleted); the last piece of a conversation
    also has gaps, blank, duplicate, truncated, illegal, cost and the hash of the repaired turns.

    Rows for which ``present`` does not hold are no turns, but their conversation is returned.
    """
    rows = ordered(turns, present)
    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("piece", pa.int64()),
                        ("audit", pa.string()), ("roles", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("repaired_sha256", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        search = None
        for fresh, (conv, present_, turn, role, text, fault) in conversations(batches):
            if fresh:
                if search is not None:
                    yield from closed()
                edits, roles, piece, size = [], [], 0, 0
                key, faults, illegal, before = conv, [0, 0, 0, 0], 0, None
                first = latest = None
                distinct = 0

                def decided(e: str, r: str, _: tuple | None) -> None:
                    nonlocal size
                    edits.append(e)
                    roles.append(r)
                    size += len(e)

                def closed() -> Iterator[tuple[int, tuple]]:
                    cost, sha = search.end()
                    gaps = latest - first + 1 - distinct if distinct else 0
                    yield 256 + 2 * size, (key, piece, "".join(edits), "".join(roles), gaps, *faults[1:], illegal, cost, sha)

                search = Search(decided)
            if not present_:
                continue
            faults[fault] += 1
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            if turn is not None and turn != latest:
                first, latest, distinct = turn if first is None else first, turn, distinct + 1
            search.row(role, text, fault)
            if size >= PIECE:
                yield 2 * size, (key, piece, "".join(edits), "".join(roles), *[None] * (len(COUNTS) + 1))
                edits.clear()
                roles.clear()
                piece, size = piece + 1, 0
        if search is not None:
            yield from closed()

    return by_rows(rows, task, schema)


def totals(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``, its audit joined."""
    parts = F.array_sort(F.collect_list(F.struct("piece", "audit")))
    return pieces.groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in COUNTS], F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"),
        F.max("repaired_sha256").alias("repaired_sha256"))


def repaired(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit, role, text. A row leaves the task once its edit is decided."""
    rows = ordered(turns, present)
    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("place", pa.int64()), ("edit", pa.string()),
                        ("role", pa.string()), ("text", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        search, out, key, place = None, [], None, 0

        def decided(edits: str, initials: str, held: tuple[str, str] | None) -> None:
            role, text = held or ("", "")
            for edit, initial in zip(edits, initials, strict=True):
                if edit != "D":
                    out.append((edit, role if edit == "K" else named(initial), "" if edit == "I" else text))

        def handed() -> Iterator[tuple[int, tuple]]:
            nonlocal place
            for edit, role, text in out:
                yield len(text), (key, place, edit, role, text)
                place += 1
            out.clear()

        for fresh, (conv, present_, _, role, text, fault) in conversations(batches):
            if fresh:
                if search is not None:
                    search.end()
                    yield from handed()
                search, key, place = Search(decided, hold=True), conv, 0
            if present_:
                search.row(role, text, fault)
                yield from handed()
        if search is not None:
            search.end()
            yield from handed()

    return by_rows(rows, task, schema)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with known faults, for measuring the repair: by crc32 of ``conv_id:turn`` modulo 20, 0 is dropped, 1 loses
    its text, 2 its full stops, exclamation and question marks, 3 comes twice, 4 is the user's. NULLs are one space.
    Returns the rows, dropped ones included, and the condition that tells which are there."""
    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        "kind", copies.alias("copy")), F.col("kind") != 0
