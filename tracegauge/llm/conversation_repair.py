"""Repair of conversation structure: a Viterbi search whose survivors coalesce.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Each row is kept (cost 0), given the
role user or assistant (2) or deleted (3), and empty rows of either role are inserted (2). Blank rows and
repeats of an earlier role and text have to go; a row that breaks off costs 1 more if it stays. Of the cheapest
edit scripts the one whose initials (D, I, K, R) come first in ASCII order wins.

A survivor is the best script to one of four states: nothing yet, after the system row, after a user row,
after an assistant row. Survivors are leaves of a tree of backpointers, whose nodes count their children; dead
branches are freed. Once all survivors share an ancestor, the edits down to it are final, are given out and
forgotten, so memory holds the unresolved suffixes only. Equal costs are decided by the complete unresolved
suffixes: the survivors are kept in the order of these, which each row extends. That is exact, as no survivor
is a prefix of another: insertions stand directly before a row that stays (an insertion before a deletion is
never first in ASCII order) or at the end, so every script of the same rows ends in a row's own letter.
Rows that must go extend all survivors alike and are counted, not stored. States that cannot win any more are
dropped, else the script that deletes all would never coalesce.

Rows are sorted over the whole table by conversation, turn and content, so a conversation may span many
tasks. A first pass sums up the two conversations at the rims of every partition: cost and order of the
survivors for each state the part may be entered in (at most two small rows for a partition). From
these follow the states at the seams, and a second pass repairs every part with one fixed entry and exit.

Defined results: a null role or text is one space, so it is blank or has to be re-labelled. A null conversation
id is a conversation of its own. Rows with a null turn come first; rows of one turn are ordered by role, the
first 32 characters and a hash of the text, so equal rows are neighbours. Repeated rows are duplicates. A
conversation without rows has no edits. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import SPACES, checkpointed, stored

START, SYSTEM, USER, ASSISTANT = range(4)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: State after a row with this role, by the state before.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLE = {"u": b"user", "a": b"assistant"}
#: Roles inserted after the last row.
CLOSING = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
LAWFUL = {("s", "u"), ("u", "a"), ("a", "u")}
#: A state is out if it costs more than another one by more than what that one needs to do the same.
DETOUR = {
    START: {ASSISTANT: 3, USER: 5},
    SYSTEM: {START: 0, ASSISTANT: 0, USER: 2},
    USER: {START: 2, ASSISTANT: 2},
    ASSISTANT: {START: 0, USER: 2},
}


def moves(initial: str, broken: bool) -> dict[int, list[tuple[str, int, int, str]]]:
    """For each state, in ASCII order of the letters: letters, next state, cost, and the inserted and new roles."""
    found: dict[int, list] = {}
    for state in NEXT:
        ways = [("D", state, 3, "")]
        for inserted in ("", *NEXT[state]):
            if inserted == "s":
                continue
            here = NEXT[state][inserted] if inserted else state
            for role, then in NEXT[here].items():
                letters, cost = "I" * len(inserted), 2 * len(inserted) + broken
                if role == initial and (role != "s" or not inserted):
                    ways.append((letters + "K", then, cost, inserted))
                elif role != "s":
                    ways.append((letters + "R", then, cost + 2, inserted + role))
        found[state] = sorted(ways)
    return found


MOVES = {(i, broken): moves(i, broken) for i in ("s", "u", "a", "") for broken in (False, True)}


def code(initial: str, fault: int) -> int:
    """One byte for what the search needs to know of a row."""
    return ("s", "u", "a", "").index(initial) * 4 + fault


def ways_of(row_code: int) -> dict | None:
    """Moves of a row; None if it must go."""
    fault = row_code % 4
    return None if fault in (BLANK, DUPLICATE) else MOVES[("s", "u", "a", "")[row_code // 4], fault == TRUNCATED]


def advance(survivors: list, ways: dict) -> list:
    """(state, cost, survivor, move) of the new survivors in the order of their scripts. ``survivors`` are (state, cost, any)
    in that order."""
    best: dict[int, tuple] = {}
    number = 0
    for survivor in survivors:
        for move in ways[survivor[0]]:
            cost, number = survivor[1] + move[2], number + 1
            if move[1] not in best or cost < best[move[1]][0]:
                best[move[1]] = (cost, number, survivor, move)
    return sorted(
        ((s, b[0], b[2], b[3]) for s, b in best.items() if not any(o in best and best[o][0] + d < b[0] for o, d in DETOUR[s].items())),
        key=lambda x: best[x[0]][1],
    )


def exits(codes: bytearray, entry: int) -> list[tuple[int, int]]:
    """(state, cost) of the survivors after these rows, in the order of their scripts."""
    survivors, added = [(entry, 0, None)], 0
    for c in codes:
        ways = ways_of(c)
        if ways is None:
            added += 3
        else:
            survivors = [(s, cost, None) for s, cost, _, _ in advance(survivors, ways)]
    return [(s, cost + added) for s, cost, _ in survivors]


class Node:
    """One row's edit in the tree of backpointers; ``gone`` counts the forced deletions after it."""

    __slots__ = ("parent", "children", "move", "row", "gone")

    def __init__(self, parent, move, row) -> None:
        self.parent, self.children, self.move, self.row, self.gone = parent, [], move, row, 0


class Repair:
    """The search over the rows of one conversation, or of the part that one task holds. ``give`` receives every final
    edit: letter, role and text (None for a deletion)."""

    def __init__(self, entry: int, give: Callable) -> None:
        self.root = Node(None, None, None)
        self.survivors = [(entry, 0, self.root)]
        self.give, self.added = give, 0

    def row(self, row_code: int, role: bytes, text: bytes) -> None:
        ways = ways_of(row_code)
        if ways is None:
            self.added += 3
            for _, _, leaf in self.survivors:
                if leaf is self.root:
                    self.give("D", None, None)
                else:
                    leaf.gone += 1
            return
        old, new = self.survivors, []
        for state, cost, (_, _, parent), move in advance(old, ways):
            node = Node(parent, move, (role, text) if move[0] != "D" else None)
            parent.children.append(node)
            new.append((state, cost, node))
        self.survivors = new
        for _, _, leaf in old:
            self._free(leaf)
        while len(self.root.children) == 1:
            self._settle(self.root.children[0])

    def _free(self, node: Node) -> None:
        while not node.children and node is not self.root:
            node.parent.children.remove(node)
            node = node.parent

    def _settle(self, node: Node) -> None:
        letters, _, _, roles = node.move
        for role in roles[: letters.count("I")]:
            self.give("I", ROLE[role], b"")
        if letters[-1] == "D":
            self.give("D", None, None)
        elif letters[-1] == "K":
            self.give("K", *node.row)
        else:
            self.give("R", ROLE[roles[-1]], node.row[1])
        for _ in range(node.gone):
            self.give("D", None, None)
        node.gone, node.parent, node.row, self.root = 0, None, None, node

    def close(self, state: int | None = None) -> int:
        """Give out what is left, up to ``state``, or up to the end of the conversation; the cost of these rows."""
        if state is None:
            cost, n = min((c + 2 * len(CLOSING[s]), n) for n, (s, c, _) in enumerate(self.survivors))
            state, _, leaf = self.survivors[n]
            closing = CLOSING[state]
        else:
            cost, leaf = next((c, leaf) for s, c, leaf in self.survivors if s == state)
            closing = ""
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        for node in reversed(path):
            self._settle(node)
        for role in closing:
            self.give("I", ROLE[role], b"")
        return cost + self.added


# --- rows in order ----------------------------------------------------------------------------

ROW = "conv_id long, turn long, code int, role binary, text binary"
ORDER = ["conv_id", "turn", "role", "head", "hash", "row", "copy"]


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present, copy) with their fault, sorted over all partitions and fixed there."""
    text, last = F.col("text"), F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    first = F.left("role", F.lit(1))
    # Written with their numbers: a table that is computed twice may number its rows differently.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "conversations")
    rows = rows.withColumns({"head": F.left(text, F.lit(32)), "hash": F.xxhash64("role", "text"), "hash2": F.xxhash64(F.lit(2654435769), "role", "text")})
    key = ["conv_id", "hash", "hash2"]
    place = F.struct("turn", "row", "copy")
    # Written before it is joined: a hot key can be split only where both sides come from a plain shuffle.
    twice = rows.filter("present").groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    twice = stored(twice.select(*[F.col(c).alias(f"_{c}") for c in key], "first"), "repeated-rows")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("hash") == F.col("_hash")) & (F.col("hash2") == F.col("_hash2"))
    fault = (
        F.when(last == "", BLANK)
        .when(F.col("first").isNotNull() & (place > F.col("first")), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    flagged = rows.join(twice, same, "left").withColumn("code", F.when(F.col("present"), initial * 4 + fault))
    sort = [F.col(c).asc_nulls_first() for c in ORDER]
    in_order = flagged.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return checkpointed(in_order.select("conv_id", "turn", "code", F.col("role").cast("binary"), text.cast("binary")))


def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _rims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a partition, summed up."""
    part, found, conv, codes, turn, n = TaskContext.get().partitionId(), [], None, bytearray(), None, 0

    def close() -> None:
        entries = range(4) if n == 1 else (START,)
        ways = [{"entry": e, "state": s, "cost": c} for e in entries for s, c in exits(codes, e)]
        del found[1:]
        found.append((part, n == 1, conv, ways, turn, codes[-1] // 4 if codes else None))

    for this, this_turn, row_code, _, _ in by_row(batches):
        if not n or this != conv:
            if n == 1:
                close()
            conv, codes, turn, n = this, bytearray(), None, n + 1
        if row_code is not None:
            codes.append(row_code)
            turn = this_turn if this_turn is not None else turn
    if n:
        close()
    columns = list(zip(*found)) if found else [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, RIM.types)], schema=RIM)


RIM = pa.schema(
    [
        ("part", pa.int32()),
        ("opens", pa.bool_()),
        ("conv_id", pa.int64()),
        ("ways", pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64())]))),
        ("turn", pa.int64()),
        ("initial", pa.int32()),
    ]
)
RIM_SQL = "part int, opens boolean, conv_id long, ways array<struct<entry:int,state:int,cost:long>>, turn long, initial int"


def seams(rims: list) -> tuple[dict, dict]:
    """What a partition must know of its neighbours, for conversations that span several: by partition
    ``enter`` (state, last turn and last initial before its first row) and ``leave`` (conversation and state)."""
    enter: dict[int, tuple] = {}
    leave: dict[int, tuple] = {}
    rims = sorted(rims, key=lambda r: (r.part, not r.opens))
    at = 0
    while at < len(rims):
        end = at + 1
        while end < len(rims) and rims[end].part != rims[end - 1].part and rims[end].conv_id == rims[at].conv_id:
            end += 1
        if end - at > 1:
            survivors, back = [(START, 0)], []
            for rim in rims[at:end]:
                best: dict[int, tuple] = {}
                number = 0
                for state, cost in survivors:
                    for w in rim.ways:
                        if w.entry == state:
                            number += 1
                            if w.state not in best or cost + w.cost < best[w.state][0]:
                                best[w.state] = (cost + w.cost, number, state)
                survivors = [(s, b[0]) for s, b in sorted(best.items(), key=lambda x: x[1][1])]
                back.append({s: b[2] for s, b in best.items()})
            state = min((c + 2 * len(CLOSING[s]), n, s) for n, (s, c) in enumerate(survivors))[2]
            states = [state]
            for b in reversed(back):
                state = b[state]
                states.append(state)
            states.reverse()
            turn = initial = None
            for i, rim in enumerate(rims[at:end]):
                if i:
                    enter[rim.part] = (states[i], turn, initial)
                if at + i + 1 < end:
                    leave[rim.part] = (rim.conv_id, states[i + 1])
                turn = rim.turn if rim.turn is not None else turn
                initial = rim.initial if rim.initial is not None else initial
        at = end
    return enter, leave


class Tally:
    """Counts of one conversation, or of a part of it."""

    def __init__(self, turn: int | None, initial: int | None) -> None:
        self.faults, self.illegal, self.turns, self.least, self.most = [0, 0, 0, 0], 0, 0, None, None
        self.turn, self.initial = turn, initial

    def row(self, turn: int | None, row_code: int) -> None:
        initial = row_code // 4
        self.faults[row_code % 4] += 1
        if self.initial is not None and ("sua."[self.initial], "sua."[initial]) not in LAWFUL:
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn


def repaired_parts(rows: Iterator[tuple], part: int, enter: dict, leave: dict, give: Callable) -> Iterator[tuple]:
    """Run the search over the rows of a partition. ``give(conv_id, seq)`` opens a conversation or a part of one and
    returns what takes its edits; yields (conv_id, tally, cost, spans) when that is done."""
    conv, repair, tally, n, spans = None, None, None, 0, False

    def close() -> tuple:
        stays = leave.get(part)
        cost = repair.close(stays[1] if stays is not None and stays[0] == conv else None)
        return conv, tally, cost, spans

    for this, turn, row_code, role, text in rows:
        if not n or this != conv:
            if n:
                yield close()
            state, last_turn, initial = enter.get(part, (START, None, None)) if not n else (START, None, None)
            spans = (not n and part in enter) or (part in leave and leave[part][0] == this)
            conv, n, tally = this, n + 1, Tally(last_turn, initial)
            repair = Repair(state, give(conv, spans))
        if row_code is not None:
            tally.row(turn, row_code)
            repair.row(row_code, role, text)
    if n:
        yield close()


class Conversations:
    """Conversations in order, with the states at the seams of their partitions. ``rows`` holds conv_id, turn, role and text;
    rows where ``present`` does not hold name a conversation without being part of it, and ``copy`` tells
    apart rows made from one row."""

    def __init__(self, rows: DataFrame, present: Column | None = None, copy: Column | None = None) -> None:
        space = F.lit(" ")
        plain = rows.select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long"),
            F.coalesce("role", space).alias("role"),
            F.coalesce("text", space).alias("text"),
            F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"),
            (F.lit(0) if copy is None else copy).alias("copy"),
        )
        self.rows = ordered(plain)
        self.enter, self.leave = seams(self.rows.mapInArrow(_rims, RIM_SQL).collect())

    def edits(self) -> DataFrame:
        """Every edit in order: conv_id, part and seq (the place in the script), edit (K, R, D or I), role and text
        (null where a row goes)."""
        enter, leave = self.enter, self.leave

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, out = TaskContext.get().partitionId(), []

            def give(conv, _):
                seq = iter(range(1 << 62))
                return lambda letter, role, text: out.append((conv, part, next(seq), letter, role, text))

            def batch() -> pa.RecordBatch:
                columns = list(zip(*out)) if out else [()] * 6
                types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
                done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "part", "seq", "edit", "role", "text"])
                out.clear()
                return done

            for _ in repaired_parts(by_row(batches), part, enter, leave, give):
                if len(out) > 1000:
                    yield batch()
            yield batch()

        edits = self.rows.mapInArrow(run, "conv_id long, part int, seq long, edit string, role binary, text binary")
        return edits.withColumns({"role": F.col("role").cast("string"), "text": F.col("text").cast("string")})

    def summaries(self) -> DataFrame:
        """One row per conversation: its faults, the cost of the repair, its script and the digest of what it gives.

        A digest is one pass over its text by definition: the parts of a conversation that spans partitions
        travel in pieces of bounded size and are streamed in order, never held together."""
        enter, leave = self.enter, self.leave

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            pending: list = []

            def give(conv, spans):
                sink = Sink(conv, part, spans, pending)
                pending_sink[0] = sink
                return sink.edit

            pending_sink: list = [None]
            for conv, tally, cost, spans in repaired_parts(by_row(batches), part, enter, leave, give):
                pending_sink[0].close(tally, cost)
                if len(pending) > 200:
                    yield summary_batch(pending)
            yield summary_batch(pending)

        out = stored(self.rows.mapInArrow(run, SUMMARY_SQL), "repairs")
        whole = out.filter("part IS NULL")
        pieces = out.filter("part IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
        return whole.union(pieces.mapInArrow(_joined, SUMMARY_SQL)).drop("part", "seq", "piece")


SUMMARY_SQL = "conv_id long, part int, seq long, gaps long, blank long, duplicate long, truncated long, illegal long, least long, most long, cost long, audit string, repaired_sha256 string, piece binary"
SUMMARY = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in SUMMARY_SQL.split(", ")])
#: Bytes of text and letters that one piece holds.
PIECE = 1 << 20


def summary_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(SUMMARY)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SUMMARY.types)], schema=SUMMARY)
    rows.clear()
    return batch


def gaps(least: int | None, most: int | None, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


class Sink:
    """Takes the edits of one conversation: hashes them, or cuts them into pieces if the conversation spans partitions."""

    def __init__(self, conv, part: int, spans: bool, out: list) -> None:
        self.conv, self.part, self.spans, self.out = conv, part, spans, out
        self.audit, self.text, self.sha, self.seq, self.any = [], bytearray(), hashlib.sha256(), 0, False

    def edit(self, letter: str, role: bytes | None, text: bytes | None) -> None:
        self.audit.append(letter)
        if role is not None:
            line = role + b":" + text
            if self.spans:
                self.text += b"\n" + line
            else:
                self.sha.update(b"\n" + line if self.any else line)
            self.any = True
        if self.spans and len(self.text) + len(self.audit) > PIECE:
            self._piece(Tally(None, None), 0)

    def _piece(self, tally: Tally, cost: int) -> None:
        counts = (tally.turns, *tally.faults[1:], tally.illegal, tally.least, tally.most, cost)
        self.out.append((self.conv, self.part, self.seq, *counts, "".join(self.audit), None, bytes(self.text)))
        self.audit, self.text, self.seq = [], bytearray(), self.seq + 1

    def close(self, tally: Tally, cost: int) -> None:
        if self.spans:
            self._piece(tally, cost)
        else:
            counts = (gaps(tally.least, tally.most, tally.turns), *tally.faults[1:], tally.illegal, tally.least, tally.most, cost)
            self.out.append((self.conv, None, None, *counts, "".join(self.audit), self.sha.hexdigest(), None))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> whole conversations. ``gaps`` of a piece holds its number of turns."""
    conv, state = None, None

    def row() -> tuple:
        sums, least, most, audit, sha, _ = state
        return (conv, None, None, gaps(least, most, sums[0]), *sums[1:5], least, most, sums[5], "".join(audit), sha.hexdigest(), None)

    for this, _, _, turns, blank, duplicate, truncated, illegal, least, most, cost, audit, _, piece in by_row(batches):
        if state is None or this != conv:
            if state is not None:
                yield summary_batch([row()])
            conv, state = this, [[0] * 6, None, None, [], hashlib.sha256(), False]
        state[0] = [a + b for a, b in zip(state[0], (turns, blank, duplicate, truncated, illegal, cost))]
        state[1] = least if state[1] is None else state[1]
        state[2] = most if most is not None else state[2]
        state[3].append(audit)
        if piece:
            state[4].update(piece if state[5] else piece[1:])
            state[5] = True
    if state is not None:
        yield summary_batch([row()])


# --- damage -----------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` after the damage that the crc32 of ``conv_id:turn`` draws, with ``present`` (false: dropped)
    and ``copy``."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    draw, text = F.crc32(name) % 20, F.coalesce("text", space)
    rows = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.when(draw == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (draw != 0).alias("present"),
        F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", "present", F.explode("copies").alias("copy"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Faults and repair of every conversation after the damage."""
    rows = damaged(conversations)
    return Conversations(rows, F.col("present"), F.col("copy")).summaries().select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
