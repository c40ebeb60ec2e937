"""Damage and repair of conversations: the cheapest edits that make the roles alternate, and of these the first audit in ASCII order.

An edit path is one number. Its high digits are the cost; below them every row has a slot of fixed width for the letters of
its edits (at most one Insert, then Keep, Rerole or Delete), left-aligned and padded with zeros, first row first. No letters
of a slot begin another slot's letters, so numbers compare as (cost, audit) does, and a shortest path over the states of
`(s?(ua)+)?` by ordinary minimum decides cost, edits and ties at once.

Rows are put in order by ranges of (conversation, turn, role, text), so a conversation of any length lies in pieces. A piece
is reduced to the best number between each two states; the pieces of a conversation are chained, where what came before a
piece counts as its rank among the states, which keeps every comparison. A text is hashed piece by piece.

Defined results: in damage keys, roles and texts a null counts as one space; rows without a turn come first. Rows of one turn
go by role, then text, in the order of their code points. Rows that repeat come one after the other, so all but the first are
duplicates. A null conv_id is a conversation like any other. An empty role has no initial: it can be reroled or deleted, and its pairs are
illegal. Whole texts are read. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.common import stored

# The faults that damage deals, by number, of FAULTS; costs of the edits; white space; ends of a whole sentence.
FAULTS, DROPPED, EMPTIED, UNPOINTED, REPEATED, AS_USER = 20, 0, 1, 2, 3, 4
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
ROLES = {"u": "user", "a": "assistant"}

#: States of the roles so far: none, one system, ends on a user, ends on an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Letters of a slot are three bits each, in ASCII order; a slot is one byte.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
NAMES = {code: letter for letter, code in LETTERS.items()}
BLOCK, PREFIX = 64, 64

#: Kinds of a row: must go, or the role's initial and whether its text is cut off.
GONE = 0
KINDS = {(initial, cut): 1 + 2 * k + cut for k, initial in enumerate(("s", "u", "a", "")) for cut in (False, True)}


def slot(letters: str) -> int:
    first, second = (*[LETTERS[x] for x in letters], 0, 0)[:2]
    return first << 3 | second


def _next_insert(state: int) -> tuple[str, int]:
    role = "a" if state == USER else "u"
    return role, STEP[state, role]


def _row_edges(initial: str | None, cut: bool) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, slot) of the edits of one row; `initial` None: the row must be deleted."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in STATES:
        for lead, here, paid in (("", state, 0), ("I", _next_insert(state)[1], INSERT_COST)):
            ways = [("D", here, DELETE_COST)]
            if initial is not None:
                ways += [("R", _next_insert(here)[1], REROLE_COST + TRUNCATED_COST * cut)]
                ways += [("K", STEP[here, initial], TRUNCATED_COST * cut)] if (here, initial) in STEP else []
            for letter, to, cost in ways:
                found = (paid + cost, slot(lead + letter))
                best[state, to] = min(best.get((state, to), found), found)
    return [(a, b, cost, code) for (a, b), (cost, code) in best.items()]


EDGES = {GONE: _row_edges(None, False)} | {kind: _row_edges(initial, cut) for (initial, cut), kind in KINDS.items()}
TAIL = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT_COST, "I"), SYSTEM: (2 * INSERT_COST, "II")}

Matrix = list[list[int | None]]


def _block(kinds: bytes) -> Matrix:
    """Least number from each state to each, over a few rows."""
    out = []
    for start in STATES:
        now: list[int | None] = [0 if s == start else None for s in STATES]
        bits = 0
        for kind in kinds:
            bits += 8
            then: list[int | None] = [None] * len(STATES)
            for a, b, cost, code in EDGES[kind]:
                if now[a] is not None:
                    weight = (now[a] << 8) + (cost << bits) + code
                    if then[b] is None or weight < then[b]:
                        then[b] = weight
            now = then
        out.append(now)
    return out


def _joined(x: Matrix, x_slots: int, y: Matrix, y_slots: int) -> Matrix:
    """Matrix of two stretches of rows, one after the other."""
    low, bits = (1 << 8 * y_slots) - 1, 8 * (x_slots + y_slots)
    parts = [[None if w is None else ((w >> 8 * y_slots) << bits) + (w & low) for w in row] for row in y]
    out: Matrix = []
    for row in x:
        moved = [None if w is None else w << 8 * y_slots for w in row]
        out.append([min((moved[s] + parts[s][t] for s in STATES if moved[s] is not None and parts[s][t] is not None), default=None) for t in STATES])
    return out


def matrix(kinds: bytes) -> Matrix:
    """Least number from each state to each over all rows: blocks, joined in pairs up a tree."""
    parts = [(_block(kinds[k : k + BLOCK]), len(kinds[k : k + BLOCK])) for k in range(0, max(len(kinds), 1), BLOCK)]
    while len(parts) > 1:
        pairs = [(_joined(*parts[k], *parts[k + 1]), parts[k][1] + parts[k + 1][1]) for k in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0][0]


@dataclass
class Stretch:
    """Consecutive rows of one conversation after damage."""

    kinds: bytearray = field(default_factory=bytearray)
    rows: list[tuple[str, str]] = field(default_factory=list)
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_initial: str | None = None
    last_initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        """`n` equal rows; `seen`: role and text came before."""
        if n and turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn, self.turns = turn if self.turns == 0 else self.first_turn, turn, self.turns + 1
        bare = text.rstrip(BLANKS)
        cut = bool(bare) and bare[-1] not in ENDS
        for _ in range(n):
            initial = role[:1]
            self.illegal += self.last_initial is not None and not legal(self.last_initial, initial)
            self.first_initial = initial if self.first_initial is None else self.first_initial
            self.last_initial = initial
            if not bare or seen:
                self.blank, self.duplicate = self.blank + (not bare), self.duplicate + bool(bare)
                self.kinds.append(GONE)
            else:
                self.truncated += cut
                self.kinds.append(KINDS[initial if initial in "sua" else "", cut])
            self.rows.append((role, text))
            seen = True

    def follow(self, other: Stretch) -> None:
        """Take in the counts of the stretch that comes next."""
        if other.first_initial is not None:
            self.illegal += self.last_initial is not None and not legal(self.last_initial, other.first_initial)
            self.first_initial = other.first_initial if self.first_initial is None else self.first_initial
            self.last_initial = other.last_initial
        if other.turns:
            self.turns += other.turns - (self.last_turn == other.first_turn)
            self.first_turn, self.last_turn = other.first_turn if self.first_turn is None else self.first_turn, other.last_turn
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


def legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def apply_edits(codes: bytes, state: int, rows: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """Audit letters and repaired lines of rows (and of the end, if there is one slot more than rows)."""
    audit, lines = [], []
    for k, code in enumerate(codes):
        for letter in (NAMES.get(code >> 3), NAMES.get(code & 7)):
            if letter is None:
                continue
            audit.append(letter)
            role, text = rows[k] if letter != "I" else ("", "")
            if letter in "IR":
                initial, state = _next_insert(state)
                role = ROLES[initial]
            elif letter == "K":
                state = STEP[state, role[:1]]
            if letter != "D":
                lines.append(f"{role}:{text}")
    return "".join(audit), lines


def finish(reached: list[int | None], slots: int) -> tuple[int, bytes]:
    """Cost and slots, the end's included, of the best of the states reached."""
    ends = [(w << 8) + (TAIL[s][0] << 8 * (slots + 1)) + slot(TAIL[s][1]) for s, w in enumerate(reached) if w is not None]
    best, bits = min(ends), 8 * (slots + 1)
    return best >> bits, (best & ((1 << bits) - 1)).to_bytes(slots + 1, "big")


RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
COUNTED = ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial")
COUNTED_SQL = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"


def damaged(convs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text and n, the number of equal rows that damage leaves; rows that it drops stay with n = 0."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"),
                        (F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % FAULTS).alias("fault"))
    emptied = F.col("fault").isin(DROPPED, EMPTIED)
    cleaned = F.when(emptied, "").when(F.col("fault") == UNPOINTED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    n = F.when(F.col("fault") == DROPPED, 0).when(F.col("fault") == REPEATED, 2).otherwise(1).cast("long")
    return rows.select("conv", "turn", F.when(F.col("fault") == AS_USER, ROLES["u"]).otherwise(F.col("role")).alias("role"), cleaned.alias("text"), n.alias("n"))


ROW = ["conv", "turn", "role", "text", "n"]


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch become one, so that a row that a third of the table repeats does not stay a third of it."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch]).group_by(ROW[:-1], use_threads=False).aggregate([("n", "sum")])
            yield from rows.rename_columns(ROW).combine_chunks().to_batches()


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, with `pos` (ascending in a piece) and `piece`; stored, as ranges come from a sample."""
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    merged = rows.mapInArrow(_merged, schema)
    turn = F.col("turn").asc_nulls_first()
    ranged = merged.repartitionByRange("conv", turn, "role", F.substring("text", 1, PREFIX)).sortWithinPartitions("conv", turn, "role", "text")
    return stored(ranged.withColumn("pos", F.monotonically_increasing_id())).withColumn("piece", F.shiftright("pos", 33))


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Stretch]]:
    """Each whole conversation of rows that come in order."""
    held, conv, made, seen = False, None, Stretch(), set()
    for batch in batches:
        for key, turn, role, text, n in zip(*(batch.column(c).to_pylist() for c in ROW), strict=True):
            if not held or key != conv:
                if held:
                    yield conv, made
                held, conv, made, seen = True, key, Stretch(), set()
            made.add(turn, role, text, n, (role, text) in seen)
            if n:
                seen.add((role, text))
    if held:
        yield conv, made


def _result_rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *RESULT_TYPES], strict=True)], ["conv", *RESULTS])


def _repair_whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, out = None, []

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv").type
            yield batch

    for conv, made in _stretches(typed()):
        cost, codes = finish(matrix(bytes(made.kinds))[START], len(made.kinds))
        audit, lines = apply_edits(codes, START, made.rows)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, made.gaps(), made.blank, made.duplicate, made.truncated, made.illegal, cost, audit, sha))
        if len(out) == 1000:
            yield _result_rows(out, kind)
            out = []
    if out:
        yield _result_rows(out, kind)


def _piece(rows: pa.Table) -> Stretch:
    """One piece of a conversation; `seen` says whether an earlier piece has the row's role and text."""
    made, own = Stretch(), set()
    rows = rows.sort_by("pos")
    for turn, role, text, n, seen in zip(*(rows.column(c).to_pylist() for c in (*ROW[1:], "seen")), strict=True):
        made.add(turn, role, text, n, seen or (role, text) in own)
        if n:
            own.add((role, text))
    return made


def _summary(rows: pa.Table) -> pa.Table:
    made = _piece(rows)
    weights = [b"" if w is None else w.to_bytes(len(made.kinds) + 9, "big") for row in matrix(bytes(made.kinds)) for w in row]
    counted = {c: pa.array([getattr(made, c)], pa.string() if c.endswith("initial") else pa.int64()) for c in COUNTED}
    return pa.table({"conv": rows.column("conv")[:1], "piece": rows.column("piece")[:1], "slots": pa.array([len(made.kinds)], pa.int64()),
                     "weights": pa.array([weights], pa.list_(pa.binary()))} | counted)


CHOICE = ["conv", "piece", "state", "end", "last", *RESULTS[:6]]


def _choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece of a conversation the state it starts and ends in; the last one also has the sums of the conversation.

    A piece at a time is held, and of the earlier ones only where each state came from.
    """
    conv, held, pieces, origins = None, False, [], []
    costs, ranks, sums = [0, None, None, None], [0] * 4, Stretch()

    def done(kind: pa.DataType) -> pa.RecordBatch:
        paid = min(((cost + TAIL[s][0], ranks[s], s) for s, cost in enumerate(costs) if cost is not None))
        end, out = paid[2], []
        for k in range(len(pieces) - 1, -1, -1):
            state, last = origins[k][end], k == len(pieces) - 1
            totals = (sums.gaps(), sums.blank, sums.duplicate, sums.truncated, sums.illegal, paid[0]) if last else (0,) * 6
            out.append((conv, pieces[k], state, end, last, *totals))
            end = state
        types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *RESULT_TYPES[:6]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], CHOICE)

    for batch in batches:
        kind = batch.schema.field("conv").type
        for row in batch.to_pylist():
            if not held or row["conv"] != conv:
                if held:
                    yield done(kind)
                conv, held, pieces, origins = row["conv"], True, [], []
                costs, ranks, sums = [0, None, None, None], [0] * 4, Stretch()
            sums.follow(Stretch(**{c: row[c] for c in COUNTED}))
            bits, weights = 8 * row["slots"], [int.from_bytes(w, "big") if w else None for w in row["weights"]]
            reached: list[tuple[int, int, int] | None] = [None] * 4
            for s in STATES:
                for t in STATES:
                    weight = weights[4 * s + t]
                    if costs[s] is not None and weight is not None:
                        # the cost, then the rank of what came before, then the slots of this piece
                        found = (costs[s] + (weight >> bits), ranks[s] << bits | weight & ((1 << bits) - 1), s)
                        reached[t] = found if reached[t] is None else min(reached[t], found)
            order = sorted({r[1] for r in reached if r is not None})
            costs = [None if r is None else r[0] for r in reached]
            ranks = [0 if r is None else order.index(r[1]) for r in reached]
            pieces.append(row["piece"])
            origins.append([None if r is None else r[2] for r in reached])
    if held:
        yield done(kind)


def _edit_piece(rows: pa.Table, choice: pa.Table) -> pa.Table:
    made, chosen = _piece(rows), choice.to_pylist()[0]
    slots = len(made.kinds)
    weight = matrix(bytes(made.kinds))[chosen["state"]][chosen["end"]]
    codes = (weight & ((1 << 8 * slots) - 1)).to_bytes(slots, "big")
    if chosen["last"]:
        codes += bytes([slot(TAIL[chosen["end"]][1])])
    audit, lines = apply_edits(codes, chosen["state"], made.rows)
    more = {"audit": [audit], "lines": pa.array([len(lines)], pa.int64()), "text": pa.array(["\n".join(lines).encode()], pa.binary())}
    return pa.table({c: choice.column(c) for c in CHOICE} | more)


def _hash_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations of pieces that come in order; texts are hashed as they come, only audit letters are held."""
    audit, sha, empty = [], hashlib.sha256(), True
    for batch in batches:
        for row in batch.to_pylist():
            audit.append(row["audit"])
            if row["lines"]:
                sha.update((b"" if empty else b"\n") + row["text"])
                empty = False
            if row["last"]:
                found = (row["conv"], *[row[c] for c in RESULTS[:6]], "".join(audit), sha.hexdigest())
                yield _result_rows([found], batch.schema.field("conv").type)
                audit, sha, empty = [], hashlib.sha256(), True


def repair(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of `convs`, damaged first: conv_id and the columns of RESULTS."""
    kind = convs.select(conv).schema[0].dataType.simpleString()
    result = f"conv {kind}, " + ", ".join(f"{c} long" for c in RESULTS[:6]) + ", audit string, repaired_sha256 string"
    rows = _ordered(damaged(convs, conv, turn, role, text))
    ends = rows.groupBy("conv").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a < b")
    split = F.broadcast(ends.select(F.col("conv").alias("split_conv"), F.lit(True).alias("split")))  # fewer than there are pieces
    marked = rows.join(split, F.col("conv").eqNullSafe(F.col("split_conv")), "left").drop("split_conv")
    whole = marked.where("split is null").select(*ROW).mapInArrow(_repair_whole, result)

    same = F.struct("conv", "role", F.sha2("text", 256).alias("text"))
    parts = marked.where("split").drop("split").withColumn("same", same)
    found = parts.where("n > 0").select("same", "piece").distinct().withColumn("first", F.min("piece").over(Window.partitionBy("same")))
    later = found.where("piece > first").select("same", "piece", F.lit(True).alias("seen"))
    flagged = stored(parts.join(later, ["same", "piece"], "left").drop("same").withColumn("seen", F.coalesce("seen", F.lit(False))))
    pieces = flagged.groupBy("conv", "piece").applyInArrow(_summary, f"conv {kind}, piece long, slots long, weights array<binary>, {COUNTED_SQL}")
    chained = pieces.repartition("conv").sortWithinPartitions("conv", "piece")
    choice_schema = f"conv {kind}, piece long, state long, end long, last boolean, " + ", ".join(f"{c} long" for c in RESULTS[:6])
    choices = chained.mapInArrow(_choose, choice_schema)
    edited = flagged.groupBy("conv", "piece").cogroup(choices.groupBy("conv", "piece")).applyInArrow(_edit_piece, choice_schema + ", audit string, lines long, text binary")
    joined = edited.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_hash_pieces, result)
    return whole.unionByName(joined).withColumnRenamed("conv", "conv_id")
