"""Repair of damaged conversations by iterative-deepening A*.

Rows are sorted by conversation and turn over range partitions, so a very long
conversation lies in several tasks. Each task cuts its rows into segments. A
conversation that is one whole segment is repaired at once. The others are
repaired in three steps: the search gives every segment's least costs from each
state to each state; a backward pass over these small rows gives the least cost
of what follows a segment; then every segment is searched for its own part of
the answer, and a forward pass joins the parts. Both passes stream: they hold
one segment and one state of each conversation at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spreading import salted_join
from ..session import written

SEGMENT_ROWS = 64
SPACES = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NEVER = 1 << 40

# States of the role pattern: nothing yet, a system row, a user row, an
# assistant row last. NEXT is the role that an edit can write there.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
# Cost still to come after the last row, by state: an insert completes a pair.
END = (0, 2 * INSERT, INSERT, 0)

OPEN = "conv_id long, part int, seq int, costs array<long>, rows string"
RESULT = (
    "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
PIECES = f"{RESULT}, part int, seq int, costs array<long>, rows string"


@dataclass
class Search:
    """Iterative deepening over the edits of consecutive rows.

    ``rows`` are (initial, extra, gone): the role's initial, 1 for a truncated
    row, and whether the row must be deleted. ``goal`` is the cost that follows
    each state after the last row; trailing inserts are searched if ``last``.
    """

    rows: list[tuple[str, int, bool]]
    goal: tuple[int, ...]
    last: bool = False
    failed: dict[tuple[int, int], int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # Least cost of the rows from each place on: deletions that must be, marks of truncated rows.
        self.least = [0] * (len(self.rows) + 1)
        for i in range(len(self.rows) - 1, -1, -1):
            _, extra, gone = self.rows[i]
            self.least[i] = self.least[i + 1] + (DELETE if gone else extra)
        self.floor = min(self.goal)

    def run(self, state: int, most: int = NEVER, first: int | None = None) -> tuple[int, str, int] | None:
        """``(cost, edits, state)`` of the cheapest edits, the ASCII-least of them; None beyond ``most``."""
        bound = self.least[0] + self.floor if first is None else first
        while bound <= most:
            found = self._deepen(0, state, bound)
            if found is not None:
                return bound, found[0], found[1]
            bound += 1
        return None

    def _deepen(self, at: int, state: int, left: int) -> tuple[str, int] | None:
        """The first accepting edits within ``left``, tried in the order D, I, K, R."""
        if self.least[at] + self.floor > left or self.failed.get((at, state), -1) >= left:
            return None
        done = at == len(self.rows)
        if done and self.goal[state] <= left:
            return "", state
        steps: list[tuple[str, int, int, int]] = []
        if not done or self.last:
            steps.append(("I", at, NEXT[state], INSERT))
        if not done:
            initial, extra, gone = self.rows[at]
            steps.insert(0, ("D", at + 1, state, DELETE))
            if not gone:
                if (state, initial) in KEPT:
                    steps.append(("K", at + 1, KEPT[state, initial], KEEP + extra))
                steps.append(("R", at + 1, NEXT[state], REROLE + extra))
        for edit, then, reached, cost in steps:
            found = self._deepen(then, reached, left - cost)
            if found is not None:
                return edit + found[0], found[1]
        self.failed[at, state] = left
        return None


def cost_table(rows: list[tuple[str, int, bool]]) -> list[int]:
    """Least cost from each state before the rows to each state after them, row by row of the table."""
    system = any(initial == "s" and not gone for initial, _, gone in rows)
    table = [NEVER] * 16
    for goal in range(4):
        search = Search(rows, tuple(0 if s == goal else NEVER for s in range(4)))
        # Nothing leads back to the start, and only a kept system row to its state.
        for state in range(4) if goal > SYSTEM else (START,) if goal == START else (START, SYSTEM)[not system :]:
            table[4 * state + goal] = search.run(state)[0]
    return table


def repaired(audit: str, rows: list[list], state: int) -> Iterator[str]:
    """``role:text`` of the rows after the edits."""
    source = iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield f"{NAMES[state]}:"
            continue
        role, text = next(source)[:2]
        if edit == "K":
            state = KEPT[state, role[:1]]
            yield f"{role}:{text}"
        elif edit == "R":
            state = NEXT[state]
            yield f"{NAMES[state]}:{text}"


def _searched(rows: list[list]) -> list[tuple[str, int, bool]]:
    return [(role[:1], int(fault == "truncated"), fault in ("blank", "duplicate")) for role, _, fault in rows]


def _digest(lines: Iterator[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after damage drawn from the crc32 of ``conv_id:turn``.

    Of twenty values 0 drops a row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it and 4 makes its role user. A null of any column counts as one
    space, but stays null in conv_id and turn.
    """

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(draw == 4, "user").otherwise(filled("role"))
    copies = F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = conversations.where(draw != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        copies.alias("copy"),
    )
    return rows.drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """The rows with their key, and ``fault``: blank, duplicate of an earlier turn, truncated, or empty.

    Equal rows of one turn stand side by side in the sorted conversation; there
    the first one is no duplicate, which only the sorted pass can tell.
    """
    named = F.concat_ws(":", F.length("role").cast("string"), "role", "text")
    keyed = rows.withColumn("mark", F.md5(named.cast("binary")))
    turn = F.struct("turn")  # orders a null before any number
    seen = keyed.groupBy("conv_id", "mark").agg(F.min(turn).alias("first"), F.max(turn).alias("final"))
    again = seen.where("not (first <=> final)").select(
        F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none"), "mark", "first"
    )
    both = keyed.withColumn("c", F.coalesce("conv_id", F.lit(0))).withColumn("none", F.col("conv_id").isNull())
    joined = salted_join(both, again, ["c", "none", "mark"], ["turn"], "left", salts=8)
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(turn)
    final = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    fault = F.when(final == "", "blank").when(later, "duplicate").when(~final.isin(".", "!", "?"), "truncated")
    return joined.select("conv_id", "turn", "role", "text", "mark", F.coalesce(fault, F.lit("")).alias("fault"))


def _segments(segment_rows: int):
    """Task function: sorted rows to repaired conversations and open segments."""
    schema = pa.schema(
        [("conv_id", pa.int64())]
        + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
        + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("seq", pa.int32())]
        + [("costs", pa.list_(pa.int64())), ("rows", pa.string())]
    )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bool, list[list]]]:
        """(conversation, number of the segment, whether it is the conversation's last here, its rows)."""
        for conv, rows in groupby(rows_of(batches), lambda r: r[0]):
            held, number, before = [], 0, None
            for _, turn, role, text, fault in rows:
                if (turn, role, text) == before and fault != "blank":
                    fault = "duplicate"
                before = (turn, role, text)
                if len(held) == segment_rows:
                    yield conv, number, False, held
                    held, number = [], number + 1
                held.append([role, text, fault])
            yield conv, number, True, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        pieces = cut(batches)
        piece, first = next(pieces, None), True
        while piece is not None:
            conv, number, final, rows = piece
            piece = next(pieces, None)
            # The first and last conversation of a task may go on in another one.
            whole = number == 0 and final and not first and piece is not None
            if final:
                first = False
            counts = {k: sum(r[2] == k for r in rows) for k in ("blank", "duplicate", "truncated")}
            initials = [r[0][:1] for r in rows]
            row = {"conv_id": conv, **counts, "illegal": illegal_pairs(initials), "part": part, "seq": number}
            if whole:
                row["cost"], row["audit"], _ = Search(_searched(rows), END_GOAL, last=True).run(START)
                row["repaired_sha256"] = _digest(repaired(row["audit"], rows, START))
            else:
                row["costs"], row["rows"] = cost_table(_searched(rows)), json.dumps(rows)
            out.append(row)
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


END_GOAL = (0, NEVER, NEVER, 0)


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the last to the first: least cost of all that follows each, by state."""
    conv, togo = object(), END
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            final = row["conv_id"] != conv
            if final:
                conv, togo = row["conv_id"], END
            out.append({**{k: row[k] for k in ("conv_id", "part", "seq")}, "togo": list(togo), "final": final})
            costs = row["costs"]
            togo = tuple(min(costs[4 * s + e] + togo[e] for e in range(4)) for s in range(4))
        yield pa.RecordBatch.from_pylist(
            out,
            pa.schema(
                [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32())]
                + [("togo", pa.list_(pa.int64())), ("final", pa.bool_())]
            ),
        )


def _searched_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every segment's own edits from each state before it, given the costs that follow."""
    kind = pa.list_(pa.struct([("edits", pa.string()), ("state", pa.int32())]))
    for batch in batches:
        choices = []
        for text, costs, togo, final in zip(
            *(batch.column(n).to_pylist() for n in ("rows", "costs", "togo", "final"))
        ):
            rows, found = _searched(json.loads(text)), []
            goal = END_GOAL if final else tuple(togo)
            for state in range(4):
                least = min(costs[4 * state + e] + togo[e] for e in range(4))
                _, edits, reached = Search(rows, goal, last=final).run(state, least, first=least)
                found.append({"edits": edits, "state": reached})
            choices.append(found)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("conv_id", "part", "seq", "rows", "costs", "togo")), pa.array(choices, kind)]
            + [batch.column(n) for n in ("blank", "duplicate", "truncated", "illegal")],
            names=["conv_id", "part", "seq", "rows", "costs", "togo", "choices", "blank", "duplicate", "truncated", "illegal"],
        )


SEARCHED = (
    "conv_id long, part int, seq int, rows string, costs array<long>, togo array<long>, "
    "choices array<struct<edits: string, state: int>>, blank long, duplicate long, truncated long, illegal long"
)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order: the edits of each from the state that the one before it ends in."""
    names = ("blank", "duplicate", "truncated", "illegal")
    schema = pa.schema(
        [("conv_id", pa.int64())] + [(n, pa.int64()) for n in (*names, "cost")]
        + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def segments() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    for conv, parts in groupby(segments(), lambda r: r["conv_id"]):
        state, audit, digest, some, role = START, [], hashlib.sha256(), False, None
        total = dict.fromkeys(names, 0)
        cost = None
        for part in parts:
            rows = json.loads(part["rows"])
            if cost is None:
                cost = min(part["costs"][4 * START + e] + part["togo"][e] for e in range(4))
            chosen = part["choices"][state]
            for line in repaired(chosen["edits"], rows, state):
                digest.update((b"\n" if some else b"") + line.encode("utf-8", "surrogatepass"))
                some = True
            audit.append(chosen["edits"])
            state = chosen["state"]
            for name in names:
                total[name] += part[name]
            if role is not None:
                total["illegal"] += illegal_pairs([role, rows[0][0][:1]])
            role = rows[-1][0][:1]
        row = {"conv_id": conv, **total, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        yield pa.RecordBatch.from_pylist([row], schema)


def repair(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``: one row for each conv_id.

    ``conversations`` is (conv_id, turn, role, text) after damage; conversations
    without rows are not in it. Rows go by turn, nulls first, and within a turn
    by role and a digest of the row. The edits turn the roles into
    ``(s?(ua)+)?`` at the least cost; of equal costs the ASCII-least edits are
    taken. Rows without conv_id are one conversation. Other columns take no
    part, and an empty table gives an empty result.
    """
    by_turn = conversations.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    gap = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = by_turn.groupBy("conv_id").agg(F.coalesce(gap, F.lit(0)).alias("gaps"))

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "mark"]
    rows = faults(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = written(
        rows.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_segments(segment_rows), PIECES), "segments"
    )
    whole = pieces.where("costs IS NULL").select("conv_id", *[c.split()[0] for c in RESULT.split(", ")[1:]])
    pending = pieces.where("costs IS NOT NULL")
    place = ["conv_id", "part", "seq"]
    backward = [F.col("conv_id"), F.col("part").desc(), F.col("seq").desc()]
    togo = (
        pending.select(*place, "costs")
        .repartition("conv_id")
        .sortWithinPartitions(*backward)
        .mapInArrow(_backward, "conv_id long, part int, seq int, togo array<long>, final boolean")
    )
    at = togo.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("q"), "togo", "final")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q"))
    found = pending.join(at, same).select(
        *place, "rows", "costs", "togo", "final", "blank", "duplicate", "truncated", "illegal"
    )
    searched = written(found.mapInArrow(_searched_segments, SEARCHED), "searched-segments")
    joined = searched.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_forward, RESULT)
    c = gaps.withColumnRenamed("conv_id", "c")
    every = whole.unionByName(joined)
    return every.join(c, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conv_id of the table.

    A conversation that loses all rows has zeros, no edits and the digest of
    the empty string.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    rows = repair(damaged(conversations))
    both = ids.join(rows, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"),
    )
