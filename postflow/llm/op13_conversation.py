"""Conversation structure repair: run-length dynamic programming.

Each row of a conversation is a symbol: it must be deleted (blank, or a duplicate of
an earlier row), or has a role (system, user, assistant, another) and may be cut off
(truncated). The cheapest edits that leave the roles `(s?(ua)+)?` are a shortest
path over four states (nothing yet, after s, after u, after a). Equal consecutive
symbols are one run; a run of n rows advances the costs to go by the n-th min-plus
power of its symbol's transition, put together from cached binary powers. The
audit then unrolls the choices from the front: in each state the ASCII-least letter
among those on a cheapest path (no letter leads to two rows, so that is the least
audit of all). Insertions cost and nothing is free but to keep a row, so it ends.

Rows are dealt by ranges of (conversation, turn), so a conversation of any size
spreads over tasks. A conversation within one range is repaired where it lies; of
those that ranges cut (two a range at most) each range sends its rows and the one
transition of all of them; these are multiplied from the end to the costs to go of
each range, and one ordered pass then unrolls range after range, holding one at a
time (the hash over a repaired conversation is one stream by nature).

A duplicate is told by the first turn of its role and text (by SHA-256), found by an
aggregate combined before its shuffle; rows meet only those that have several turns,
dealt over SALTS.

Defined results. Null role or text: one space; null conv_id: a conversation of its
own; null turns come first. Rows of one turn are ordered by role, then by the text's
SHA-256; repeated rows are duplicates. A role counts by its first character (none:
another). No rows after damage: zeros, an empty audit, the hash of an empty string.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from postflow.llm.common import materialize

SALTS = 16
SPACES = " \t\n\x0b\x0c\r"
OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

# Costs of the edits, the states, and the roles that lead on from each.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
BY_ROLE = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # by a user or assistant row, whichever fits
NEXT_ROLE = ("user", "user", "assistant", "user")
ACCEPTING = (START, AFTER_A)
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
DELETED = "x"  # the symbol of a row that must go; others are an initial and, if cut off, "!"

Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(min(x + b[k][j] for k, x in enumerate(row)), NEVER) for j in range(4)) for row in a)


def _advance(m: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    a, b, c, d = v
    return tuple(min(r[0] + a, r[1] + b, r[2] + c, r[3] + d, NEVER) for r in m)


def _identity() -> Matrix:
    return tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))


def _insertions() -> Matrix:
    """Any number of inserted rows."""
    once = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else NEVER for j in range(4)) for i in range(4))
    return _times(once, _times(once, once))  # more than two lead back to a state passed


INSERTIONS = _insertions()
END = _advance(INSERTIONS, tuple(0 if q in ACCEPTING else NEVER for q in range(4)))
_powers: dict[str, list[Matrix]] = {}


def transition(symbol: str) -> Matrix:
    """Costs of insertions and then one edit of a row, from state to state."""
    rows = [[NEVER] * 4 for _ in range(4)]
    for q in range(4):
        rows[q][q] = DELETE
        if symbol != DELETED:
            extra = CUT_OFF if symbol[1:] else 0
            rows[q][NEXT[q]] = min(rows[q][NEXT[q]], REROLE + extra)
            kept = BY_ROLE[q].get(symbol[0])
            if kept is not None:
                rows[q][kept] = min(rows[q][kept], extra)
    return _times(INSERTIONS, tuple(map(tuple, rows)))


def powers(symbol: str, n: int) -> Iterator[Matrix]:
    """The cached powers 2**k of a symbol's transition that make up its n-th power."""
    have = _powers.setdefault(symbol, [transition(symbol)])
    k = 0
    while n:
        if len(have) == k:
            have.append(_times(have[-1], have[-1]))
        if n & 1:
            yield have[k]
        n >>= 1
        k += 1


def symbols(rows: list[tuple]) -> list[list]:
    """Runs [symbol, rows] of rows (turn, role, text, digest, copies, later, fault)."""
    runs: list[list] = []

    def put(symbol: str, n: int) -> None:
        if runs and runs[-1][0] == symbol:
            runs[-1][1] += n
        else:
            runs.append([symbol, n])

    for _, role, _, _, copies, later, fault in rows:
        if fault == "blank" or later:
            put(DELETED, copies)
        else:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            put(initial + ("!" if fault == "truncated" else ""), 1)
            if copies > 1:
                put(DELETED, copies - 1)
    return runs


def whole_transition(runs: list[list]) -> Matrix:
    m = _identity()
    for symbol, n in runs:
        for p in powers(symbol, n):
            m = _times(m, p)
    return m


class Repair:
    """One conversation, fed range by range in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.initial: str | None = None
        self.state, self.cost = START, None
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def _count(self, rows: list[tuple]) -> None:
        c = self.counts
        for turn, role, _, _, copies, later, fault in rows:
            if fault == "blank":
                c["blank"] += copies
            else:
                c["duplicate"] += copies - (not later)
                c["truncated"] += fault == "truncated" and not later
            if turn is not None and turn != self.last_turn:  # turns come in order
                self.turns += 1
                self.first_turn = turn if self.first_turn is None else self.first_turn
                self.last_turn = turn
            own = role[:1]
            c["illegal"] += (self.initial is not None and self.initial + own not in LEGAL) + copies - 1
            self.initial = own

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _insert(self) -> None:
        self.audit.append("I")
        self._line(NEXT_ROLE[self.state], "")
        self.state = NEXT[self.state]

    def feed(self, rows: list[tuple], end: tuple[int, ...] = END) -> None:
        """The next rows; `end` is the cost to go, from each state, after them."""
        self._count(rows)
        runs = symbols(rows)
        after = [end]
        for symbol, n in reversed(runs):
            v = after[-1]
            for p in powers(symbol, n):
                v = _advance(p, v)
            after.append(v)
        if self.cost is None:
            self.cost = after[-1][self.state]
        kept = ((role, text) for _, role, text, _, _, later, fault in rows if fault != "blank" and not later)
        for i, (symbol, n) in enumerate(runs):
            steps = [after[len(runs) - 1 - i]]
            for _ in range(n):
                steps.append(_advance(powers(symbol, 1).__next__(), steps[-1]))
            for k in range(n, 0, -1):
                self._edit(symbol, steps[k], steps[k - 1], kept)

    def _edit(self, symbol: str, here: tuple[int, ...], after: tuple[int, ...], kept: Iterator) -> None:
        """The edit of one row, and insertions before it."""
        role, text = (None, None) if symbol == DELETED else next(kept)
        extra = CUT_OFF if symbol[1:] else 0
        while True:
            q = self.state
            if DELETE + after[q] == here[q]:
                self.audit.append("D")
                return
            if INSERT + here[NEXT[q]] == here[q]:
                self._insert()
                continue
            to = BY_ROLE[q].get(symbol[0])
            if to is not None and extra + after[to] == here[q]:
                self.audit.append("K")
                self._line(role, text)
                self.state = to
            else:
                self.audit.append("R")
                self._line(NEXT_ROLE[q], text)
                self.state = NEXT[q]
            return

    def result(self) -> tuple:
        while self.state not in ACCEPTING:
            self._insert()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        c = self.counts
        return (gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost or 0,
                "".join(self.audit), self.hash.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the test damage: conv_id, turn, role, text, copies (0: dropped)."""
    space = F.lit(" ")
    key = F.concat(*(F.coalesce(x, space) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id", F.when(F.col("kind") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """rows with digest, fault (blank, truncated or null) and later (the same role and
    text stand in an earlier turn)."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault: Column = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "fault": fault})
    turn = F.struct(F.col("turn").isNotNull(), "turn")  # nulls first
    first = F.min(turn)
    several = (rows.filter("copies > 0 and (fault is null or fault <> 'blank')")
               .groupBy("conv_id", "role", "digest").agg(first.alias("first"), F.max(turn).alias("last"))
               .filter("first <> last")
               .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first",
                       F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")))
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")
    same = (F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
            & (salt == F.col("s")))
    return rows.join(several.hint("shuffle_hash"), same, "left").withColumn(
        "later", F.coalesce(turn > F.col("first"), F.lit(False))).drop("c", "r", "d", "s", "first")


ROW = ["turn", "role", "text", "digest", "copies", "later", "fault"]


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each key in turn; equal neighbours are one row of more copies."""
    key, rows = None, []
    for b in batches:
        for k, r in zip(zip(*(b.column(c).to_pylist() for c in by), strict=True),
                        zip(*(b.column(c).to_pylist() for c in ROW), strict=True), strict=True):
            if k != key:
                if key is not None:
                    yield key, rows
                key, rows = k, []
            if r[4] == 0:
                continue
            if rows and rows[-1][:2] == r[:2] and rows[-1][3] == r[3]:
                r = (*r[:4], r[4] + rows.pop()[4], *r[5:])
            rows.append(r)
    if key is not None:
        yield key, rows


def _arrow(columns: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(columns))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _result_row(conv, repair: Repair) -> dict:
    return {"conv_id": conv, **dict(zip([*OUT, "audit", "repaired_sha256"], repair.result(), strict=True))}


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, the counts of faults, cost, audit and repaired_sha256 of every
    conversation of rows (conv_id, turn, role, text, copies)."""
    conf = rows.sparkSession.conf
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    order = ["conv_id", "turn", "role", "digest"]
    result = (f"conv_id {kind['conv_id']}, " + ", ".join(f"{c} bigint" for c in OUT) + ", audit string, repaired_sha256 string")
    piece = (f"seg int, pos bigint, turn {kind['turn']}, role string, text string, digest binary, copies bigint, "
             "later boolean, fault string, costs array<bigint>")
    marks = _arrow(f"{result}, {piece}")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        out, size, held, n = [], 0, None, 0

        def cut(conv, own: list[tuple], seg: int) -> Iterator[dict]:
            costs = [x for r in whole_transition(symbols(own)) for x in r]
            own = own or [(None, "", "", b"", 0, False, None)]
            for i, r in enumerate(own):
                yield {"conv_id": conv, "seg": seg, "pos": i, **dict(zip(ROW, r, strict=True)),
                       "costs": costs if i == 0 else None}

        for (conv,), own in _grouped(batches, ["conv_id"]):
            if held is not None:  # neither the first nor, now, the last of the range
                if n == 1:
                    out += cut(*held, 2 * here)
                else:
                    r = Repair()
                    r.feed(held[1])
                    out.append(_result_row(held[0], r))
            held, n = (conv, own), n + 1
            size += len(own) + 1
            if size > 2000:
                yield _batch(out, marks)
                out, size = [], 0
        if held is not None:
            out += cut(*held, 2 * here + (n > 1))
        yield _batch(out, marks)

    width = int(conf.get("spark.sql.shuffle.partitions"))
    ranged = (_faults(rows).withColumn("copies", F.col("copies").cast("long"))
              .repartitionByRange(width, *order).sortWithinPartitions(*order))
    done = materialize(ranged.mapInArrow(first_pass, f"{result}, {piece}"), "conversations")
    columns = ["conv_id", *OUT, "audit", "repaired_sha256"]
    pieces = done.filter("seg is not null").select("conv_id", "seg", "pos", *ROW, "costs")

    def ends_of(table: pa.Table) -> pa.Table:
        """Costs to go after each range of one conversation: a row for each range."""
        v, out = END, []
        for seg, costs in sorted(zip(table["seg"].to_pylist(), table["costs"].to_pylist(), strict=True), reverse=True):
            out.append((seg, list(v)))
            v = _advance(tuple(tuple(costs[i: i + 4]) for i in range(0, 16, 4)), v)
        return pa.table([pa.array([s for s, _ in out], pa.int32()), pa.array([e for _, e in out], pa.list_(pa.int64()))],
                        ["seg", "end"])

    ends = (pieces.filter("costs is not null").select("conv_id", "seg", "costs").groupBy("conv_id")
            .applyInArrow(ends_of, "seg int, end array<bigint>"))
    final = _arrow(result)

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, r = None, None
        for (c, _, end), own in _grouped(batches, ["conv_id", "seg", "end"]):
            if r is None or c != conv:
                if r is not None:
                    yield _batch([_result_row(conv, r)], final)
                conv, r = c, Repair()
            r.feed(own, tuple(end))
        if r is not None:
            yield _batch([_result_row(conv, r)], final)

    # two rows a range at most
    cut = (pieces.drop("costs").join(F.broadcast(ends), "seg")
           .repartition("conv_id").sortWithinPartitions("conv_id", "seg", "pos").mapInArrow(last_pass, result))
    return done.filter("seg is null").select(columns).unionByName(cut)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """`repair` of the conversations after the test damage."""
    return repair(damaged(conversations))
