"""Conversations repaired to an optional system turn and user-assistant pairs.

Rows of a conversation are taken by turn, null turns first; within a turn by role and by the MD5
of the text. A row's fault is the first that holds of: blank (no character besides white space),
duplicate (role and text occurred earlier), truncated (the last character besides white space is
no `.`, `!` or `?`). Blank and duplicate rows must go; the others may be kept, given
another role or deleted, and empty turns may be inserted. `glr.Repair` finds the cheapest edits
that give role initials `(s?(ua)+)?`, among equally cheap ones the smallest audit in ASCII.

Spark finds faults by aggregation and a join, without the texts: a row is its turn, role,
digest and copies, so repeated rows are one row with a count, and one distinct text of a
conversation is kept once. A conversation's rows then pass through one task in order, a byte a row
being held, since both the cheapest edits and the digest of the whole repaired text
depend on all of them in order; the texts stream by and are not held.

A null conversation id is a conversation like any other. Null roles and texts count as one
space. A role's initial is its first character; roles other than s.., u.., a.. can only be
changed or deleted. A conversation without rows, or whose rows are all deleted, repairs to
nothing. Other columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stonewatch.llm.common import frugal, stage
from stonewatch.llm.glr import Repair

#: Roles by initial, and the initials that may follow one another.
GRAMMAR = (
    ("conversation", ()),
    ("conversation", ("pairs",)),
    ("conversation", ("s", "pairs")),
    ("pairs", ("u", "a", "pairs")),
    ("pairs", ("u", "a")),
)
ROLES = {"u": "user", "a": "assistant"}
PAIRS = ("su", "ua", "au")

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

INITIALS = "sua?"
FAULTS = ("none", "blank", "duplicate", "truncated")
CACHED = 100_000
CACHED_ROWS = 64

_SPACE = r"[\x20\x09-\x0D]"
_SHOWN = r"[^\x20\x09-\x0D]"


def token(initial: str, fault: str) -> int:
    return FAULTS.index(fault) * len(INITIALS) + INITIALS.index(initial)


def forced(kind: int) -> bool:
    """Whether rows of this kind must be deleted."""
    return FAULTS[kind // len(INITIALS)] in ("blank", "duplicate")


def actions(initial: str, fault: str) -> list[tuple[str | None, int, str]]:
    gone = [(None, DELETE, "D")]
    if fault in ("blank", "duplicate"):
        return gone
    extra = TRUNCATED if fault == "truncated" else 0
    kept = [(initial, KEEP + extra, "K")] if initial != "?" else []
    return [*kept, *((r, REROLE + extra, "R") for r in ROLES), *gone]


def repairer() -> Repair:
    kinds = {token(i, f): actions(i, f) for i in INITIALS for f in FAULTS}
    return Repair(GRAMMAR, kinds, [(r, INSERT, "I") for r in ROLES])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the trial damage that crc32(`conv_id:turn`) % 20 decides, and their `copies`."""
    space = F.lit(" ")
    spelt = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    hit = F.crc32(F.concat_ws(":", *spelt).cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def intact(conversations: DataFrame) -> DataFrame:
    """Rows as they are, with the columns of `damaged`."""
    space = F.lit(" ")
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        F.lit(1).cast("long").alias("copies"),
    )


ORDER = ("role", "digest")


def _first_turn():
    return F.struct(F.col("turn").isNotNull().alias("known"), "turn")


def with_faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Light rows (conv_id, turn, role, digest, blank, closed, copies, first), and the distinct
    texts of each conversation where they first occur. Rows of no copies keep their conversation."""
    text = F.col("text")
    marked = rows.withColumns(
        {
            "digest": F.unhex(F.md5(text.cast("binary"))),
            "blank": ~text.rlike(_SHOWN),
            "closed": text.rlike(rf"[.!?]{_SPACE}*\z"),
        }
    )
    texts = stage(
        marked.filter("copies > 0 and not blank")
        .groupBy("conv_id", *ORDER)
        .agg(F.min(_first_turn()).alias("at"), F.first("text").alias("text"))
        .select("conv_id", "at.turn", *ORDER, "text"),
        "turns",
    )
    light = stage(
        marked.groupBy("conv_id", "turn", *ORDER, "blank", "closed").agg(F.sum("copies").alias("copies")), "faults"
    )
    firsts = texts.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", *ORDER)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", *ORDER)]
    met = light.join(firsts, same, "left")
    first = F.col("turn").eqNullSafe(F.col("_turn")) & F.col("_role").isNotNull()
    return met.withColumn("first", first).select(*light.columns, "first"), texts


def _plan_schema(kind: T.DataType) -> T.StructType:
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return T.StructType(
        [
            T.StructField("conv_id", kind),
            *(T.StructField(c, T.LongType()) for c in counts),
            T.StructField("audit", T.StringType()),
            T.StructField("edits", T.StringType()),
        ]
    )


class _Conversation:
    """What is held of a conversation while its rows pass by."""

    def __init__(self):
        self.kinds = bytearray()
        self.counts = dict.fromkeys(FAULTS, 0)
        self.turns, self.low, self.high = 0, None, None
        self.illegal, self.last = 0, None

    def add(self, turn, role: str, blank: bool, closed: bool, first: bool, copies: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
        own = "none" if closed else "truncated"
        faults = ["blank" if blank else own if first else "duplicate"]
        rest = "blank" if blank else "duplicate"
        self.kinds.append(token(initial, faults[0]))
        self.kinds.extend(bytes([token(initial, rest)]) * (copies - 1))
        self.counts[faults[0]] += 1
        self.counts[rest] += copies - 1
        self.illegal += self.last is not None and self.last + initial not in PAIRS
        self.illegal += (copies - 1) * (initial * 2 not in PAIRS)
        self.last = initial

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def live_edits(kinds: bytes, audit: str) -> str:
    """The audit without the deletions of rows that must go."""
    left, rows = [], iter(kinds)
    for letter in audit:
        if letter == "I" or not forced(next(rows)):
            left.append(letter)
    return "".join(left)


def _planner(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = repairer(), {}
        done: list[tuple] = []

        def finish(conv_id, held: _Conversation) -> None:
            kinds = bytes(held.kinds)
            found = known.get(kinds) or machine.best(reversed(kinds))
            if len(kinds) <= CACHED_ROWS and len(known) < CACHED:
                known[kinds] = found
            counts = held.counts
            done.append(
                (conv_id, held.gaps(), counts["blank"], counts["duplicate"], counts["truncated"], held.illegal, *found,
                 live_edits(kinds, found[1]))
            )

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema
            )
            done.clear()
            return made

        current, held = None, None
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv_id != current:
                    if held is not None:
                        finish(current, held)
                    current, held = conv_id, _Conversation()
                held.add(*row)
            if done:
                yield flushed()
        if held is not None:
            finish(current, held)
            yield flushed()

    return frugal(run)


def plans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of each conversation (see `_plan_schema`), and its distinct texts."""
    light, texts = with_faults(rows)
    kind = rows.schema["conv_id"].dataType
    schema = _plan_schema(kind)
    sort = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *map(F.col, ORDER)]
    dealt = light.repartition("conv_id").sortWithinPartitions(*sort)
    taken = dealt.select("conv_id", "turn", "role", "blank", "closed", "first", "copies")
    return stage(taken.mapInArrow(_planner(to_arrow_schema(schema)), schema), "plans"), texts


class _Writer:
    """Applies the edits of one conversation to its rows as they come."""

    def __init__(self, edits: str):
        self.edits, self.at, self.last = edits, 0, ""

    def _put(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        self.last = role[:1]
        return role, text, edit

    def _next_role(self) -> str:
        return ROLES["a" if self.last == "u" else "u"]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield self._put(self._next_role(), "", "I")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            yield self._put(role if edit == "K" else self._next_role(), text, edit)


def _in_order(plan: DataFrame, texts: DataFrame) -> DataFrame:
    """Each conversation's plan followed by its rows, in one partition."""
    both = plan.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    sort = [F.col("conv_id"), F.col("kind"), F.col("turn").asc_nulls_first(), *map(F.col, ORDER)]
    return both.repartition("conv_id").sortWithinPartitions(*sort).drop("turn", "digest")


def _rows_writer(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, writer, position = None, None, 0
        made: list[tuple] = []

        def put(rows) -> None:
            nonlocal position
            for role, text, edit in rows:
                made.append((conv_id, position, role, text, edit))
                position += 1

        def flushed() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [()] * len(schema)
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )
            made.clear()
            return out

        for batch in batches:
            names = ("conv_id", "kind", "edits", "role", "text")
            for key, kind, edits, role, text in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if kind == 0:
                    if writer is not None:
                        put(writer.inserted())
                    conv_id, writer, position = key, _Writer(edits), 0
                else:
                    put(writer.row(role, text))
            yield flushed()
        if writer is not None:
            put(writer.inserted())
            yield flushed()

    return frugal(run)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows (conv_id, position, role, text, edit) of `intact` or `damaged` rows;
    `edit` is K, R or I."""
    plan, texts = plans(rows)
    schema = T.StructType(
        [rows.schema["conv_id"], T.StructField("position", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]
    )
    return _in_order(plan, texts).mapInArrow(_rows_writer(to_arrow_schema(schema)), schema)


def _digester(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, digest, head, empty = None, None, (), True
        done: list[tuple] = []

        def put(rows) -> None:
            nonlocal empty
            for role, text, _ in rows:
                digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False

        def finish() -> None:
            put(writer.inserted())
            done.append((*head, digest.hexdigest()))

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema
            )
            done.clear()
            return out

        names = [*schema.names[:-1], "kind", "edits", "role", "text"]
        for batch in batches:
            for *plan, kind, edits, role, text in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if kind == 0:
                    if writer is not None:
                        finish()
                    writer, digest, head, empty = _Writer(edits), hashlib.sha256(), plan, True
                else:
                    put(writer.row(role, text))
            if done:
                yield flushed()
        if writer is not None:
            finish()
            yield flushed()

    return frugal(run)


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""
    plan, texts = plans(rows)
    fields = [f for f in plan.schema if f.name != "edits"]
    schema = T.StructType([*fields, T.StructField("repaired_sha256", T.StringType())])
    return _in_order(plan, texts).mapInArrow(_digester(to_arrow_schema(schema)), schema)
