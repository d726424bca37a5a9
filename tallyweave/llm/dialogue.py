"""Repair of conversation structure by least-cost edits, computed once for each shared suffix.

A conversation is brought to the shape ``(s?(ua)+)?`` of role initials: an optional system turn, then user and assistant in
turns. Edits are Keep (0), Rerole to user or assistant (1), Delete (2; the only choice for blank and duplicate rows) and Insert of
an empty user or assistant turn (5); a truncated row that stays costs 5 more. Among the cheapest ways the one whose edits'
initials are least in ASCII order counts.

Each row becomes one letter (its role's initial and its first fault) and each conversation a signature. What is still to
pay depends on the rest of a signature alone, so equal signatures are made distinct, and distinct signatures, written from
their ends and sorted, share an automaton in which equal suffixes are one node. Signatures are dealt by ranges of that order:
a task holds the path of the current signature, leaves a node once and for all when the order moves on, and nodes at the
borders of ranges alone are computed twice. A node keeps, for each grammar state, the cost to go above the least of them and
the best edits up to the next row; nodes with equal values share one entry, found by (letter, entry behind it).

Rows are brought into order by ranges of (conversation, turn, role, text digest), so that a conversation that holds a large
share of all rows is spread over many tasks; equal rows are counted first. A signature has one byte a row, as the audit string
in the result has. ``repaired`` and the digest in ``report`` stream through one conversation's rows in order (SHA-256 has no
parallel form), holding one Arrow batch and the audit.

Defined results: rows go by turn, nulls first, then role, text digest (MD5); equal rows are interchangeable. Null roles and
texts count as one blank, a null conversation id is a conversation. Roles are known by their first character: s, u, a; any
other and an empty role must be reroled or deleted. A conversation without rows isn't in the results; an empty table gives
none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import drop, stored

SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# a letter is 4 * role + fault above this one: roles s, u, a, other; faults none, blank, duplicate, truncated
LETTER = ord("A")
ROLES = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}


def _wanted(state: int) -> str:
    """The role a grammar state asks for next."""
    return "a" if state == USER else "u"


class Suffixes:
    """The automaton: entries of nodes, shared by value.

    An entry holds for each state the cost to go (above the least of the four) and the best way up to and with the next row:
    its edits and the state behind them.
    """

    def __init__(self) -> None:
        self.entries: list[tuple[tuple[int, ...], tuple[tuple[str, int], ...]]] = []
        self.known: dict[tuple, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.last, self.last_cost = self._close([0, None, None, 0], [("", START), None, None, ("", ASSISTANT)])

    def _close(self, cost: list, way: list) -> tuple[int, int]:
        """Entry and least cost once Inserts before the next row are allowed for: D comes before I before K and R."""
        for _ in range(3):  # more than two Inserts in a row only repeat a state
            for state in range(4):
                then = _AFTER[state, _wanted(state)]
                if cost[then] is None:
                    continue
                own = (cost[then] + INSERT, "I" + way[then][0])
                if cost[state] is None or own < (cost[state], way[state][0]):
                    cost[state], way[state] = own[0], (own[1], way[then][1])
        least = min(cost)
        value = (tuple(c - least for c in cost), tuple(way))
        if value not in self.known:
            self.known[value] = len(self.entries)
            self.entries.append(value)
        return self.known[value], least

    def node(self, letter: int, behind: int) -> tuple[int, int]:
        """Entry of the suffix that begins with ``letter`` and goes on as ``behind``, and the cost it adds to the least."""
        if (letter, behind) not in self.steps:
            role, fault = divmod(letter - LETTER, 4)
            cost, way = [], []
            to_go = self.entries[behind][0]
            for state in range(4):
                choices = [(DELETE + to_go[state], "D", state)]
                if fault in (0, 3):
                    more = TRUNCATED if fault == 3 else 0
                    after = _AFTER.get((state, ROLES[role])) if role < 3 else None
                    if after is not None:
                        choices.append((KEEP + more + to_go[after], "K", after))
                    after = _AFTER[state, _wanted(state)]
                    choices.append((REROLE + more + to_go[after], "R", after))
                best = min(choices)
                cost.append(best[0])
                way.append((best[1], best[2]))
            self.steps[letter, behind] = self._close(cost, way)
        return self.steps[letter, behind]


def solve(reversed_signatures: Iterator[bytes]) -> Iterator[tuple[int, str]]:
    """Cost and audit of signatures written from their ends, best in sorted order; shared beginnings are computed once."""
    automaton = Suffixes()
    path: list[tuple[int, int]] = [(automaton.last, automaton.last_cost)]  # entry, cost of the least state
    before = b""
    for signature in reversed_signatures:
        shared, limit = 0, min(len(before), len(signature))
        while shared < limit and before[shared] == signature[shared]:
            shared += 1
        del path[shared + 1 :]
        for letter in signature[shared:]:
            entry, added = automaton.node(letter, path[-1][0])
            path.append((entry, path[-1][1] + added))
        before = signature
        entry, least = path[-1]
        total, state, edits = least + automaton.entries[entry][0][START], START, []
        for entry, _ in reversed(path):
            some, state = automaton.entries[entry][1][state]
            edits.append(some)
        yield total, "".join(edits)


def _prepared(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, fault (0 none, 1 blank, 3 truncated) with nulls replaced; ``copies`` if it is there."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    copies = F.col("copies").cast("bigint") if "copies" in df.columns else F.lit(1).cast("bigint")
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    end = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    fault = F.when(end == "", 1).when(F.instr(F.lit(".!?"), end) > 0, 0).otherwise(3)
    return rows.withColumn("digest", F.unhex(F.md5("text"))).withColumn("fault", fault)


def _counted(rows: DataFrame) -> DataFrame:
    """Equal rows once with their number, and whether the first of them is no duplicate; texts are known by their digests."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return rows.join(first, same).withColumn("new", place.eqNullSafe(F.col("first"))).drop("c", "r", "d", "first")


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def signatures(df: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """conv_id, turn_gaps, signature: one letter a row in order."""
    rows = stored(_counted(_prepared(df)), "dialogue-rows", passing)
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())
    place = {s: i for i, s in enumerate(ROLES)}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The letters of each conversation's stretch in this range."""
        part, now, letters, done, ids = TaskContext.get().partitionId(), None, bytearray(), [], []

        def emitted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([part] * len(done), pa.int32()), pa.array(done, pa.binary())], names=["conv_id", "part", "letters"])
            ids.clear()
            done.clear()
            return out

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, fault, copies, new in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "fault", "copies", "new"))):
                if letters and conv != now:
                    ids.append(now)
                    done.append(bytes(letters))
                    letters.clear()
                now, own = conv, LETTER + 4 * place.get(role[:1], 3)
                if fault == 1:
                    letters += bytes([own + 1]) * copies
                else:
                    letters += (bytes([own + fault]) if new else b"") + bytes([own + 2]) * (copies - bool(new))
            if len(done) >= 1000:
                yield emitted()
        if letters:
            ids.append(now)
            done.append(bytes(letters))
        if done:
            yield emitted()

    schema = T.StructType([df.schema["conv_id"], T.StructField("part", T.IntegerType()), T.StructField("letters", T.BinaryType())])
    stretches = ordered.select("conv_id", "role", "fault", "copies", "new").mapInArrow(runs, schema)
    # one stretch for each range that a conversation meets
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("part", "letters"))), lambda x: x["letters"].cast("string"))
    signed = stretches.groupBy("conv_id").agg(F.concat_ws("", pieces).alias("signature"))
    wide = F.col("turn").cast("decimal(38,0)")
    turns = rows.groupBy("conv_id").agg((F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn")).alias("turn_gaps"))
    turns = turns.select(F.col("conv_id").alias("c"), F.least(F.coalesce("turn_gaps", F.lit(0)), F.lit((1 << 63) - 1)).cast("bigint").alias("turn_gaps"))
    return signed.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "turn_gaps", "signature")


def _solved(signed: DataFrame) -> DataFrame:
    """signature, blank, duplicate, truncated, illegal, cost, audit of the distinct signatures."""
    backwards = signed.select("signature").distinct().select(F.reverse("signature").alias("signature"))
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    initial = {chr(LETTER + 4 * r + f): c for r, c in enumerate("sua?") for f in range(4)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[bytes] = []

        def told() -> Iterator[bytes]:
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    taken.append(s)
                    yield s.encode()

        rows: list[tuple] = []
        for cost, audit in solve(told()):
            s = taken.pop()[::-1]
            faults = [sum(s.count(chr(LETTER + 4 * r + f)) for r in range(4)) for f in (1, 2, 3)]
            roles = "".join(initial[c] for c in s)
            illegal = sum(roles[i : i + 2] not in _LEGAL for i in range(len(roles) - 1))
            rows.append((s, *faults, illegal, cost, audit))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), preserve_index=False)
                rows.clear()
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), preserve_index=False)

    names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    return backwards.repartitionByRange(parts, "signature").sortWithinPartitions("signature").mapInArrow(each, schema)


def plan(df: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """conv_id, turn_gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation; stored."""
    signed = stored(signatures(df, passing), "dialogue-signatures", passing)
    return stored(signed.join(_solved(signed), "signature").drop("signature"), "dialogue-plan", passing)


def _stream(df: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, whole conversations in a task."""
    rows = _prepared(df).select("conv_id", F.lit(True).alias("row"), "turn", "role", "digest", "text", "copies")
    audits = planned.select("conv_id", F.lit(False).alias("row"), F.lit(None).cast(df.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("copies"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("row"), *_order()[1:]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.unionByName(audits).repartition(parts, "conv_id").sortWithinPartitions(*order).select("conv_id", "row", "role", "text", "copies")


class _Walk:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _put(self, initial: str) -> str:
        self.state = _AFTER[self.state, initial]
        return "user" if initial == "u" else "assistant"

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._put(_wanted(self.state)), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that come of the next row; none if it is deleted."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _AFTER[self.state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._put(_wanted(self.state)), text


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, edit, role, text) for each turn of the repaired conversations, (conv, None, None, None) at their ends."""
    walk = now = None
    for batch in batches:
        for conv, row, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if not row:
                if walk:
                    yield from ((now, *x) for x in walk.inserts())
                    yield now, None, None, None
                walk, now = _Walk(text), conv
            for _ in range(copies):
                yield from ((now, *x) for x in walk.row(role, text))
    if walk:
        yield from ((now, *x) for x in walk.inserts())
        yield now, None, None, None


def repaired(df: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the turns of the repaired conversations."""
    schema = T.StructType([df.schema["conv_id"], *(T.StructField(n, t) for n, t in (("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, rows, place, size = None, [], 0, 0

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def emitted() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], names=schema.names)

        for conv, edit, role, text in _walked(seen()):
            if edit is None:
                place = 0
                continue
            rows.append((conv, place, edit, role, text))
            place, size = place + 1, size + len(text)
            if size > 1 << 20 or len(rows) >= 5000:
                yield emitted()
                size = 0
        if rows:
            yield emitted()

    return _stream(df, plan(df, passing)).mapInArrow(each, schema)


def report(df: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """``plan`` and sha256, the digest of the repaired ``role:text`` lines joined by line ends."""
    planned = plan(df, passing)
    schema = T.StructType([T.StructField("c", df.schema["conv_id"].dataType), T.StructField("sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, rows, digest, empty = None, [], hashlib.sha256(), True

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def emitted() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1])], names=schema.names)

        for conv, edit, role, text in _walked(seen()):
            if edit is None:
                rows.append((conv, digest.hexdigest()))
                digest, empty = hashlib.sha256(), True
                if len(rows) >= 5000:
                    yield emitted()
                continue
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        if rows:
            yield emitted()

    hashed = _stream(df, planned).mapInArrow(each, schema)
    return planned.join(hashed, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def damaged(df: DataFrame) -> DataFrame:
    """Test damage by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 counts it twice
    (``copies``), 4 makes its role user. Nulls in any text are one blank first."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))), F.lit(20))
    rows = df.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def repair_report(df: DataFrame) -> DataFrame:
    """``report`` of the damaged rows with a row for every conversation of ``df``."""
    passing: list[str] = []
    found = stored(report(damaged(df), passing), "dialogue-report")
    drop(df.sparkSession, passing)
    everyone = df.select(F.col("conv_id").alias("all")).distinct()
    joined = everyone.join(found, F.col("all").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("all", "conv_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c if c != "turn_gaps" else "gaps")
    counts = [zero(c) for c in ("turn_gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
