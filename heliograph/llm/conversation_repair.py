"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``.

A conversation is a sequence of messages, each with a *code*: the first letter
of its role (s, u, a or another) and its fault.  The edits form a weighted
automaton over codes whose four states say what has been written so far:
nothing, a system message, an open user message, or whole pairs.  The automaton
is determinised lazily and from the end of the conversation: a state is the
vector of costs still to come, one for each of the four, less their minimum.
Whether a vector was met before is looked up in a transition table that a task
keeps for all of its conversations, so the scan of a conversation is one table
access a message and gives the cost.  As costs to come of the four states never
differ by much (ten at most), there are few vectors.  Following the tight arcs
the other way, which is the reading order, gives the edits; taking the smallest
letter of the tight arcs at each place gives the ASCII-least string of them.

Both passes are streams over rows that Spark has dealt by conversation and
sorted: the scan holds three bytes a message of one conversation, applying the
edits holds their string alone.  A hot conversation is one stream, as its
SHA-256 and its edit string are one value, but its texts are never gathered.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, OPEN, PAIRS = range(4)
BLANK, DUPLICATE, CUT = 1, 2, 3
#: The white space of the contract: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
#: The state after a user or assistant message is written next; its role is told by the state before.
NEXT = (OPEN, OPEN, PAIRS, OPEN)
ROLE = ("user", "user", "assistant", "user")
#: What is still to be inserted at the end, for each state.
ENDING = ("", "II", "I", "")
LONG_MAX = (1 << 63) - 1
_LEGAL = {tuple(pair) for pair in (b"su", b"ua", b"au")}


def _keeps(state: int, letter: int) -> int | None:
    """The state after a message with this role's letter (0 s, 1 u, 2 a) is kept, if it can be."""
    if letter == 0:
        return SYSTEM if state == NOTHING else None
    if letter == (2 if state == OPEN else 1):
        return NEXT[state]
    return None


class CostAutomaton:
    """Vectors of costs to come, numbered as they are met, and the table of their transitions."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.to: list[list[int]] = []
        self.weight: list[list[int]] = []
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.end_cost = self._state([len(e) * INSERT for e in ENDING])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        key = tuple(c - least for c in costs)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
            self.to.append([-1] * 16)
            self.weight.append([0] * 16)
        return self.number[key], least

    @staticmethod
    def _options(code: int, state: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits of one message, without insertions."""
        fault, letter = divmod(code, 4)
        out = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            kept = _keeps(state, letter)
            if kept is not None:
                out.append(("K", KEEP + more, kept))
            out.append(("R", REROLE + more, NEXT[state]))
        return out

    def _before(self, after: int, code: int) -> list[int]:
        """Costs to come before a message, relative to those of vector ``after``."""
        ahead = self.vectors[after]
        costs = [min(c + ahead[q] for _, c, q in self._options(code, state)) for state in range(4)]
        for _ in range(4):
            costs = [min(c, INSERT + costs[NEXT[state]]) for state, c in enumerate(costs)]
        return costs

    def step(self, after: int, code: int) -> int:
        """The vector before a message; its weight stands in the table from then on."""
        at = self.to[after][code]
        if at < 0:
            at, least = self._state(self._before(after, code))
            self.to[after][code], self.weight[after][code] = at, least
        return at

    def arc(self, after: int, code: int, state: int) -> tuple[str, int]:
        """The smallest tight letters from ``state`` up to and with this message's edit, and the state after it."""
        got = self.arcs.get((after, code, state))
        if got is None:
            costs, ahead, letters, q = self._before(after, code), self.vectors[after], "", state
            while True:
                tight = [(letter, to) for letter, c, to in self._options(code, q) if c + ahead[to] == costs[q]]
                if INSERT + costs[NEXT[q]] == costs[q]:
                    tight.append(("I", NEXT[q]))
                letter, q = min(tight)
                letters += letter
                if letter != "I":
                    break
            got = self.arcs[after, code, state] = letters, q
        return got

    def repair(self, codes: bytes | bytearray) -> tuple[int, str]:
        """Cost and edit letters of one conversation."""
        after = array("L", bytes(array("L").itemsize * len(codes)))
        at, cost, to, weight = self.end, self.end_cost, self.to, self.weight
        for i in range(len(codes) - 1, -1, -1):
            code = codes[i]
            after[i] = at
            before = to[at][code]
            if before < 0:
                before = self.step(at, code)
            cost += weight[at][code]
            at = before
        cost += self.vectors[at][NOTHING]
        state, letters = NOTHING, []
        for code, vector in zip(codes, after, strict=True):
            made, state = self.arc(vector, code, state)
            letters.append(made)
        return cost, "".join(letters) + ENDING[state]


def damage(conversations: DataFrame) -> DataFrame:
    """Messages damaged by the hash of ``conv_id:turn``, for trying the repair.

    Of 20 classes 0 loses the message, 1 its text, 2 its full stops, exclamation
    and question marks; 3 repeats it, 4 makes its role user.  Nulls count as one
    space, in the hash too.  Columns: conv_id, turn, role, text.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return (
        rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", "role", "text")
    )


def _plain(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and ``same``, equal for equal role and text."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    return rows.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


_ORDER = ("turn", "role", "same")


def _code() -> Column:
    """Fault times four, plus the letter of the role."""
    fault = F.when(F.col("ending") == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.col("ending").isin(".", "!", "?"), CUT).otherwise(0)
    initial = F.substring("role", 1, 1)
    return (fault * 4 + F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)).cast("int")


class _Report:
    """What is known of the conversation that the stream is in."""

    def __init__(self, conv_id: object):
        self.conv_id, self.codes = conv_id, bytearray()
        self.least = self.most = self.last = None
        self.turns = 0

    def add(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None:
            if self.turns == 0:
                self.least = turn
            if self.turns == 0 or turn != self.last:
                self.turns += 1
            self.most = self.last = turn

    def row(self, automaton: CostAutomaton) -> tuple:
        faults, letters = self.codes.translate(bytes(c // 4 for c in range(256))), self.codes.translate(bytes(b"suax"[c % 4] for c in range(256)))
        legal = sum(pair in _LEGAL for pair in zip(letters, letters[1:]))
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        cost, audit = automaton.repair(self.codes)
        return (self.conv_id, min(gaps, LONG_MAX), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), max(len(letters) - 1, 0) - legal, cost, audit)


def repair_plan(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``messages`` has conv_id, turn, role and text.  Rows are read by turn, nulls
    first; ties by role, then by a hash of role and text, so repeated rows are
    neighbours.  Null roles and texts count as one space; null ids are one
    conversation.  A row's first fault counts: no visible character (blank),
    role and text seen earlier (duplicate), or no full stop, exclamation or
    question mark at its end (truncated).  ``audit`` has a letter for each edit
    (K keep, R new role, D delete, I insert) and is the ASCII-least of the
    cheapest; ``gaps`` is the number of turns missing between the first and the
    last, at most the largest long.  Texts are not shuffled here.  An empty table gives an empty
    result.
    """
    ending = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    # dealt by conversation, which serves the window as well; its groups are the equal messages of one conversation
    dealt = _plain(messages).select("conv_id", "turn", "role", "same", ending.alias("ending")).repartition("conv_id")
    coded = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("turn"))).withColumn("code", _code())
    ordered = coded.select("conv_id", *_ORDER, "code").sortWithinPartitions("conv_id", *_ORDER).select("conv_id", "turn", "code")
    conv_type = ordered.schema["conv_id"].dataType.simpleString()
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, out, kind = CostAutomaton(), None, [], None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind, *[pa.int64()] * 6, pa.string()])], names=names)
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.row(automaton))
                    now = _Report(conv_id)
                now.add(turn, code)
            if out:
                yield pack(out)
                out = []
        if now is not None:
            yield pack([now.row(automaton)])

    return ordered.mapInArrow(scan, f"conv_id {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def apply_plan(messages: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired messages: conv_id, place from 0, edit (keep, rerole or insert), role, text.

    A conversation's edits come before its messages in the sorted stream, so
    nothing is joined to the rows.  Rows lie dealt by conversation and in order.
    Inserted messages have empty texts; conversations of which nothing is left
    have no rows.
    """
    rows = _plain(messages).withColumn("audit", F.lit(None).cast("string")).withColumn("part", F.lit(1))
    null = F.lit(None)
    heads = plan.select("conv_id", null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), null.cast("binary").alias("same"), "audit", F.lit(0).alias("part"))
    stream = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", *_ORDER).select("conv_id", "part", "role", "text", "audit")
    conv_type = stream.schema["conv_id"].dataType.simpleString()
    names = ("conv_id", "place", "edit", "role", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place, kind, out = None, "", 0, NOTHING, 0, None, []

        def insert() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "insert", ROLE[state], ""))
                at, state, place = at + 1, NEXT[state], place + 1

        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind, pa.int64(), pa.string(), pa.string(), pa.string()])], names=names)
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, part, role, text, letters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    insert()
                    conv, audit, at, state, place = conv_id, letters, 0, NOTHING, 0
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, after = ROLE[state], NEXT[state]
                else:
                    after = SYSTEM if role[:1] == "s" else NEXT[state]
                out.append((conv, place, "rerole" if edit == "R" else "keep", role, text))
                state, place = after, place + 1
            if out:
                yield pack(out)
                out.clear()
        insert()
        if out:
            yield pack(out)

    return stream.mapInArrow(apply, f"conv_id {conv_type}, place long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of ``apply_plan``, in the order in which they lie: ``role:text``, joined by newlines."""
    conv_type = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, kind = None, None, None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=("conv_id", "repaired_sha256"))
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield pack(out)
        if digest is not None:
            yield pack([(conv, digest.hexdigest())])

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {conv_type}, repaired_sha256 string")


def repair_report(conversations: DataFrame, messages: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan and the digest of the repaired text for every id of ``conversations``, also those without messages.

    ``plan`` is that of ``messages`` and is read twice, so pass a written table.
    """
    ids = conversations.select("conv_id").distinct()
    hashed = digests(apply_plan(messages, plan)).withColumnRenamed("conv_id", "hashed_id")
    planned = plan.withColumnRenamed("conv_id", "planned_id")
    out = ids.join(planned, F.col("conv_id").eqNullSafe(F.col("planned_id")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
