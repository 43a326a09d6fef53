r"""Conversation structure repair by a dynamic programme over retained turns.

A conversation's rows are kept, reroled or deleted, and turns are inserted, so that the role initials read
``(s?(ua)+)?`` at the least cost.  The programme chooses the retained rows alone: going back from the end, the best
cost of retaining row ``j`` with final role ``r`` is its own price, plus the cheapest next retained row ``k``.  The gap
between the two is priced by prefix sums of deletion costs, D[k] - D[j + 1], and by the inserts that the two roles
determine, so one running minimum of D[k] + cost[k] for each role is all that is asked of the rows behind, and a row costs
a constant number of steps.  The audit is read forwards; among cheapest edits the letter that is least goes first.

The programme runs over one narrow row a turn (its fault and role initial), in a stream sorted by conversation, with a
few numbers held a row.  Texts are sorted once more behind a head row that holds the audit, and hashed as they pass, so
no conversation's texts are ever held together.  A conversation is one sequence and its hash one chain, so its rows
pass through one task, whatever their number; repeated turns are found in advance, spread by role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices, small_batches

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
FINE, BLANK, DUPLICATE, CUT = range(4)  # a row's first fault
_ROLES = "sua"
_AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}  # the role that follows without an insert
_NEVER = 1 << 60
_INSERTS = {(p, r): 0 if _AFTER[p] == r or p + r == "s" else 1 if r != "s" else _NEVER for p in _AFTER for r in _ROLES}
_CLOSING = {"": 0, "s": 2, "u": 1, "a": 0}  # inserts before the end
LEGAL = ("su", "ua", "au")


class Programme:
    """The cheapest repair of a sequence of (fault, role initial)."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.rows, self.n = rows, len(rows)
        self.deleted = [0]  # prefix sums of deletion costs
        for _ in rows:
            self.deleted.append(self.deleted[-1] + DELETE)
        # least[t][r]: the smallest deleted[k] + cost of retaining row k >= t with role r
        self.least: list[tuple[int, int, int]] = [(_NEVER, _NEVER, _NEVER)] * (self.n + 1)
        self.exact: list[tuple[int, int, int]] = [(_NEVER, _NEVER, _NEVER)] * self.n
        for j in range(self.n - 1, -1, -1):
            self.exact[j] = tuple(self._retained(j, r) for r in _ROLES)
            self.least[j] = tuple(map(min, self.exact[j], self.least[j + 1]))

    def _retained(self, j: int, role: str) -> int:
        fault, initial = self.rows[j]
        if fault in (BLANK, DUPLICATE) or (role == "s" != initial):
            return _NEVER
        own = (0 if initial == role else REROLE) + (TRUNCATED if fault == CUT else 0)
        return self.deleted[j] + own - self.deleted[j + 1] + self.best(role, j + 1)

    def best(self, role: str, t: int) -> int:
        """Cost from row ``t`` on after the final role ``role``, plus deleted[t]."""
        out = self.deleted[self.n] + INSERT * _CLOSING[role]
        for r, least in zip(_ROLES, self.least[t]):
            if least < _NEVER and _INSERTS[role, r] < _NEVER:
                out = min(out, least + INSERT * _INSERTS[role, r])
        return out

    def solve(self) -> tuple[int, str]:
        """(cost, audit): D, I, K and R in order, the ASCII-least of the cheapest."""
        role, t, audit = "", 0, []
        cost = left = self.best("", 0)
        while True:
            follows = _AFTER[role]
            if t < self.n and self.best(role, t + 1) == left:
                audit.append("D")
                t += 1
            elif INSERT + self.best(follows, t) == left:
                audit.append("I")
                role, left = follows, left - INSERT
            elif t == self.n:
                return cost, "".join(audit)
            else:
                initial = self.rows[t][1]
                first = initial == "s" and role == "" and self.exact[t][0] == left
                role, letter = ("s", "K") if first else (follows, "K" if initial == follows else "R")
                audit.append(letter)
                t += 1
                left = self.best(role, t)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the damage that crc32 of ``conv_id:turn`` decides; nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    code = (F.crc32(key.cast("binary")) % 20).alias("code")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), code)
    edited = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("dropped"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )
    return edited.drop("col")


def as_given(conversations: DataFrame) -> DataFrame:
    """The same columns without damage."""
    space = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(False).alias("dropped"))


_BLANKS = "' \\t\\n\\u000B\\u000C\\r'"


def _order() -> list[Column]:
    """Rows of one turn are ordered by role and by a digest of their text."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def faults(rows: DataFrame) -> DataFrame:
    """One narrow row a turn: conv_id, turn, role, digest, dropped, fault, initial."""
    from pyspark.sql import Window

    stripped = F.expr(f"btrim(text, {_BLANKS})")
    digest = F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")
    shape = F.when(stripped == "", BLANK).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT).alias("shape")
    seen = Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy(F.asc_nulls_first("turn"))
    found = rows.select("conv_id", "turn", "role", digest, "dropped", shape).withColumn("nth", F.row_number().over(seen))
    fault = F.when((F.col("shape") == CUT) | (F.col("shape") == FINE), F.when(F.col("nth") > 1, DUPLICATE).otherwise(F.col("shape"))).otherwise(BLANK)
    return found.select("conv_id", "turn", "role", "digest", "dropped", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial"))


_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Facts:
    """What is gathered of one conversation while its sorted rows pass."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str]] = []
        self.first = self.last = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, dropped: bool, fault: int, initial: str) -> None:
        if dropped:
            return
        if self.rows and self.rows[-1][1] + initial not in LEGAL:
            self.illegal += 1
        self.rows.append((fault, initial))
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first, self.last = turn if self.first is None else self.first, turn

    def figures(self) -> tuple:
        count = [0] * 4
        for fault, _ in self.rows:
            count[fault] += 1
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, count[BLANK], count[DUPLICATE], count[CUT], self.illegal, *Programme(self.rows).solve())


def _streamed(df: DataFrame, step, schema: str) -> DataFrame:
    """Rows of a sorted stream through ``step(row)``, which yields results; it is called with None at the end of a task."""
    small_batches(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = step()
        kinds = None
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for batch in slices(batches):
            kinds = kinds or [batch.schema.field(0).type, *([pa.int64()] * 6), *([pa.string()] * (len(names) - 7))]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out += take(row)
            if out:
                yield made()
                out = []
        if kinds and (out := list(take(None))):
            yield made()

    return df.mapInArrow(run, schema)


def _figure_step():
    at = object()
    facts: _Facts | None = None

    def take(row):
        nonlocal at, facts
        if row is None:
            yield (at, *facts.figures())
            return
        conv, turn, dropped, fault, initial = row
        if facts is None or conv != at:
            if facts is not None:
                yield (at, *facts.figures())
            at, facts = conv, _Facts()
        facts.add(turn, dropped, fault, initial)

    return take


class _Repair:
    """Hashes a repaired conversation while its rows pass; ``role:text`` joined by line feeds."""

    def __init__(self, head: tuple) -> None:
        self.head, self.audit, self.at, self.role = head, head[-1], 0, ""
        self.hash, self.lines = hashlib.sha256(), 0

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.role = _AFTER[self.role]
            self._say("user" if self.role == "u" else "assistant", "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.role = role[:1]
            self._say(role, text)
        elif letter == "R":
            self.role = _AFTER[self.role]
            self._say("user" if self.role == "u" else "assistant", text)

    def result(self) -> tuple:
        self._inserts()
        return (*self.head, self.hash.hexdigest())


def _repair_step():
    now: _Repair | None = None

    def take(row):
        nonlocal now
        if row is None or row[1] == 0:
            if now is not None:
                yield now.result()
            now = _Repair((row[0], *row[4:])) if row else None
        else:
            now.add(row[2], row[3])

    return take


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """One row for every conv_id: its faults, the cost and audit of the cheapest repair and the repaired text's SHA-256.

    Null roles and texts are one space; rows of a null conv_id are one conversation; null turns stand first and do not
    count in ``gaps``.  Rows of one turn are ordered by role, then by a digest of the text; a repeated row is a duplicate.  A role counts by its first
    character, whatever follows; an empty role fits nowhere.  A conversation of which damage leaves nothing has zeros,
    an empty audit and the hash of the empty string.  An empty table gives an empty result; further columns are ignored.
    """
    given = conversations.select(*[F.col(quoted(c)) for c in ("conv_id", "turn", "role", "text")])
    rows = damaged(given) if damage else as_given(given)
    narrow = faults(rows).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *_order())
    kind = dict(given.dtypes)["conv_id"]
    heads = _streamed(narrow.select("conv_id", F.col("turn").cast("long"), "dropped", "fault", "initial"), _figure_step, f"conv_id {kind}, {_FIGURES}")
    names = [x.split()[0] for x in _FIGURES.split(", ")]
    none = F.lit(None)
    texts = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", *[none.cast("string" if n == "audit" else "long").alias(n) for n in names])
    both = heads.select("conv_id", F.lit(0).alias("kind"), none.cast(dict(given.dtypes)["turn"]).alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), *names)
    both = both.unionByName(texts).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    whole = both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *_order())
    return _streamed(whole.select("conv_id", "kind", "role", "text", *names), _repair_step, f"conv_id {kind}, {_FIGURES}, repaired_sha256 string")
