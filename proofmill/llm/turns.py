"""Repair of damaged conversations by alignment with the turn grammar.

A conversation's role initials should read ``(s?(ua)+)?``.  Every feasible target is ``s`` or nothing
followed by a stretch of the alternating string ``uaua...``, so the turns are aligned with all target lengths
by one Wagner-Fischer table over suffixes: a suffix of a target depends on its length alone.
Ukkonen's band keeps the table to the cells that edits of no more than the incumbent's cost can
reach.  Each cheapest length is backtraced to its ASCII-least audit and the audits are compared.

Long conversations are cut into sections; the table is then made from every grammar state at a section's
start to every state at its end, and of the survivors only the parts that still differ are kept.  An audit
and its rows give the cost, so among audits of equal cost none is a prefix of another, and the
least whole audit is made of least parts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import shuffle_tasks, small_batches

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Turns that one table covers; longer conversations are made of sections.
SECTION = 2048
FAR = 1 << 40

#: Grammar states: nothing yet, after s, after u, after a.  The symbol that follows a state, besides a leading s.
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
ACCEPTED = "0a"

# A turn's code: 4 for a turn that must go (blank or duplicate), else its initial as 0 s, 1 u, 2 a,
# 3 other; 8 more where it is truncated.
GONE, CUT = 4, 8


def turn_code(initial: str, gone: bool, cut: bool) -> int:
    return GONE if gone else {"s": 0, "u": 1, "a": 2}.get(initial, 3) + CUT * cut


def _incumbent(codes: list[int], state: str, end: str) -> int:
    """Cost above the unavoidable of two plain repairs: inserting what the grammar misses, or deleting everything."""
    worst = sum(1 if c & CUT else DELETE for c in codes) if state == end else FAR
    cost, at = 0, state
    for i, c in enumerate(codes):
        kind, need = c & 3, NEXT[at]
        if kind == 0 and at == "0" and i == 0 and not (len(codes) == 1 and end == "0"):
            at = "s"
        elif kind in (1, 2) and "sua"[kind] != need:
            cost += INSERT  # the missing symbol, then the turn itself
            at = "sua"[kind]
        else:
            cost += REROLE * (kind in (0, 3))
            at = need
    if at != end:
        if end in "ua" and at in "0sua":
            cost += INSERT if NEXT[at] == end else 2 * INSERT
        else:
            cost = FAR
    return min(cost, worst)


def _table(codes: list[int], last: str, bound: int) -> tuple[np.ndarray, int]:
    """Least cost to align the turns from i on with the alternating string of j symbols that ends in ``last``.

    Row i holds offsets j - (turns left), from -low to high, the band that ``bound`` leaves.
    """
    n = len(codes)
    cuts = sum(1 for c in codes if c & CUT)
    low = min(n, bound if bound <= cuts else cuts + (bound - cuts) // DELETE)
    high = bound // INSERT
    width = low + high + 1
    table = np.full((n + 1, width), FAR, np.int64)
    offset = np.arange(-low, high + 1)
    steps = np.arange(width) * INSERT
    table[n, low:] = steps[: high + 1]
    other = {"u": "a", "a": "u"}[last]
    for i in range(n - 1, -1, -1):
        j = offset + (n - i)
        kind, drop = codes[i] & 3, 1 if codes[i] & CUT else DELETE
        same = (j % 2 == 1) if kind == "sua".index(last) else (j % 2 == 0) if kind == "sua".index(other) else np.zeros(width, bool)
        best = np.where(j > 0, table[i + 1] + np.where(same, 0, REROLE), FAR)
        best[:-1] = np.minimum(best[:-1], table[i + 1, 1:] + drop)
        best[j < 0] = FAR
        table[i] = np.minimum.accumulate(best - steps) + steps  # insertions
    return table, low


def _walk(codes: list[int], table: np.ndarray, low: int, last: str, i: int, j: int) -> str:
    """The ASCII-least audit (D < I < K < R) among the cheapest from turn i with j symbols left."""
    n, width, out = len(codes), table.shape[1], []
    other = {"u": "a", "a": "u"}[last]
    get = lambda i, j: table[i, j - (n - i) + low] if 0 <= j - (n - i) + low < width and j >= 0 else FAR
    while i < n or j:
        here = get(i, j)
        if i < n and get(i + 1, j) + (1 if codes[i] & CUT else DELETE) == here:
            out.append("D")
            i += 1
        elif j and get(i, j - 1) + INSERT == here:
            out.append("I")
            j -= 1
        else:
            symbol = last if j % 2 else other
            out.append("K" if "sua".find(symbol) == codes[i] & 3 else "R")
            i, j = i + 1, j - 1
    return "".join(out)


def _aligned(codes: list[int], state: str, end: str, bound: int) -> tuple[int, str] | None:
    """(cost above the unavoidable, audit) of the best way from grammar state to grammar state; no turn here must go."""
    n = len(codes)
    drops = [1 if c & CUT else DELETE for c in codes]
    found = []  # (cost, turns deleted before a kept leading s or -1, target length after it)
    if state == end:  # an empty target
        found.append((sum(drops), -1, 0))
    tables = None
    if end in "ua":
        bound = min(bound, _incumbent(codes, state, end))
        table, low = tables = _table(codes, end, bound)
        parity = 1 if NEXT[state] == end else 0  # symbols of a target: odd where it begins and ends alike
        first = np.arange(table.shape[1]) + n - low
        for j in first[(first > 0) & (first % 2 == parity) & (table[0] <= bound)]:
            found.append((int(table[0, j - n + low]), -1, int(j)))
    if state == "0" and end != "0":  # a leading s must be kept from a turn; what stands before it goes
        gone = 0
        for i, c in enumerate(codes):
            if gone > bound:
                break
            if c & 3 == 0:
                if end == "s":
                    found.append((gone + sum(drops[i + 1 :]), i, 0))
                else:
                    j = np.arange(table.shape[1]) + n - i - 1 - low
                    for k in j[(j > 0) & (j % 2 == (end == "u")) & (table[i + 1] + gone <= bound)]:
                        found.append((gone + int(table[i + 1, k - (n - i - 1) + low]), i, int(k)))
            gone += drops[i]
    if not found:
        return None
    best = min(cost for cost, _, _ in found)
    audits = []
    for cost, i, j in found:
        if cost == best:
            head = "D" * i + "K" * (i >= 0)
            audits.append(head + (_walk(codes, *tables, end, i + 1, j) if j else "D" * (n - i - 1)))
    return best, min(audits)


def _with_gone(audit: str, codes: list[int]) -> str:
    """The audit of all turns: those that must go follow the edit of the turn before them at once, as D is the least letter."""
    if GONE not in codes:
        return audit
    out, at, i = [], 0, 0
    while i < len(codes) or at < len(audit):
        while i < len(codes) and codes[i] == GONE:
            out.append("D")
            i += 1
        while at < len(audit):
            letter = audit[at]
            out.append(letter)
            at += 1
            if letter != "I":
                i += 1
                break
    return "".join(out)


class Repair:
    """Cheapest audits of a conversation whose turn codes come in sections, kept for each grammar state."""

    def __init__(self):
        self.cost, self.done, self.tails = 0, [], {"0": (0, "")}

    def add(self, codes: list[int], final: bool = False) -> None:
        live = [c for c in codes if c != GONE]
        self.cost += DELETE * (len(codes) - len(live)) + TRUNCATED * sum(1 for c in live if c & CUT)
        ends = {}
        for state, (before, tail) in self.tails.items():
            for end in ACCEPTED if final else NEXT:
                got = _aligned(live, state, end, FAR)
                if got:
                    option = (before + got[0], tail + _with_gone(got[1], codes))
                    ends[end] = min(ends.get(end, option), option)
        if final:
            ends = {"": min(ends.values())}
        shared = len(commonprefix([tail for _, tail in ends.values()]))
        self.done.append(next(iter(ends.values()))[1][:shared])
        least = min(cost for cost, _ in ends.values())
        self.cost += least
        self.tails = {end: (cost - least, tail[shared:]) for end, (cost, tail) in ends.items()}

    def result(self) -> tuple[int, str]:
        (_, tail), = self.tails.values()
        return self.cost, "".join(self.done) + tail


@lru_cache(maxsize=1 << 16)
def _short(codes: bytes) -> tuple[int, str]:
    repair = Repair()
    repair.add(list(codes), final=True)
    return repair.result()


def cheapest_audit(codes: bytes, section: int = SECTION) -> tuple[int, str]:
    """(cost, audit) of one conversation's turn codes."""
    if len(codes) <= min(64, section):
        return _short(bytes(codes))
    repair = Repair()
    cuts = list(range(0, len(codes), section))
    for a in cuts:
        repair.add(list(codes[a : a + section]), final=a == cuts[-1])
    return repair.result()


# ---------------------------------------------------------------------------------------------------------- Spark

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): one row per row, with 0, 1 or 2 copies of it after the damage.

    The remainder of ``crc32('key:turn')`` by 20 decides: 0 drops the row, 1 empties its text, 2 removes its
    marks ``.!?``, 3 repeats it, 4 makes it the user's.  A null key or turn counts as one space there, a null role
    or text as one space altogether; keys and turns themselves stay null.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(some(key), F.lit(":"), some(turn)).cast("binary")) % 20
    body = F.when(fate == 1, "").when(fate == 2, F.translate(some(text), ".!?", "")).otherwise(some(text))
    return rows.select(
        F.col(key).alias("conv"),
        F.col(turn).alias("turn"),
        F.when(fate == 4, "user").otherwise(some(role)).alias("role"),
        body.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def _by_conversation(df: DataFrame, order: list) -> DataFrame:
    return df.repartition(shuffle_tasks(df), "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *order)


class _Conversation:
    """Counts and turn codes of one conversation, fed in order."""

    def __init__(self):
        self.turns = [None, None, 0]
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = self.seen = None
        self.codes, self.repair = bytearray(), None

    def add(self, turn, role: str, text: str, early: bool) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        body = text.strip(WHITE)
        again = early or self.seen == (turn, role, text)
        self.seen = (turn, role, text)
        blank = not body
        duplicate = not blank and again
        cut = not blank and not again and body[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.codes.append(turn_code(self.initial, blank or duplicate, cut))
        if len(self.codes) == 2 * SECTION:
            self.repair = self.repair or Repair()
            self.repair.add(list(self.codes[:SECTION]))
            del self.codes[:SECTION]

    def row(self) -> list:
        if self.repair is None:
            cost, audit = cheapest_audit(bytes(self.codes)) if self.codes else (0, "")
        else:
            for a in range(0, len(self.codes), SECTION):
                self.repair.add(list(self.codes[a : a + SECTION]), final=a + SECTION >= len(self.codes))
            cost, audit = self.repair.result()
        first, last, n = self.turns
        return [last - first + 1 - n if n else 0, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit]


class _Lines:
    """Repaired lines of one conversation, hashed while its turns pass by."""

    def __init__(self, row: list, audit: str):
        self.out, self.audit, self.at, self.last, self.hash = [*row, audit], audit, 0, "", hashlib.sha256()

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self._line(self._needed() if letter == "R" else role, text)

    def _needed(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._line(self._needed(), "")

    def _line(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.last else b"") + f"{role}:{text}".encode())
        self.last = role[:1]

    def row(self) -> list:
        self._inserted()
        return [*self.out, self.hash.hexdigest()]


def repaired_sha256(audit: str, turns: list[tuple[str, str]]) -> str:
    """SHA-256 of the repaired ``role:text`` lines of (role, text) turns under their audit."""
    lines = _Lines([], audit)
    for turn in turns:
        lines.turn(*turn)
    return lines.row()[-1]


def _streamed(step, names: list[str]):
    """mapInArrow over sorted rows: ``step(row)`` is fed each row and then None, and returns a finished row or None."""

    def run(batches):
        feed, key = step(), pa.int64()
        for batch in batches:
            key = batch.column(0).type
            rows = map(feed, zip(*(c.to_pylist() for c in batch.columns)))
            yield made([r for r in rows if r], key)
        yield made([r for r in [feed(None)] if r], key)

    def made(rows, key):
        kinds = [key, *([pa.int64()] * (len(names) - 1 - sum(n in _TEXTS for n in names))), *(pa.string() for n in names if n in _TEXTS)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names)

    return run


_TEXTS = ("audit", "repaired_sha256")
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audited():
    """Sorted turns to one audit row a conversation; a turn leaves one byte behind."""
    now = [None, None]

    def feed(row):
        done = None
        if now[1] is not None and (row is None or row[0] != now[0]):
            done = [now[0], *now[1].row()]
        if row is not None:
            conv, turn, role, text, copies, early = row
            if done is not None or now[1] is None:
                now[:] = [conv, _Conversation()]
            for _ in range(copies):
                now[1].add(turn, role, text, early)
        return done

    return feed


def _hashed():
    """Each conversation's audit row and then its sorted turns to the audit row with the hash of the repaired lines."""
    now = [None]

    def feed(row):
        done = None
        if now[0] is not None and (row is None or row[-1] is not None):
            done = now[0].row()
        if row is not None:
            conv, role, text, copies, *counts, audit = row
            if audit is not None:
                now[0] = _Lines([conv, *counts], audit)
            for _ in range(copies):
                now[0].turn(role, text)
        return done

    return feed


def repair_conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in damaged ``rows``.

    ``rows`` may hold a column ``copies`` (0 leaves a turn out, its conversation stays).  Turns are taken by turn number,
    null first, then by role and text, so repeated rows follow each other; a null key is a conversation of its own.  A
    conversation without turns has zeros, an empty audit and the hash of nothing; an empty table gives no rows.
    Turn numbers are whole numbers; other columns are not read.

    A conversation's hash needs its turns in order, so one task passes over them, in bounded memory but for the
    audit itself (a byte a turn): first for the audit, then, with the audit sorted in front of the turns, for the lines.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    src = rows.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), copies.cast("int").alias("copies"))
    src = small_batches(src)
    digest = F.sha2("text", 256)
    # where a role says a text in several turns, the first of them; null turns come before all
    spread = src.where("copies > 0").groupBy("conv", "role", digest.alias("digest")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    spread = spread.where("first < last or unnumbered and first is not null")
    a, b = src.withColumn("digest", digest).alias("a"), spread.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    early = F.coalesce((F.col("b.unnumbered") & F.col("a.turn").isNotNull()) | (F.col("a.turn") > F.col("b.first")), F.lit(False))
    marked = a.join(b, same, "left").select("a.conv", "a.turn", "a.role", "a.text", "a.copies", early.alias("early"))

    kind = src.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    audits = _by_conversation(marked, order).mapInArrow(_streamed(_audited, ["conv", *_COUNTS, "audit"]), f"conv {kind}, {counts}, audit string")

    none = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    turns = src.select("conv", "turn", "role", "text", "copies", *none, F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), *_COUNTS, "audit")
    both = _by_conversation(turns.unionByName(heads), [F.col("audit").isNull(), *order])
    lines = both.select("conv", "role", "text", "copies", *_COUNTS, "audit").mapInArrow(_streamed(_hashed, ["conv", *_COUNTS, "audit", "repaired_sha256"]), f"conv {kind}, {counts}, audit string, repaired_sha256 string")
    return lines.withColumnRenamed("conv", key)
