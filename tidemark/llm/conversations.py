"""Repair of conversation structure: what is to be kept, reroled, deleted or inserted so that roles alternate at least cost.

A repaired conversation has the role initials ``(s?(ua)+)?``.  The repair is a subsequence of the turns that are retained,
each kept with its role or reroled to user or assistant, found by dynamic programming over the turns in order.  For each
role of the last retained turn (or none) a running minimum holds the least cost of a repair that ends so, less the prefix
sum of deletion costs up to that turn: the price of the gap to a later turn is then a difference of two prefix sums,
whatever its length.  The pair of roles on both sides of a gap determines the turns to insert there, after its deletions.

Of repairs of equal cost the one with the ASCII-least audit wins, where an audit is the edits' initials (D, I, K, R) in
order.  Audits of different states that have used up the same turns never are prefixes of each other, so their order is
that of their beginnings: the states' ranks alone break ties, and no audit is compared letter by letter.  Each state
carries the SHA-256 of its own repaired text, so a conversation is read once and held nowhere.

Rows are dealt by conversation and sorted on disk, and stream through their task; what a task keeps of a conversation is
some three bytes for each turn.  One conversation is one task's, however long: its hash is a chain over its whole text.

Defined results: nulls count as one space, in the key of a row's damage too; turns come in order, null turns first, equal
turns by role and text; repeated rows are damaged alike, and all but the first are duplicates; all rows of a null conv_id
are one conversation; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import slices

#: Costs of edits; a truncated turn that isn't deleted costs TRUNCATED besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States: the role of the last turn that is retained.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: Roles inserted between a state and the next retained role, or the end (None).
BETWEEN = {
    (NONE, SYSTEM): (), (NONE, USER): (), (NONE, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
    (NONE, None): (), (SYSTEM, None): (USER, ASSISTANT), (USER, None): (ASSISTANT,), (ASSISTANT, None): (),
}
_LEGAL = {"su", "ua", "au"}
_FROM = {r: [p for p in range(4) if (p, r) in BETWEEN] for r in (SYSTEM, USER, ASSISTANT)}


class Repair:
    """The cheapest repair of the turns added so far."""

    def __init__(self) -> None:
        self.deleted = 0
        #: For each state: cost less the deletion costs up to it, rank of its audit, hash of its text and whether it has any.
        self.best: list[tuple[int, int, object, bool] | None] = [(0, 0, hashlib.sha256(), False), None, None, None]
        #: For each turn and state: 0 if the turn is deleted on the way to it, else its previous state and edit.
        self.steps = bytearray()

    def add(self, role: str, text: str, fault: str) -> None:
        """The next turn; ``fault`` is blank, duplicate, truncated or empty."""
        before, own = self.deleted, _STATE.get(role[:1])
        extra = TRUNCATED if fault == "truncated" else 0
        new: dict[int, tuple[int, int, bytes, int]] = {}
        if fault not in ("blank", "duplicate"):
            for to in (SYSTEM, USER, ASSISTANT):
                if to == own:
                    price, letter, name = extra, b"K", role
                elif to != SYSTEM:
                    price, letter, name = extra + REROLE, b"R", _NAME[to]
                else:
                    continue
                options = []
                for p in _FROM[to]:
                    if state := self.best[p]:
                        added = BETWEEN[p, to]
                        options.append((state[0] + before + INSERT * len(added) + price, state[1], p))
                if options:
                    cost, rank, p = min(options)
                    new[to] = (cost, rank, letter, p)
        self.deleted += DELETE
        # every state, in the order of its audit: the rank of its beginning, then D before I before K and R
        chosen, order = list(self.best), []
        steps = [0, 0, 0]
        for r in range(4):
            old, made = self.best[r], new.get(r)
            take = made is not None and (old is None or (made[0] - self.deleted, made[1], 1) < (old[0], old[1], 0))
            if take:
                cost, rank, letter, p = made
                added = BETWEEN[p, r]
                _, _, hashed, some = self.best[p]
                hashed = hashed.copy()
                name = role if letter == b"K" else _NAME[r]
                hashed.update("\n".join(["", *(f"{_NAME[x]}:" for x in added), f"{name}:{text}"])[0 if some else 1 :].encode("utf-8", "replace"))
                chosen[r] = (cost - self.deleted, 0, hashed, True)
                order.append((rank, b"I" * len(added) + letter, r))
                steps[r - 1] = 1 + p + 4 * (letter == b"R")
            elif old is not None:
                order.append((old[1], b"D", r))
        for rank, (_, _, r) in enumerate(sorted(order)):
            chosen[r] = (chosen[r][0], rank, *chosen[r][2:])
        self.best = chosen
        self.steps += bytes(steps)

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the repaired text."""
        ends = [(s[0] + self.deleted + INSERT * len(BETWEEN[r, None]), s[1], r) for r, s in enumerate(self.best) if s]
        cost, _, r = min(ends)
        added = BETWEEN[r, None]
        audit = bytearray(b"I" * len(added))
        hashed, some = self.best[r][2].copy(), self.best[r][3]
        if added:
            hashed.update("\n".join(["", *(f"{_NAME[x]}:" for x in added)])[0 if some else 1 :].encode())
        for at in range(len(self.steps) - 3, -1, -3):
            step = self.steps[at + r - 1] if r else 0
            if not step:
                audit += b"D"
                continue
            p = (step - 1) % 4
            audit += (b"R" if step > 4 else b"K") + b"I" * len(BETWEEN[p, r])
            r = p
        return cost, audit[::-1].decode(), hashed.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) of each row after the damage that its key tells."""
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def faults(text: Column, seen: Column) -> Column:
    """The first fault of a turn, or an empty string."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


_COLUMNS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


class _Conversation:
    """Counts and repair of the rows of a conversation in their order."""

    def __init__(self) -> None:
        self.repair, self.counts = Repair(), {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.least = self.most = self.previous = self.initial = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> None:
        for copy in range(copies):
            own = "duplicate" if copy and fault != "blank" else fault
            self.counts[own] += 1
            self.illegal += self.initial is not None and self.initial + role[:1] not in _LEGAL
            self.initial = role[:1]
            self.repair.add(role, text, own)
        if turn is not None and copies:
            self.distinct += turn != self.previous
            self.least = turn if self.least is None else self.least
            self.most = self.previous = turn

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, *self.repair.end())


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with their faults, dealt by conversation: the window is served by the same deal.

    Rows without copies stay, so that each conversation is named.
    """
    one_text = Window.partitionBy("conv_id", "role", "text")
    dealt = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "copies").repartition("conv_id")
    seen = F.sum("copies").over(one_text.orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("fault", faults(F.col("text"), F.coalesce(seen, F.lit(0)) > 0))


def _order() -> list[Column]:
    """Turns in order; of equal rows the one that isn't a duplicate is the first."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("fault") == "duplicate"]


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, faults, cost, audit and hash of the repaired text of each conversation of (conv_id, turn, role, text, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[] for _ in range(9)]
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *_NAMES])

        own, key, done = None, None, []
        for batch in slices(batches):
            for conv, turn, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault")), strict=True):
                if own is None or conv != key:
                    if own is not None:
                        done.append((key, *own.result()))
                    own, key = _Conversation(), conv
                own.add(turn, role, text, copies, fault)
            yield made(done)
            done = []
        if own is not None:
            yield made([(key, *own.result())])

    return _marked(rows).sortWithinPartitions("conv_id", *_order()).mapInArrow(run, f"conv_id bigint, {_COLUMNS}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text and edit (I, K or R) of the turns of each repaired conversation.

    Each conversation's audit comes before its turns in the sorted stream, so that its edits are applied as they pass.
    """
    audits = repaired(rows).select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copies"), F.lit("").alias("fault"), F.lit(0).alias("_turns"))
    both = _marked(rows).withColumn("_turns", F.lit(1)).unionByName(audits).repartition("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, place, last = None, "", 0, 0, NONE
        out: list[tuple] = []

        def put(role: str, text: str, edit: str) -> None:
            nonlocal place, last
            out.append((key, place, role, text, edit))
            place, last = place + 1, _STATE[role[0]]

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put(_NAME[USER if last != USER else ASSISTANT], "", "I")
                at += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[] for _ in range(5)]
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "role", "text", "edit"])

        for batch in slices(batches):
            for conv, role, text, copies, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies", "_turns")), strict=True):
                if not turns:
                    inserts()  # what is left of the conversation before
                    key, audit, at, place, last = conv, text, 0, 0, NONE
                for _ in range(copies):
                    inserts()
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        put(role, text, edit)
                    elif edit == "R":
                        put(_NAME[USER if last != USER else ASSISTANT], text, edit)
            yield taken()
        inserts()
        yield taken()

    return both.sortWithinPartitions("conv_id", "_turns", *_order()).mapInArrow(run, "conv_id bigint, place bigint, role string, text string, edit string")


def conversation_repairs(rows: DataFrame) -> DataFrame:
    """The repairs of conversations after the damage that each row's key tells."""
    return repaired(damaged(rows))
