"""Conversation structure repair by signatures.

A conversation's rows, in order, become a string of one letter per row: its role, and whether it has a fault. Long strings
are cut into blocks. Every distinct block is solved once, by memoised recursion, for each state it may be entered in and
what the rest of its conversation costs from each state it may be left in; the edits found are joined back to the
conversations that have the block, and replayed on their rows.

The edits: Keep a row, Rerole it to user or assistant, Delete it, Insert an empty row. The result is empty, or an optional
system row and then user and assistant rows in turn. Of the cheapest lists of edits the one of least initials counts.
Blocks of one conversation meet in two passes that carry four costs, or one state, from block to block: a conversation of
any length takes a bounded memory.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, saved, slices, tidy

#: What edits cost, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing said yet, after system, after user, after assistant; what a role leads to. 0 and 3 may be the end.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 40
END = (0, NEVER, NEVER, 0)
#: Letters in a block.
BLOCK = 64
#: A character that shows, and the same with a sentence's end as the last one.
SHOWN, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


class Solver:
    """The cheapest edits of strings of rows, by recursion over the rows; a task's memo, of bounded size, serves all its strings."""

    MOST = 1 << 17

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[int, str, int]] = {}

    def __call__(self, rest: str, state: int, after: tuple[int, ...], inserted: int = 0) -> tuple[int, str, int]:
        """The cost, initials and last state of the best edits of the rows `rest`; `after`: the cost from each last state on.

        Letters: the role's initial (x: another role), upper case where truncated; d: must go; '.': the conversation's end.
        New rows stand before a row or at the end, so that blocks never compete for them.
        """
        if not rest:
            return after[state], "", state
        key = (rest, state, after, inserted)
        best = self.known.get(key)
        if best is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            best = self.known[key] = min(self.choices(*key))
        return best

    def choices(self, rest: str, state: int, after: tuple[int, ...], inserted: int) -> Iterator[tuple[int, str, int]]:
        head, tail = rest[0], rest[1:]
        moves: list[tuple[int, str, int | None]] = []  # cost, initial, next state
        if head == ".":
            moves.append((0, "", state))
        else:
            moves.append((DELETE, "D", state))
            if head != "d":
                extra = TRUNCATED if head.isupper() else 0
                moves.append((KEEP + extra, "K", STEP.get((state, head.lower()))))
                moves += [(REROLE + extra, "R", STEP.get((state, r))) for r in "ua"]
        for cost, initial, then in moves:
            if then is not None:
                more, audit, last = self(tail, then, after)
                yield cost + more, initial + audit, last
        if inserted < 2:  # from any state two new rows lead to any other that new rows can reach
            for r in "ua":
                then = STEP.get((state, r))
                if then is not None:
                    more, audit, last = self(rest, then, after, inserted + 1)
                    yield INSERT + more, "I" + audit, last


def rows_of(conversations: DataFrame, harm: bool) -> DataFrame:
    """_c, _t, role, text, n: the rows as they are, or damaged by the hash of conversation and turn; n is 2 where a row is doubled."""
    rows = pick(conversations, _c="conv_id", _t="turn", role="role", text="text")
    rows = rows.select("_c", "_t", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    if not harm:
        return rows.select("*", F.lit(1).cast("long").alias("n"))
    key = F.concat(F.coalesce(F.col("_c").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("_t").cast("string"), F.lit(" ")))
    rows = rows.select("*", (F.crc32(F.encode(key, "UTF-8")) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("_c", "_t", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_d") == 3, 2).otherwise(1).cast("long").alias("n"))


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def cells(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: _c, _t, role, h, n, blank, ended, again (role and text stood in an earlier turn)."""
    own = rows.select("_c", "_t", "role", text_hash(F.col("text")).alias("h"), "n", (~F.col("text").rlike(SHOWN)).alias("blank"), F.col("text").rlike(ENDED).alias("ended"))
    one = saved(own.groupBy("_c", "_t", "role", "h").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("ended").alias("ended")), "repair-cells")
    order = F.struct(F.col("_t").isNotNull().alias("given"), F.col("_t").alias("turn"))
    # Only what stands in more than one turn is asked for; a hot text's side of this join may be split.
    first = one.where("not blank").groupBy(F.col("_c").alias("f_c"), F.col("role").alias("f_role"), F.col("h").alias("f_h")).agg(F.min(order).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    same = F.col("_c").eqNullSafe(F.col("f_c")) & (F.col("role") == F.col("f_role")) & (F.col("h") == F.col("f_h"))
    joined = one.join(first, same, "left")
    return joined.select(*one.columns, F.coalesce(order > F.col("first"), F.lit(False)).alias("again"))


def in_order(rows: DataFrame, *by: str | Column) -> DataFrame:
    return rows.repartition("_c").sortWithinPartitions("_c", *by)


def signature_blocks(marked: DataFrame, block: int) -> DataFrame:
    """_c, block, signature, illegal, and the place of its first row (_t, role, h). The last block of a conversation ends in '.'."""
    letter = F.when(F.col("blank") | F.col("again"), "d").otherwise(F.when(F.col("role").rlike("^[sua]"), F.substring("role", 1, 1)).otherwise("x"))
    rows = marked.select("_c", "_t", "role", "h", "n", F.when(F.col("ended"), letter).when(letter == "d", letter).otherwise(F.upper(letter)).alias("letter"))
    type_ = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ["_c", "block", "signature", "illegal", "_t", "role", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        started, conv, before, number = False, None, None, 0
        letters, illegal, place = [], 0, None
        for batch in batches:
            if schema is None:
                kinds = {f.name: f.type for f in batch.schema}
                schema = pa.schema([("_c", kinds["_c"]), ("block", pa.int64()), ("signature", pa.string()), ("illegal", pa.int64()), ("_t", kinds["_t"]), ("role", pa.string()), ("h", pa.binary())])
            out = []
            for c, t, role, h, n, x in zip(*(batch.column(i).to_pylist() for i in ("_c", "_t", "role", "h", "n", "letter")), strict=True):
                if not started or c != conv:
                    if started:
                        out.append((conv, number, "".join(letters) + ".", illegal, *place))
                    started, conv, before, number, letters, illegal, place = True, c, None, 0, [], 0, (t, role, h)
                for i in range(n):
                    if len(letters) == block:
                        out.append((conv, number, "".join(letters), illegal, *place))
                        number, letters, illegal, place = number + 1, [], 0, (t, role, h)
                        if len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                            out = []
                    illegal += before is not None and before + role[:1] not in LEGAL
                    before = role[:1]
                    letters.append("d" if i else x)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
        if started:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (conv, number, "".join(letters) + ".", illegal, *place), strict=True))], schema)

    return in_order(rows, "_t", "role", "h").mapInArrow(tidy(run), f"_c {type_['_c']}, block long, signature string, illegal long, _t {type_['_t']}, role string, h binary")


def passages(blocks: DataFrame) -> DataFrame:
    """signature, costs: of every distinct signature, the cost from each state (four rows) to each state at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cheapest, ends = Solver(), [tuple(0 if i == j else NEVER for j in range(4)) for i in range(4)]
        for batch in batches:
            costs = [[min(cheapest(x, i, e)[0], NEVER) for i in range(4) for e in ends] for x in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(costs, pa.list_(pa.int64()))], names=["signature", "costs"])

    return blocks.select("signature").distinct().mapInArrow(tidy(run), "signature string, costs array<bigint>")


def with_rest(blocks: DataFrame) -> DataFrame:
    """blocks with rest: what the blocks behind cost from each state, less the least of the four."""
    rows = blocks.join(passages(blocks), "signature")
    kind = blocks.schema["_c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, behind = object(), END
        for batch in batches:
            rests = []
            for c, signature, costs in zip(*(batch.column(i).to_pylist() for i in ("_c", "signature", "costs")), strict=True):
                if signature.endswith("."):
                    conv, behind = c, END
                assert c == conv
                rests.append(behind)
                ahead = [min(costs[4 * i + j] + behind[j] for j in range(4)) for i in range(4)]
                behind = tuple(x - min(ahead) for x in ahead)
            yield pa.RecordBatch.from_arrays([batch.column("_c"), batch.column("block"), batch.column("signature"), pa.array(rests, pa.list_(pa.int64()))], names=["_c", "block", "signature", "rest"])

    return in_order(rows.select("_c", "block", "signature", "costs"), F.desc("block")).mapInArrow(tidy(run), f"_c {kind}, block long, signature string, rest array<bigint>")


def solved(asked: DataFrame) -> DataFrame:
    """Each distinct (signature, rest) solved once: four answers (cost, audit, last), by the state it is entered in."""
    answer = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cheapest = Solver()
        for batch in batches:
            out = []
            for signature, rest in zip(batch.column("signature").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                best = [cheapest(signature, i, tuple(rest)) for i in range(4)]
                out.append([{"cost": cost - rest[last], "audit": audit, "last": last} for cost, audit, last in best])
            yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("rest"), pa.array(out, answer)], names=["signature", "rest", "answers"])

    return asked.select("signature", "rest").distinct().mapInArrow(tidy(run), "signature string, rest array<bigint>, answers array<struct<cost:bigint,audit:string,last:int>>")


def chosen(rows: DataFrame) -> DataFrame:
    """From each block's four answers the one for the state that the block before leaves."""
    kind = rows.schema["_c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            out = []
            for block, answers in zip(batch.column("block").to_pylist(), batch.column("answers").to_pylist(), strict=True):
                found = answers[state if block else 0]
                state = found["last"]
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("_c"), batch.column("block"), pa.array([x["cost"] for x in out], pa.int64()), pa.array([x["audit"] for x in out], pa.string())], names=["_c", "block", "cost", "audit"])

    return in_order(rows.select("_c", "block", "answers"), "block").mapInArrow(tidy(run), f"_c {kind}, block long, cost long, audit string")


def audits(blocks: DataFrame) -> DataFrame:
    """blocks with the cost and initials of their edits."""
    alone = (F.col("block") == 0) & F.col("signature").endswith(".")
    end = F.array(*(F.lit(x).cast("long") for x in END))
    single = blocks.where(alone).select("_c", "block", "signature", end.alias("rest"))
    asked = saved(single.unionByName(with_rest(blocks.where(~alone))), "repair-signatures")
    rows = asked.join(solved(asked), ["signature", "rest"])
    first = F.element_at("answers", 1)
    alone = (F.col("block") == 0) & F.col("signature").endswith(".")
    found = rows.where(alone).select("_c", "block", first["cost"].alias("cost"), first["audit"].alias("audit")).unionByName(chosen(rows.where(~alone)))
    own = found.select(F.col("_c").alias("a_c"), F.col("block").alias("a_block"), "cost", "audit")
    return blocks.join(own, F.col("_c").eqNullSafe(F.col("a_c")) & (F.col("block") == F.col("a_block"))).drop("a_c", "a_block")


def replay(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: the rows that the edits leave or make, a conversation's rows together in order."""
    text = rows.select("_c", "_t", "role", text_hash(F.col("text")).alias("h"), F.lit(-1).cast("long").alias("block"), "text", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("kind"))
    audit = edits.select("_c", "_t", "role", "h", "block", F.col("audit").alias("text"), F.lit(0).alias("kind"))
    type_ = rows.schema["_c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        started, conv, state, position = False, None, 0, 0
        pending: deque[str] = deque()

        def said(initial: str, role: str, text: str) -> tuple:
            nonlocal state, position
            if initial != "K":
                role = "assistant" if state == 2 else "user"
            state = STEP[state, role[:1]]
            position += 1
            return conv, position - 1, initial, role, text

        def rest() -> Iterator[tuple]:
            while pending:
                yield said(pending.popleft(), "", "")

        for whole in batches:
            kind = whole.schema.field("_c").type
            for batch in slices(iter([whole]), "text", 4 << 20):
                out = []
                for c, role, text, is_text in zip(*(batch.column(i).to_pylist() for i in ("_c", "role", "text", "kind")), strict=True):
                    if not started or c != conv:
                        out += rest()
                        started, conv, state, position = True, c, 0, 0
                    if not is_text:
                        pending.extend(text)
                        continue
                    while pending[0] == "I":
                        out.append(said(pending.popleft(), "", ""))
                    initial = pending.popleft()
                    if initial != "D":
                        out.append(said(initial, role, text))
                if out:
                    yield table(out, kind)
        if pending:
            yield table(list(rest()), kind)

    def table(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "position", "edit", "role", "text"])

    return in_order(text.unionByName(audit), "_t", "role", "h", "kind", "block").mapInArrow(tidy(run), f"conv_id {type_}, position long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: over role:text of the rows, newline-joined. The rows must lie as replay() leaves them."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, type_ = None, None, None
        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            out = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in ("conv_id", "role", "text")), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (type_, pa.string()), strict=True)], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(tidy(run), f"conv_id {kind}, repaired_sha256 string")


def plan(conversations: DataFrame, block: int, harm: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows, their cells with faults, and the blocks with their edits."""
    rows = rows_of(conversations, harm)
    marked = cells(rows)
    blocks = saved(signature_blocks(marked, block), "repair-blocks")
    return rows, marked, saved(audits(blocks), "repair-edits")


def repaired(conversations: DataFrame, block: int = BLOCK, harm: bool = False) -> DataFrame:
    """conv_id, position, edit, role, text: the repaired rows of all conversations (after damage, with harm).

    Null roles and texts are one space. Rows of equal turn (and of null turns, which come first) are ordered by role and
    the hash of the text; equal rows are duplicates of the first. Rows of a null conv_id form one conversation. A
    conversation of blank rows alone has no rows left. A long conversation is replayed in one task, row by row. Very long
    texts pass whole. No rows give no rows; further columns are ignored.
    """
    rows, _, edits = plan(conversations, block, harm)
    return replay(rows, edits)


def report(conversations: DataFrame, block: int = BLOCK, harm: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for every conv_id.

    Cases as in repaired(); a conversation of which damage left no rows has zeros, an empty audit and an empty hash.
    """
    rows, marked, edits = plan(conversations, block, harm)
    every = conversations.select(F.col("conv_id").alias("conv_id")).distinct()
    turns = marked.select(F.col("_c").alias("conv_id"), F.col("_t").cast("long").alias("turn")).distinct()
    copy = F.when(~F.col("blank"), F.col("n") - 1 + F.col("again").cast("long"))
    faults = marked.groupBy(F.col("_c").alias("conv_id")).agg(F.sum(F.when(F.col("blank"), F.col("n"))).alias("blank"), F.sum(copy).alias("duplicate"), F.sum((~F.col("blank") & ~F.col("again") & ~F.col("ended")).cast("long")).alias("truncated"))
    known = edits.select(F.col("_c").alias("conv_id"), "illegal", "cost", F.struct("block", "audit").alias("edit"))
    parts = every
    for part in (turns, faults, known, digests(replay(rows, edits))):
        parts = parts.unionByName(part, allowMissingColumns=True)
    zero = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list("edit")), lambda x: x["audit"]), "").alias("audit")
    hash_ = F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return parts.groupBy("conv_id").agg(gaps, *zero, audit, hash_).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
