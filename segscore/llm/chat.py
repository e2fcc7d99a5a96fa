"""Chat formatting in budgeted, turn-aligned windows.

A conversation is cut where the prefix sum of its turns' tokens would pass the budget. Each window starts with the
conversation's system turn, then repeats the last turns of the window before up to a history budget, then brings new
turns. The loss mask covers assistant texts among the new turns only: a repeated target is context, never loss.

Rows stream through each task in (conversation, turn) order, so memory holds one window, whatever a conversation's
length.

Template: "### role:\\n", the text, "\\n</turn>\\n". Inside roles and texts a backslash is doubled, a '#' that another '#'
follows gets a backslash after it, and "</" becomes "<\\/"; roles have ':' escaped too. Then no control string can occur
inside, and dropping the escaping backslashes restores every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Memo
from .common import pick, slices, tidy

END = "\n</turn>\n"
HEAD = re.compile(r"### ((?:\\.|[^\\:])*):\n", re.S)
WINDOW = "conv_id long, window long, text string, loss array<struct<start:long,end:long>>, new_from long, tokens long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str) -> str:
    return re.sub("#(?=#)", r"#\\", text.replace("\\", "\\\\")).replace("</", "<\\/")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text lies in it."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}:\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, and the place of the escaped text of each turn of a formatted window."""
    at = 0
    while at < len(text):
        head = HEAD.match(text, at)
        if not head:
            raise ValueError(f"no turn starts at {at}")
        stop = text.index(END, head.end())
        yield unescape(head[1]), unescape(text[head.end() : stop]), head.end(), stop
        at = stop + len(END)


class TokenCounter(Encoder):
    """The number of tokens of a text, from bounded memos of the numbers of its chunks."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__(path, pattern)
        self.known = Memo(lambda chunk: len(self.chunk(chunk)), self.known.most, self.known.longest)

    def plain(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.chunks(text)))

    def __call__(self, text: str) -> int:
        if self.special is None or not any(map(text.__contains__, self.automaton.special)):
            return self.plain(text)
        return sum(1 if i % 2 else self.plain(part) for i, part in enumerate(self.special.split(text)))


class Windows:
    """Takes the turns of one conversation in order and gives its windows."""

    def __init__(self, conv, budget: int, history: int) -> None:
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.new: list[tuple] = []
        self.context: list[tuple] = []
        self.summed = 0  # tokens of the window so far: the prefix sum less that at the window's start
        self.number = 0

    def add(self, role: str, rendered: tuple[str, int, int], tokens: int) -> dict | None:
        turn = (role, *rendered, tokens)
        out = None
        if self.new and self.summed + tokens > self.budget:
            out = self.flush()
        if not self.new:  # repeated history gives way to the first new turn, the oldest first
            while self.context and self.context[-1] is not self.system and self.summed + tokens > self.budget:
                gone = self.context.pop(0 if self.context[0] is not self.system else 1)
                self.summed -= gone[4]
        if role == "system" and self.system is None:
            self.system = turn
        self.new.append(turn)
        self.summed += tokens
        return out

    def flush(self) -> dict:
        shown = [*self.context, *self.new]
        parts, loss, at, new_from = [], [], 0, 0
        for i, (role, text, start, end, _) in enumerate(shown):
            if i == len(self.context):
                new_from = at
            if i >= len(self.context) and role == "assistant" and end > start:
                loss.append({"start": at + start, "end": at + end})
            parts.append(text)
            at += len(text)
        out = {"conv_id": self.conv, "window": self.number, "text": "".join(parts), "loss": loss, "new_from": new_from, "tokens": self.summed}
        # What the next window repeats: the system turn, then the last turns that fit the history budget.
        keep, room = [], self.history
        for turn in reversed(shown):
            if turn is self.system or turn[4] > room:
                break
            room -= turn[4]
            keep.append(turn)
        self.context = [self.system] * (self.system is not None) + keep[::-1]
        self.new, self.summed, self.number = [], sum(x[4] for x in self.context), self.number + 1
        return out


def format_windows(conversations: DataFrame, tokenizer: str, pattern: str, budget: int = 1024, history: int = 128) -> DataFrame:
    """One row per window: conv_id, window, text, loss (code-point spans), new_from, tokens.

    tokens: the sum of the formatted turns' tokens by `tokenizer`, whose pre-split is `pattern`; over the budget only where one new turn, with the
    system turn that stands before it, is. Such a turn is not cut and has no other new turn or history beside it.
    Null roles and texts count as empty. Turns of equal number (and null numbers, which come first) are ordered by role
    and text; repeated rows stay. The rows of a null conv_id form one conversation, and one conversation is one task's
    work, streamed. An empty table gives no windows; further columns are ignored.
    """
    rows = pick(conversations, _c="conv_id", _t="turn", _r="role", _x="text").select(F.col("_c").cast("long").alias("_c"), "_t", F.coalesce("_r", F.lit("")).alias("_r"), F.coalesce("_x", F.lit("")).alias("_x"))
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("new_from", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(tokenizer, pattern)
        now, ready, size = None, [], 0
        for batch in slices(batches, "_x", 4 << 20):
            turns = [(c, r, render(r, x)) for c, r, x in zip(*(batch.column(c).to_pylist() for c in ("_c", "_r", "_x")), strict=True)]
            for conv, role, rendered in turns:
                tokens = count(rendered[0])
                if now is None or conv != now.conv:
                    if now is not None:
                        ready.append(now.flush())
                    now = Windows(conv, budget, history)
                if done := now.add(role, rendered, tokens):
                    ready.append(done)
                    size += len(done["text"])
                if len(ready) >= 2000 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready, size = [], 0
        if now is not None:
            ready.append(now.flush())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    return rows.repartition("_c").sortWithinPartitions("_c", "_t", "_r", "_x").mapInArrow(tidy(run), WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted windows alone: their new turns and what the loss mask covers."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None

        def row() -> dict:
            return {"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_windows": state[5]}

        for batch in batches:
            ready = []
            for conv, text, loss, new_from in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "new_from")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        ready.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, _, _ in parse(text[new_from:]):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += 1
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(tidy(run), DIGEST)
