"""Hierarchical packing of token streams into sequences of several lengths.

Tiers are powers of two up to the longest. A document's ids are cut into full sequences of the longest tier and a rest;
the rest is routed to the smallest tier that holds it. Each tier is packed from the longest down: a rest opens a window
of its tier, and the gap behind it is filled with rests of shorter tiers, the longest that fits first; where none fits,
one is cut to fill the gap exactly. What a task has left at its end is cut along powers of two, so no sequence is padded.

Step groups are balanced over the whole output: the sequences of a length are numbered across tasks, by the counts that
each task reports, and dealt to the groups in turn; what is left of a length, fewer than there are groups, goes to those
with the least tokens so far. So groups hold the same mix of lengths, and differ by less than one sequence in tokens.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, saved, slices, texts, tidy

FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "task", "turn")


class WordEncoder:
    """Texts to little-endian 32-bit ids by a lower-casing tokenizer that drops white space, with end_id behind.

    No word of such a tokenizer crosses a space or a line end, and a full stop or comma between letters, digits or white
    space is a word of its own; so texts are lowered, cut there, and the words looked up. What is new in a run of texts
    goes to the library in one call. Plain words are joined by spaces, and the ids cut where the library's own rule ends
    as many pieces as a word has (every piece's last id is one of a piece's end); others are held apart by a special token.
    Texts in which such a mark touches another one, whose lower case depends on context, or that aren't in normal form,
    are cut at spaces only. The memo has two generations of `memo` words: what is in use moves to the younger one, the
    older one is dropped when that is full.
    """

    #: The pieces that the vocabulary's file names (a fixed value), and words that no neighbour can change.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    PLAIN = re.compile(r"[!-~]+")

    #: A full stop or comma beside another character that is neither a letter, a digit nor white space to the tokenizer.
    TOUCHING = re.compile(r"[.,](?:(?=[^\w\s]|[_\x1c-\x1f])|(?<=[^\w\s].)|(?<=[_\x1c-\x1f].))")

    def __init__(self, path: str, end_id: int, memo: int = 200_000, longest: int = 64) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = self.tokenizer.get_added_tokens_decoder()
        self.mark_id, mark = next((i, t) for i, t in special.items() if t.special and not (t.lstrip or t.rstrip))
        self.mark, self.specials = mark.content, [t.content for t in special.values()]
        self.end = np.asarray([end_id], "<u4").tobytes()
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.final = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.final[ends] = True
        self.memo, self.longest = memo, longest
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def library(self, words: list[str]) -> list[bytes]:
        """The ids of every word."""
        plain = [w for w in words if self.PLAIN.fullmatch(w) and not any(map(w.__contains__, self.specials))]
        found = dict(zip(plain, self.joined(plain), strict=True)) if plain else {}
        others = [w for w in words if w not in found]
        if others:
            found.update(zip(others, self.apart(others), strict=True))
        return [found[w] for w in words]

    def joined(self, words: list[str]) -> list[bytes]:
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        pieces = np.fromiter((1 if w.isalpha() else len(self.PIECES.findall(w)) for w in words), np.int64, len(words))
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != pieces.sum() or (pieces == 0).any():
            return self.apart(words)
        at = (ends[np.cumsum(pieces) - 1] * 4).tolist()
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)]

    def apart(self, words: list[str]) -> list[bytes]:
        ids = np.asarray(self.tokenizer.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = (np.flatnonzero(ids == self.mark_id) * 4).tolist()
        if len(at) != len(words) - 1:  # a word has the mark itself
            return [np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *(x + 4 for x in at)], [*at, len(raw)], strict=True)]

    def cut(self, text: str) -> list[str]:
        if "\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text) or self.TOUCHING.search(text) or any(map(text.__contains__, self.specials)):
            return text.replace("\n", " ").split(" ")
        return text.lower().replace("\n", " ").replace(",", " , ").replace(".", " . ").split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = list(map(self.cut, texts))
        new = set().union(*cut).difference(self.known)
        asked = []
        for w in new:
            if (ids := self.older.get(w)) is not None:
                self.known[w] = ids
            else:
                asked.append(w)
        if asked:
            self.known.update(zip(asked, self.library(asked), strict=True))
        out = [b"".join(map(self.known.__getitem__, words)) + self.end for words in cut]
        for w in asked:
            if len(w) > self.longest:
                del self.known[w]
        if len(self.known) > self.memo:
            self.known, self.older = {"": b""}, self.known
        return out


class Packer:
    """Packs (document, start, ids) pieces; emits a tuple per placed piece."""

    def __init__(self, tiers: tuple[int, ...], task: int) -> None:
        self.tiers = sorted(tiers, reverse=True)
        self.pools = {t: deque() for t in self.tiers}
        self.task, self.next_id = task, task << 40
        self.dealt: dict[int, int] = {}
        self.rows: list[tuple] = []

    def tier(self, n: int) -> int:
        return next(t for t in reversed(self.tiers) if n <= t)

    def place(self, pieces: list[tuple], length: int) -> None:
        turn = self.dealt.get(length, 0)
        self.dealt[length] = turn + 1
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, length, self.task, turn))
            at += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, longest = len(ids) // 4, self.tiers[0]
        full = total - total % longest
        for start in range(0, full, longest):
            self.place([(doc, start, ids[4 * start : 4 * (start + longest)], total)], longest)
        if full < total:
            self.pools[self.tier(total - full)].append((doc, full, ids[4 * full :], total))

    def pack(self) -> None:
        """Fills windows of every tier as long as shorter tiers have rests for their gaps."""
        for i, size in enumerate(self.tiers):
            pool, shorter = self.pools[size], self.tiers[i:]
            while pool:
                window = [pool.popleft()]
                gap = size - len(window[0][2]) // 4
                while gap:
                    found = next((t for t in shorter if self.pools[t] and len(self.pools[t][0][2]) <= 4 * gap), None)
                    if found is not None:
                        window.append(self.pools[found].popleft())
                        gap -= len(window[-1][2]) // 4
                        continue
                    found = next((t for t in reversed(shorter) if self.pools[t]), None)
                    if found is None:
                        break
                    doc, start, ids, total = self.pools[found].popleft()
                    window.append((doc, start, ids[: 4 * gap], total))
                    rest = (doc, start + gap, ids[4 * gap :], total)
                    self.pools[self.tier(len(rest[2]) // 4)].append(rest)
                    gap = 0
                if gap:  # nothing is left to fill it with: wait for more
                    for piece in reversed(window):
                        self.pools[self.tier(len(piece[2]) // 4)].appendleft(piece)
                    break
                self.place(window, size)

    def finish(self) -> None:
        """The rests of a task, joined and cut along powers of two."""
        self.pack()
        rest = deque(piece for t in self.tiers for piece in self.pools[t])
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc, start, ids, total = rest.popleft()
                n = min(gap, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.appendleft((doc, start + n, ids[4 * n :], total))
                gap -= n
            self.place(window, size)
            left -= size
        self.pools = {t: deque() for t in self.tiers}


def step_group(counts: dict[int, int], groups: int) -> Column:
    """The group of a sequence by its length and its number among all of that length, from the lengths' counts."""
    tokens, rests = [0] * groups, {}
    for length in sorted(counts, reverse=True):
        turns, left = divmod(counts[length], groups)
        tokens = [x + turns * length for x in tokens]
        rests[length] = sorted(range(groups), key=lambda g: (tokens[g], g))[:left]  # noqa: B023  used at once
        for g in rests[length]:
            tokens[g] += length
    number, out = F.col("_number"), F.pmod(F.col("_number"), F.lit(groups))
    for length, rest in rests.items():
        full = counts[length] - len(rest)
        if rest:
            late = F.get(F.array(*map(F.lit, rest)), (number - full).cast("int"))
            out = F.when((F.col("sequence_length") == length) & (number >= full), late).otherwise(out)
    return out.cast("long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = (512, 1024, 2048, 4096), groups: int = 8, buffer: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group.

    Each task packs its own documents, `buffer` at a time, so no text is shuffled and memory holds the buffer's rests.
    A null or empty text is the end id alone; a document longer than the longest tier is cut; repeated rows and null
    keys are packed like any row; an empty table gives no pieces; further columns are ignored.
    """
    schema = pa.schema([(c, pa.int64()) for c in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = WordEncoder(tokenizer, end_id)
        packer = Packer(tiers, TaskContext.get().partitionId())

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        waiting = 0
        for batch in slices(batches, "_text", 2 << 20):
            for doc, ids in zip(batch.column("_key").to_pylist(), encode(texts(batch, "_text")), strict=True):
                packer.add(doc, ids)
                waiting += 1
                if waiting >= buffer:
                    packer.pack()
                    waiting = 0
            if len(packer.rows) > 4096:
                yield out()
        packer.finish()
        if packer.rows:
            yield out()

    own = pick(docs, _key=key, _text=text).withColumn("_key", F.col("_key").cast("long"))
    pieces = saved(own.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in FIELDS)), "pieces")
    # A row per task and length; a length is a power of two up to the longest tier, so there are few of them.
    counts = pieces.where("offset = 0").groupBy("sequence_length", "task").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("sequence_length").orderBy("task")) - F.col("_n")).drop("_n")
    by_length = {x["sequence_length"]: x["n"] for x in pieces.where("offset = 0").groupBy("sequence_length").agg(F.count("*").alias("n")).collect()}
    numbered = pieces.join(before, ["sequence_length", "task"]).withColumn("_number", F.col("_before") + F.col("turn"))
    return numbered.select(*FIELDS[:-2], step_group(by_length, groups).alias("step_group"))
