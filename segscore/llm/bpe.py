"""BPE as a deterministic automaton over tokens.

Compilation takes the merges in order, one gadget each. The states are what the last token leaves possible, so a state is
named by its token; at first every byte follows every byte. The gadget of a merge (u, v) -> w removes the arc v behind u
(so u v can't be read where w exists), gives every state that has an arc u an arc w, and lets w leave what v left. So the
arc t behind s exists if, unrolled to the time when the younger of the two was made, its parent's arc did, and no gadget
removed it. The gadgets are kept as tables (both parts of each token, the token of each removed pair); arcs are read off
them and kept in a transition table as they are first needed, the way a large automaton is determinised lazily.

A word has exactly one accepted path: the tokens that BPE gives; so has each of its prefixes. Read byte by byte, the
automaton over tokens becomes a deterministic one over bytes: a state holds the token that ended last and the labels still
open, each behind the token it would follow. Its table maps (state, byte) to a state; a row's entry is made when a word
first asks for it, by one step of the subset construction. Encoding runs once over the bytes by the table, notes which
token ends at each, and reads the path off from the end; nothing is tried twice. Decoding emits the arcs' labels, the
tokens' bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, texts, tidy

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies name bytes: printable ones are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The automaton of a byte-level BPE vocabulary (a tokenizers JSON file)."""

    #: Arcs kept at most; beyond it they are read off the gadgets again.
    KEPT = 1_000_000
    #: States of the byte table kept at most; beyond it the table starts anew from the state it is in.
    STATES = 150_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = told["model"]["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        # Tokens are numbered by age while compiling: bytes first, then one per merge.
        self.age: dict[int, int] = {}
        self.parts: list[tuple[int, int] | None] = []
        self.ids: list[int] = []
        self.removed: dict[tuple[int, int], int] = {}
        for c in letters:
            self.state(vocab[c], None)
        for merge in told["model"]["merges"]:
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            self.gadget(vocab[u], vocab[v], vocab[u + v])
        self.arcs: dict[tuple[int, int], bool] = {}
        self.sizes = [len(self.labels[i]) for i in self.ids]
        # The labels as a tree: (node, byte) to node, the token whose label ends at a node, and whether longer labels pass it.
        self.tree: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.passed: list[bool] = [True]
        for a, i in enumerate(self.ids):
            self.grow(self.labels[i], a)
        # The byte table: (state, byte) to state; a state's open labels; the token that ended on entering it.
        self.table: dict[int, int] = {}
        self.numbers: dict[tuple[tuple[int, int], ...], int] = {}
        self.opened: list[tuple[tuple[int, int], ...]] = []
        self.last: list[int] = []
        self.start = self.number(((-1, 0),))
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.labels |= {i: t.encode() for t, i in self.special.items()}

    def state(self, token: int, parts: tuple[int, int] | None) -> int:
        self.age[token] = len(self.ids)
        self.ids.append(token)
        self.parts.append(parts)
        return len(self.ids) - 1

    def gadget(self, u: int, v: int, w: int) -> None:
        """One merge: the arc v behind u goes, w comes. A token that two merges make keeps its first state."""
        pair = self.age[u], self.age[v]
        self.removed.setdefault(pair, self.age[w] if w in self.age else self.state(w, pair))

    def arc(self, s: int, t: int) -> bool:
        """Whether t may follow s, by undoing gadgets from the youngest on."""
        key = s, t
        if (known := self.arcs.get(key)) is not None:
            return known
        # Until `limit`, no gadget can have touched the arc between the parts that now face each other.
        limit, ok = len(self.ids), True
        while True:
            if (gone := self.removed.get((s, t))) is not None and gone < limit:
                ok = False
                break
            # w = u v leaves what v left, from w's making on; the arc w exists where the arc u did then.
            if s > t:
                if self.parts[s] is None:
                    break
                limit, s = min(limit, s), self.parts[s][1]
            else:
                if self.parts[t] is None:
                    break
                # At t's own making the state s may be t's left part itself (u == v): that arc went with the same gadget.
                limit, t = min(limit, t + 1), self.parts[t][0]
        if len(self.arcs) >= self.KEPT:
            self.arcs.clear()
        self.arcs[key] = ok
        return ok

    def grow(self, label: bytes, token: int) -> None:
        node = 0
        for byte in label:
            self.passed[node] = True
            to = self.tree.get(node << 8 | byte)
            if to is None:
                to = self.tree[node << 8 | byte] = len(self.ends)
                self.ends.append(-1)
                self.passed.append(False)
            node = to
        self.ends[node] = token

    def number(self, opened: tuple[tuple[int, int], ...]) -> int:
        """The state of these open labels; the last of them is none yet, behind the token that just ended."""
        if (found := self.numbers.get(opened)) is None:
            found = self.numbers[opened] = len(self.opened)
            self.opened.append(opened)
            self.last.append(opened[-1][0])
        return found

    def step(self, state: int, byte: int) -> int:
        """One entry of the table: all open labels move on by the byte; the one that may end here does (there is one only)."""
        opened, ended = [], -1
        for s, node in self.opened[state]:
            to = self.tree.get(node << 8 | byte)
            if to is None:
                continue
            if ended < 0 and (token := self.ends[to]) >= 0 and (s < 0 or self.arc(s, token)):
                ended = token
            if self.passed[to]:
                opened.append((s, to))
        if len(self.opened) >= self.STATES:
            here = self.opened[state]
            self.table.clear()
            self.numbers.clear()
            self.opened.clear()
            self.last.clear()
            self.start = self.number(((-1, 0),))
            state = self.number(here)
        to = self.table[state << 8 | byte] = self.number((*opened, (ended, 0)))
        return to

    def encode(self, word: bytes) -> list[int]:
        """The ids along the one accepted path of the word."""
        table, last, state = self.table, self.last, self.start
        ended: list[int] = []
        for byte in word:
            to = table.get(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
            ended.append(last[state])
        path, at = [], len(word)
        while at:
            token = ended[at - 1]
            path.append(self.ids[token])
            at -= self.sizes[token]
        return path[::-1]

    def decode(self, ids: list[int]) -> str:
        """The labels along a path, as text; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Memo(dict):
    """make(key), kept in two generations: what is in use moves to the younger one, the older is dropped when that is full."""

    def __init__(self, make: Callable, most: int, longest: int) -> None:
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Whole texts to ids: special tokens, pre-split words, the automaton, and bounded memos of chunks and of words."""

    def __init__(self, path: str, pattern: str, memo: int = 250_000, longest: int = 64) -> None:
        import regex

        self.automaton = Automaton(path)
        self.words = regex.compile(pattern)
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.spaced = regex.compile(r"\s ")
        self.word = Memo(lambda w: tuple(self.automaton.encode(w.encode())), memo, longest)
        self.known = Memo(self.chunk, memo, longest)

    def chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(i for w in self.words.findall(chunk) for i in self.word[w])

    def chunks(self, text: str) -> list[str]:
        """Words never cross a space that a visible character precedes, so the text is cut before those."""
        if self.spaced.search(text):
            return self.words.findall(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.chunks(text))))

    def encode(self, text: str) -> list[int]:
        if self.special is None or not any(map(text.__contains__, self.automaton.special)):
            return self.plain(text)
        out: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.automaton.special[part]] if i % 2 else self.plain(part)
        return out


def encode_documents(docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with ids also the ids themselves.

    A null or empty text has no tokens (the digests are those of the empty string). Repeated rows and null keys are
    encoded like any row; an empty table gives no rows; further columns are ignored. Texts stream through each task; a
    text of any length is encoded whole.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, pattern)
        decimal = {i: str(i) for i in encoder.automaton.labels}
        for batch in slices(batches, "_text"):
            rows = []
            for doc, body in zip(batch.column("_key").to_pylist(), texts(batch, "_text"), strict=True):
                found = encoder.encode(body)
                told = ",".join(map(decimal.__getitem__, found)).encode()
                back = encoder.automaton.decode(found).encode()
                rows.append((doc, len(found), hashlib.sha256(told).hexdigest(), hashlib.sha256(back).hexdigest(), *([found] * ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pick(docs, _key=key, _text=text).withColumn("_key", F.col("_key").cast("long")).mapInArrow(tidy(run), ENCODED + ", ids array<int>" * ids)


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids are the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([automaton.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
