"""Removal of passages that repeat across documents, by merging Burrows-Wheeler transforms of shards.

Every string of `width` bytes has an anchor: the least of its inner 24-byte strings by hash, the first of equal ones.
Strings that are equal have equal anchors at equal places, so runs of strings with one anchor (segments) can be dealt out
by the anchor, and a string is only ever held against those of its own anchor.

0. Of a group of equal texts only that of the least doc_id takes part; the others are removed whole.
1. Anchors that occur once are dropped: tasks send 32-bit hashes by bucket and get back one bit per anchor.
2. Segments of the others go out by anchor, each distinct one once per task with its least doc_id. Anchors of very many
   occurrences are cut into single strings and dealt by the whole string, so that no key gathers more rows than tasks.
3. In a bucket equal segments of all tasks collapse; anchors left with one segment are settled. For the rest, shards of
   segments (by the task they come from) get a Burrows-Wheeler transform each, over bytes with the anchor as one letter.
   The transforms are merged by refining their interleave: each iteration sorts the merged order stably by the letters
   before it, which extends the sorted context, and marks where common prefixes end. No suffix is sorted again. After
   as many letters as a string has, the blocks between marks are the repeated strings; each gets its least doc_id.
4. Every occurrence whose string starts in a document of a smaller doc_id is covered; spans merge per document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked, pick, saved, slices, tidy

ANCHOR = 24
U64 = np.uint64
#: Windows of a document that are searched at once, and occurrences above which an anchor's segments are cut up.
BLOCK, HOT = 1 << 19, 4096


def mix(h: np.ndarray) -> np.ndarray:
    h = h * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(32)
    return h


def remix(h: np.ndarray) -> np.ndarray:
    return mix(mix(h ^ U64(0x5851F42D4C957F2D)))


def pieces(body: bytes, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text cut into blocks of windows: where each starts, and its bytes."""
    a = np.frombuffer(body, np.uint8)
    for at in range(0, max(len(a) - width + 1, 0), BLOCK):
        yield at, a[at : at + BLOCK + width - 1]


def runs(found: list[np.ndarray], width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: piece, start in it, anchor's place from there, number of windows, anchor's hash."""
    size = np.array([len(x) for x in found])
    begin = np.cumsum(size) - size
    buf = np.concatenate(found)
    h = mix(buf.astype(U64) + U64(1))
    for step in (1, 2, 4, 8):
        h = mix(h[:-step] * U64(31) + h[step:])
        if step == 4:
            eight = h
    h = mix(h[:-8] * U64(31) + eight[16:])
    key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    window = width - ANCHOR + 1
    least, step = key, 1
    while 2 * step <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < window:
        least = np.minimum(least[: -(window - step)], least[window - step :])
    at = (least & U64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + size - width + 1, -1)
    valid = np.cumsum(edge[: len(at)]) > 0
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (at[1:] == at[:-1]))
    # A piece's first window starts a run, whatever lies before.
    new[begin] = True
    places = np.flatnonzero(valid)
    first = np.flatnonzero(new[places])
    start = places[first]
    piece = np.searchsorted(begin, start, "right") - 1
    return piece, start - begin[piece], at[start] - start, np.diff(np.append(first, len(places))), h[at[start]]


def all_runs(bodies: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """runs() of many texts, in order: text, start in it, anchor's place, number of windows, anchor's hash."""
    out: list[tuple] = []
    held: list[tuple[int, int, np.ndarray]] = []

    def go() -> None:
        if held:
            piece, start, off, n, h = runs([x for _, _, x in held], width)
            out.append((np.array([i for i, _, _ in held])[piece], start + np.array([a for _, a, _ in held])[piece], off, n, h))
            held.clear()

    size = 0
    for i, body in enumerate(bodies):
        for at, x in pieces(body, width):
            held.append((i, at, x))
            size += len(x)
            if size >= BLOCK:
                go()
                size = 0
    go()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def bodies_of(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("_text").to_pylist()]


# ---- 1: which anchors occur more than once


def anchor_blobs(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Per run of rows (slice) and bucket the anchors' 32-bit hashes; at bucket -1 the slice's rows and their anchors' buckets.

    Both come from one pass and are written before use: a slice is only known by its place in the task that made it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = -1
        for batch in slices(batches, "_text", 4 << 20):
            if number < 0:
                number = batch.column("_part")[0].as_py() << 32
            text, _, _, _, h = all_runs(bodies_of(batch), width)
            g = remix(h)
            bucket = (g >> U64(32)) % U64(buckets)
            rows, ids = (np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("_row", "_doc"))
            n = np.bincount(text, minlength=len(rows))
            held = rows.tobytes() + ids.tobytes() + n.astype(np.int64).tobytes() + bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32).tobytes()
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            keys, b = (g & U64(0xFFFFFFFF)).astype(np.uint32)[order], bucket[order]
            cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
            parts = [x.tobytes() for x in np.split(keys, cut[1:])] if len(cut) else []
            yield pa.RecordBatch.from_arrays([pa.array([number] * (len(cut) + 1), pa.int64()), pa.array([-1, *b[cut].tolist()], pa.int64()), pa.array([zlib.compress(held, 1), *parts], pa.binary())], names=["slice", "bucket", "blob"])
            number += 1

    return docs.withColumn("_part", F.spark_partition_id()).mapInArrow(tidy(run), "slice long, bucket long, blob binary")


def shared_bits(table: pa.Table) -> pa.Table:
    """For the anchors of a bucket: 1 where the hash occurs again, 2 more where it occurs very often."""
    blobs = [np.frombuffer(x, np.uint32) for x in table.column("blob").to_pylist()]
    keys = np.concatenate(blobs)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    n = np.diff(np.append(first, len(s)))
    bits = np.empty(len(keys), np.uint8)
    bits[order] = np.repeat((n > 1).astype(np.uint8) + 2 * (n > HOT).astype(np.uint8), n)
    parts = np.split(bits, np.cumsum([len(x) for x in blobs])[:-1])
    return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "blob": pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())})


def row_bits(table: pa.Table, buckets: int) -> pa.Table:
    """Per row of a slice the bits of its anchors in order, where any is set."""
    blobs = {b: zlib.decompress(x) for b, x in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True)}
    raw = blobs.pop(-1)
    total = len(raw)
    # rows, ids and counts (8 bytes each), then 2 or 4 bytes per anchor.
    per = sum(map(len, blobs.values()))
    wide = 2 if buckets <= 1 << 16 else 4
    n_rows = (total - wide * per) // 24
    rows, ids, counts = (np.frombuffer(raw, np.int64, n_rows, 8 * i * n_rows) for i in range(3))
    bucket = np.frombuffer(raw, np.uint16 if wide == 2 else np.uint32, per, 24 * n_rows)
    bits = np.zeros(per, np.uint8)
    order = np.argsort(bucket, kind="stable")
    if per:
        bits[order] = np.concatenate([np.frombuffer(blobs[b], np.uint8) for b in sorted(blobs)])
    parts = np.split(bits, np.cumsum(counts)[:-1])
    keep = [i for i, x in enumerate(parts) if x.any()]
    return pa.table({"_row": pa.array(rows[keep], pa.int64()), "_doc": pa.array(ids[keep], pa.int64()), "bits": pa.array([parts[i].tobytes() for i in keep], pa.binary())})


# ---- 2: segments


def padded(text: np.ndarray, start: np.ndarray, length: np.ndarray, tail: list[np.ndarray], most: int) -> np.ndarray:
    """Rows of bytes with zeros behind and the tail columns at the end, as 64-bit words."""
    wide = -(-(most + len(tail)) // 8) * 8
    out = np.zeros((len(start), wide), np.uint8)
    for lo in range(0, len(start), 8192):  # the places of all bytes at once would take eight times the bytes
        inside = np.arange(most) < length[lo : lo + 8192, None]
        out[lo : lo + 8192, :most][inside] = text[(start[lo : lo + 8192, None] + np.arange(most))[inside]]
    for i, x in enumerate(tail):
        out[:, wide - 1 - i] = x
    return out.view(U64)


def anchor_hashes(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The hashes that runs() gives to the anchors of these segments."""
    h = mix(raw[np.arange(len(raw))[:, None], off[:, None] + np.arange(ANCHOR)].astype(U64) + U64(1))
    for step in (1, 2, 4, 8):
        h = mix(h[:, :-step] * U64(31) + h[:, step:])
        if step == 4:
            eight = h
    return mix(h[:, 0] * U64(31) + eight[:, 16])


def distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row and inverse of the distinct rows, and a hash of each; rows are compared by 128 bits."""
    a, b = np.zeros(len(words), U64), np.full(len(words), 7, U64)
    for i in range(words.shape[1]):
        a, b = mix((a ^ words[:, i]) + U64(i + 1)), mix(b * U64(0xD1342543DE82EF95) + words[:, i])
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    new = np.append(True, (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])) if len(order) else np.zeros(0, bool)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse, sa[new]


def segment_blobs(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Per slice of rows: (slice, bucket, segs, occ) of its segments, and its rows at bucket -1."""
    most = 2 * width - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = -1
        for batch in slices(batches, "_text", 8 << 20):
            if number < 0:
                number = batch.column("_part")[0].as_py() << 32
            bodies = bodies_of(batch)
            rows = np.array(batch.column("_row").to_numpy(zero_copy_only=False))
            docs_ = np.array(batch.column("_doc").to_numpy(zero_copy_only=False))
            text, start, off, n, h = all_runs(bodies, width)
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8)
            hot = np.flatnonzero(bits == 3)
            plain = np.flatnonzero(bits == 1)
            single = np.repeat(hot, n[hot])
            shift = np.arange(len(single)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            take = np.concatenate([plain, single])
            moved = np.concatenate([np.zeros(len(plain), np.int64), shift])
            count = np.concatenate([n[plain], np.ones(len(single), np.int64)])
            text, start, off, h = text[take], start[take] + moved, off[take] - moved, h[take]
            size = np.array([len(x) for x in bodies], np.int64)
            base = np.cumsum(size) - size
            joined = np.frombuffer(b"".join(bodies), np.uint8)
            length = count + width - 1
            words = padded(joined, base[text] + start, length, [length.astype(np.uint8), off.astype(np.uint8)], most)
            firsts, seg, sums = distinct(words)
            least = np.full(len(firsts), np.iinfo(np.int64).max)
            np.minimum.at(least, seg, docs_[text])
            is_hot = firsts >= len(plain)
            key = np.where(is_hot, sums, h[firsts]) if len(firsts) else np.zeros(0, U64)
            bucket = ((remix(key) >> U64(32)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # segments by bucket
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            b = bucket[order]
            cut = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else np.zeros(1, int)
            raw = words[firsts[order]].view(np.uint8)
            where = place[seg]
            by = np.argsort(where, kind="stable")
            limits = np.searchsorted(where[by], cut)
            out: list[tuple] = [(number, -1, b"", rows.tobytes() + docs_.tobytes())]
            for i in range(len(cut) - 1):
                lo, hi = cut[i], cut[i + 1]
                f = firsts[order[lo:hi]]
                ln = length[f]
                flat = raw[lo:hi, :most][np.arange(most) < ln[:, None]].tobytes()
                marked = off[f] + 128 * is_hot[order[lo:hi]]
                head = np.int64(hi - lo).tobytes() + least[order[lo:hi]].tobytes() + ln.astype(np.uint8).tobytes() + marked.astype(np.uint8).tobytes()
                o = by[limits[i] : limits[i + 1]]
                occ = (where[o] - lo).astype(np.uint32).tobytes() + text[o].astype(np.uint32).tobytes() + start[o].astype(np.uint32).tobytes()
                out.append((number, int(b[lo]), zlib.compress(head + flat, 3), zlib.compress(occ, 3)))
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slice", "bucket", "segs", "occ"])

    return docs.withColumn("_part", F.spark_partition_id()).mapInArrow(tidy(run), "slice long, bucket long, segs binary, occ binary")


# ---- 3: merging transforms


class Shard:
    """The Burrows-Wheeler transform of some strings (each a cycle with an end letter, 0): rows in the order of the
    first `depth` letters, the letters before each row, and the row of the string that starts one letter earlier."""

    def __init__(self, strings: np.ndarray, depth: int) -> None:
        n, wide = strings.shape
        size = (strings > 0).sum(1) + 1
        inside = np.arange(wide) < size[:, None]
        self.owner, self.at = np.nonzero(inside)
        self.size = size
        begin = np.cumsum(size) - size
        origin, period = begin[self.owner], size[self.owner]
        later = lambda i: origin + (self.at + i) % period
        letters = strings[self.owner, self.at]
        # Rows are ranked by up to four letters, then by twice as many each time, from the ranks of two places.
        known = min(4, depth)
        key = np.zeros(len(letters), U64)
        for i in range(known):
            key = (key << U64(16)) | letters[later(i)]
        order = np.argsort(key)
        while known < depth:
            s = key[order]
            ranks = np.empty(len(order), U64)
            ranks[order] = np.cumsum(np.append(False, s[1:] != s[:-1]))[: len(order)]
            more = min(known, depth - known)
            key = (ranks << U64(32)) | ranks[later(more)]
            order = np.argsort(key)
            known += more
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        back = later(-1)
        self.letter = letters[back][order]
        self.earlier = rank[back][order]
        self.owner, self.at = self.owner[order], self.at[order]


def merged_blocks(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged order of all shards' rows by their first `depth` letters, as (shard, row, block): rows of one block
    share these letters. The interleave starts as one shard after the other and is refined two letters a time."""
    size = [len(s.letter) for s in shards]
    base = np.cumsum([0, *size[:-1]])
    letter = np.concatenate([s.letter for s in shards]).astype(np.uint32)
    earlier = np.concatenate([s.earlier + b for s, b in zip(shards, base, strict=True)]).astype(np.int32)
    pairs = (letter[earlier] << np.uint32(16)) | letter
    values, two = np.unique(pairs, return_inverse=True)
    two = two.astype(np.uint16) if len(values) <= 1 << 16 else two.astype(np.uint32)
    steps = [(letter.astype(np.uint16), earlier)] * (depth % 2) + [(two, earlier[earlier])] * (depth // 2)
    rows = np.arange(len(letter), dtype=np.int32)
    block = np.zeros(len(letter), np.int32)
    for code, back in steps:
        c = code[rows]
        order = np.argsort(c, kind="stable")
        c, block = c[order], block[order]
        new = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.append(np.int32(0), np.cumsum(new, dtype=np.int32))
        rows = back[rows[order]]
    which = np.searchsorted(base, rows, "right") - 1
    return which, rows - base[which], block


def least_docs(anchor: np.ndarray, least: np.ndarray, length: np.ndarray, off: np.ndarray, raw: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
    """For distinct segments (rows of raw bytes): per window the least doc_id that has the string."""
    most = raw.shape[1]
    windows = width - ANCHOR + 1
    out = np.repeat(least[:, None], windows, axis=1)
    _, letter = np.unique(anchor, return_inverse=True)
    strings = np.zeros((len(anchor), most - ANCHOR + 2), np.uint16)
    column = np.arange(strings.shape[1])
    body = length - ANCHOR + 1
    source = np.where(column <= off[:, None], column, column + ANCHOR - 1)
    strings[:] = raw[np.arange(len(raw))[:, None], np.minimum(source, most - 1)].astype(np.uint16) + 1
    strings[np.arange(len(raw)), off] = 257 + letter
    strings[column >= body[:, None]] = 0
    names = np.unique(shard)
    at = [np.flatnonzero(shard == s) for s in names]
    shards = [Shard(strings[i], windows) for i in at]
    which, row, block = merged_blocks(shards, windows)
    owner = np.empty(len(row), np.int64)
    place = np.empty(len(row), np.int64)
    for k, (s, i) in enumerate(zip(shards, at, strict=True)):
        mine = which == k
        owner[mine], place[mine] = i[s.owner[row[mine]]], s.at[row[mine]]
    valid = np.flatnonzero(place <= length[owner] - width)
    owner, place, block = owner[valid], place[valid], block[valid]
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    best = np.minimum.reduceat(least[owner], first)
    out[owner, place] = np.repeat(best, np.diff(np.append(first, len(block))))
    return out


def merge_bucket(width: int, shards: int, letters: int = 1 << 20):
    most = 2 * width - ANCHOR
    windows = width - ANCHOR + 1

    def run(table: pa.Table) -> pa.Table:
        got = []
        for k, blob in enumerate(table.column("segs").to_pylist()):
            blob = zlib.decompress(blob)
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            ln = np.frombuffer(blob, np.uint8, n, 8 + 8 * n)
            raw = np.zeros((n, most), np.uint8)
            raw[np.arange(most) < ln[:, None]] = np.frombuffer(blob, np.uint8, -1, 8 + 10 * n)
            got.append((np.frombuffer(blob, np.int64, n, 8), ln.astype(np.int64), np.frombuffer(blob, np.uint8, n, 8 + 9 * n), raw, np.full(n, k)))
        least, length, marked, raw, origin = map(np.concatenate, zip(*got, strict=True))
        off, is_hot = (marked & 127).astype(np.int64), marked > 127
        words = np.zeros((len(least), -(-(most + 2) // 8) * 8), np.uint8)
        words[:, :most], words[:, -1], words[:, -2] = raw, length, off
        first, inverse, sums = distinct(words.view(U64))
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, inverse, least)
        length, off, raw, origin, is_hot, lengths = length[first], off[first], raw[first], origin[first], is_hot[first], length
        key = np.where(is_hot, sums, anchor_hashes(raw, off))
        order = np.argsort(key, kind="stable")
        k = key[order]
        begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        n = np.diff(np.append(begin, len(k)))
        out = np.repeat(low[:, None], windows, axis=1)
        # Groups with several segments, whole groups at a time up to about `letters` letters and the letters of 16 bits.
        many = np.repeat(n > 1, n)
        todo = order[many]
        group = np.repeat(np.arange(len(n)), n)[many]
        weight = np.cumsum(length[todo] - ANCHOR + 2)
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)) if len(group) else []
        lo, groups = 0, 0
        for hi in ends:
            groups += 1
            if hi == len(todo) or weight[hi - 1] - weight[lo] > letters or groups >= 60_000:
                i = todo[lo:hi]
                out[i] = least_docs(key[i], low[i], length[i], off[i], raw[i], origin[i] % shards, width)
                lo, groups = hi, 0
        # Per segment one value where all windows agree, else one per window.
        full, count = out[inverse], lengths - width + 1
        one = ((full == full[:, :1]) | (np.arange(windows) >= count[:, None])).all(1)
        blobs, lo = [], 0
        for x in got:
            hi = lo + len(x[0])
            told = np.where(one[lo:hi], 1, count[lo:hi])
            blobs.append(zlib.compress(told.astype(np.uint8).tobytes() + count[lo:hi].astype(np.uint8).tobytes() + full[lo:hi][np.arange(windows) < told[:, None]].tobytes(), 1))
            lo = hi
        return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "segs": pa.array(blobs, pa.binary()), "occ": pa.nulls(len(blobs), pa.binary())})

    return run


# ---- 4: spans


def merged_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of half-open spans per row; spans that touch become one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + row * big)
    new = np.append(True, start[1:] + row[1:] * big > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1] - row[at] * big


def slice_spans(width: int):
    def run(table: pa.Table) -> pa.Table:
        rows = docs = None
        occ, result = {}, {}
        for b, segs, o in zip(*(table.column(c).to_pylist() for c in ("bucket", "segs", "occ")), strict=True):
            if b == -1:
                rows, docs = np.split(np.frombuffer(o, np.int64), 2)
            elif o is None:
                result[b] = zlib.decompress(segs)
            else:
                occ[b] = zlib.decompress(o)
        spans = [np.zeros((3, 0), np.int64)]
        for b, raw in occ.items():
            m = len(raw) // 12
            seg, text, start = np.frombuffer(raw, np.uint32, m), *(np.frombuffer(raw, np.uint32, m, i * m).astype(np.int64) for i in (4, 8))
            got = result[b]
            # told and count, a byte each per segment, then 8 bytes per told value.
            n = int(seg.max()) + 1
            told = np.frombuffer(got, np.uint8, n).astype(np.int64)
            count = np.frombuffer(got, np.uint8, n, n).astype(np.int64)
            values = np.frombuffer(got, np.int64, int(told.sum()), 2 * n)
            base = np.cumsum(told) - told
            one = told[seg] == 1
            hit = np.flatnonzero(one & (values[base[seg]] < docs[text]))
            spans.append(np.stack([text[hit], start[hit], start[hit] + count[seg[hit]] + width - 1]))
            rest = np.flatnonzero(~one)
            k = told[seg[rest]]
            each = np.repeat(rest, k)
            i = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
            hit = values[base[seg[each]] + i] < docs[text[each]]
            each, i = each[hit], i[hit]
            spans.append(np.stack([text[each], start[each] + i, start[each] + i + width]))
        text, start, end = merged_spans(*np.concatenate(spans, axis=1))
        cut = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, int)
        both = [np.split(x, cut[1:]) if len(cut) else [] for x in (start, end)]
        return pa.table({"_row": pa.array(rows[text[cut]] if len(cut) else [], pa.int64()), "_doc": pa.array(docs[text[cut]] if len(cut) else [], pa.int64()), **{c: pa.array(x, pa.list_(pa.int64())) for c, x in zip(("starts", "ends"), both, strict=True)}})

    return run


def later_copies(docs: DataFrame, width: int) -> DataFrame:
    """_row, _doc, n of the rows whose whole text of n bytes is that of a smaller doc_id: all their strings start there too."""
    own = docs.where(F.octet_length("_text") >= width).select("_row", "_doc", F.octet_length("_text").alias("n"), F.md5("_text").alias("digest"))
    first = own.groupBy("digest").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).where("first < last")
    return saved(own.join(first, "digest").where("_doc > first").select("_row", "_doc", "n").distinct(), "copies")


#: A row is known by a 64-bit hash of its id and text, and by its id.
ROW = ["_row", "_doc"]


def repeated_spans(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """_row, _doc, starts, ends of the byte spans to remove; docs: _row, _doc, _text (binary)."""
    copies = later_copies(docs, width)
    total = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(16, total // (8 << 20))
    blobs = saved(anchor_blobs(docs, width, buckets), "anchors")
    bits = blobs.where("bucket >= 0").groupBy("bucket").applyInArrow(tidy_table(shared_bits), "slice long, bucket long, blob binary")
    rows = bits.unionByName(blobs.where("bucket = -1")).groupBy("slice").applyInArrow(lambda t: row_bits(t, buckets), "_row long, _doc long, bits binary").dropDuplicates(ROW).join(copies, ROW, "left_anti")
    segments = saved(segment_blobs(docs.join(rows, ROW).select("_row", "_doc", "_text", "bits"), width, buckets), "segments", (blobs,), last=True)
    merged = segments.where("bucket >= 0").select("slice", "bucket", "segs").groupBy("bucket").applyInArrow(tidy_table(merge_bucket(width, shards)), "slice long, bucket long, segs binary, occ binary")
    # segments keep their occurrences here; what was sent to the buckets stays behind.
    held = segments.select("slice", "bucket", F.lit(None).cast("binary").alias("segs"), "occ")
    spans = held.unionByName(merged).groupBy("slice").applyInArrow(slice_spans(width), "_row long, _doc long, starts array<long>, ends array<long>").dropDuplicates(ROW)
    whole = copies.select(*ROW, F.array(F.lit(0).cast("long")).alias("starts"), F.array(F.col("n").cast("long")).alias("ends"))
    return saved(spans.unionByName(whole), "spans", (segments, copies), last=True)


def tidy_table(run):
    """run on a table, with the memory of its arrays given back afterwards."""

    def go(table: pa.Table) -> pa.Table:
        out = run(table)
        for _ in tidy(lambda x: x)(iter(())):
            pass
        return out

    return go


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (_row, _doc and others) with starts and ends, null for rows without spans.

    Rows that surely have none stay where they are; only the rest of the texts meets its spans by a shuffle.
    """
    both = marked(docs, "_row", spans.select("_row"))
    none = F.lit(None).cast("array<long>")
    return both.where("_maybe").drop("_maybe").join(spans, ROW, "left").unionByName(both.where("not _maybe").drop("_maybe").withColumns({"starts": none, "ends": none}))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return pick(docs, _doc=key, _text=text).select(*named("_doc", "_text"))


def named(key: str, text: str) -> list[Column]:
    """_row, _doc, _text (binary) of a row; a null id comes after all others."""
    doc = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(2**63 - 1))
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    return [F.xxhash64(doc, body).alias("_row"), doc.alias("_doc"), body.alias("_text")]


def kept_bytes(body: bytes, starts: list[int] | None, ends: list[int] | None) -> bytes:
    if not starts:
        return body
    edges = [0, *(x for pair in zip(starts, ends, strict=True) for x in pair), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removal_digests(docs: DataFrame, width: int = 50, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    A null text is empty; texts under `width` bytes have no string and stay whole. Rows of one doc_id never remove from
    each other. A null doc_id counts as greater than all others (null rows don't remove from each other either) and is
    returned as null. An empty table gives no rows; further columns are ignored.
    """
    own = keyed(docs, key, text)
    spans = repeated_spans(own, width, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, body, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_text", "starts", "ends")), strict=True):
                kept = kept_bytes(body, starts, ends)
                out.append((None if doc == 2**63 - 1 else doc, len(body), len(body) - len(kept), len(starts or ()), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = with_spans(own, spans).select("_doc", "_text", "starts", "ends")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 50, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes gone from its text; parts of characters at cuts go too.

    A null text stays null, an empty one empty; texts of any length are taken whole; rows of one doc_id never remove from
    each other; a null doc_id counts as greater than all others. Repeated rows all stay, cut alike. An empty table stays
    empty; further columns are kept as they are, whatever their names.
    """
    spans = repeated_spans(keyed(docs, key, text), width, shards)

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([kept_bytes(b, None if s is None else list(s), None if e is None else list(e)).decode("utf-8", "ignore") for b, s, e in zip(bodies, starts, ends, strict=True)], dtype=object)

    others = [c for c in docs.columns if c != text]
    rest = F.struct(F.col(f"`{text}`").isNull().alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("_rest")
    joined = with_spans(docs.select(*named(key, text), rest), spans)
    told = F.when(~F.col("_rest.none"), F.when(F.col("starts").isNull(), F.col("_text").cast("string")).otherwise(F.col("_cut")))
    done = joined.where("starts is null").withColumn("_cut", F.lit(None).cast("string")).unionByName(joined.where("starts is not null").withColumn("_cut", cut("_text", "starts", "ends")))
    return done.select(*(told.alias(c) if c == text else F.col(f"_rest.c{others.index(c)}").alias(c) for c in docs.columns))
