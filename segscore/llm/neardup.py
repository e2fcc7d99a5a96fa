"""Near-duplicates by DartMinHash signatures and banded joining.

A document is the multiset of its runs of five words. Every element (a run, its weight the number of times it occurs) is
a region, weight wide and unbounded in rank. Darts fall into regions as a Poisson process that hashes decide, so two
documents see the same darts where their regions overlap. A document takes the darts of a rank below a bound that gives
it enough of them, whatever its length; each dart belongs to one coordinate by its hash, and the earliest of each
coordinate is the signature. Coordinates of two documents agree with the probability of their weighted Jaccard likeness.

Bands of coordinates are joined on equality. In a band's group every document is paired with the least and the greatest
one only, never all with all, and the pairs are held against the exact likeness. Where a group of four or more is left
with several components, its members meet in blocks of bounded bytes: an exact prefix filter over the elements, rare ones
first, finds every pair across components that can reach the likeness; these are tested there, and only links that join
components leave the block. So every pair of a likeness of 0.8 that shares a band ends in one class.

Equal texts are one node, named by a number of its own; texts are told apart by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import marked, maybe_in, pick, saved, slices, texts, tidy
from .graph import components

#: 24 bands of 5: a pair of likeness 0.8 shares a band with probability 0.99993.
BANDS, ROWS = 24, 5
#: Bytes of elements in a block of a band's group.
BLOCK = 16 << 20
#: Words whose hashes a task keeps.
MEMO = 200_000


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of 64-bit values."""
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def run_hashes(bodies: list[str], known: dict[bytes, int], width: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its runs of `width` words; shorter texts are one run, empty ones have none."""
    out = []
    if len(known) > MEMO:
        known.clear()
    for body in bodies:
        words = body.encode().split()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(len(ids) - width + 1, min(len(ids), 1))
        h = np.zeros(n, np.uint64)
        for i in range(min(width, len(ids))):
            h = mixed(h + ids[i : i + n], i + 1)
        h.sort()
        out.append(h)
    return out


def weighted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of a sorted array, and how often each occurs."""
    first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    if first.all():
        return h, np.ones(len(h))
    at = np.flatnonzero(first)
    return h[at], np.diff(np.append(at, len(h))).astype(float)


def unit_cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each region cut into cells of weight 1 (the last may be narrower): the cells' hashes and widths."""
    if (weights == 1).all():
        return mixed(elements, 0), weights
    count = np.ceil(weights).astype(np.int64)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return mixed(np.repeat(elements, count) + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 0), np.minimum(1.0, np.repeat(weights, count) - number)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A row of k coordinates for each non-empty weighted set."""
    cut = [unit_cells(e, w) for e, w in sets]
    norm = np.array([w.sum() for _, w in cut])
    cells, width = np.concatenate([c for c, _ in cut]), np.concatenate([w for _, w in cut])
    owner = np.repeat(np.arange(len(sets)), [len(c) for c, _ in cut])
    sig = np.zeros((len(sets), k), np.uint64)
    todo = np.ones(len(sets), bool)
    bound = k * (np.log(k) + 3) / norm
    narrow = bool((width < 1).any())
    while todo.any():
        best = np.full(len(sets) * k, np.inf)
        active = np.flatnonzero(todo[owner])
        rank, number = np.zeros(len(active)), 0
        while len(active):
            number += 1
            h = mixed(cells[active], 2 * number)
            rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            below = rank <= bound[owner[active]]
            active, rank = active[below], rank[below]
            dart = mixed(cells[active], 2 * number + 1)
            hit = np.arange(len(active))
            if narrow:  # where in the cell the dart falls
                hit = np.flatnonzero((mixed(dart, 5) >> np.uint64(11)).astype(float) * 2.0**-53 < width[active])
            at = owner[active[hit]] * k + ((dart[hit] >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, at, rank[hit])
            first = rank[hit] == best[at]  # the earliest so far; a later round may bring an earlier one from another cell
            sig.reshape(-1)[at[first]] = dart[hit[first]]
        todo &= np.isinf(best).reshape(len(sets), k).any(axis=1)  # a coordinate without a dart: throw further out
        bound[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        h = mixed(h + sig.reshape(len(sig), bands, rows)[:, :, i], i + 1)
    return h.view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """doc_id, digest, n (elements), keys (a hash per band; none for empty texts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, "_text", 4 << 20):
            found = run_hashes(texts(batch, "_text"), known, width)
            full = [i for i, h in enumerate(found) if len(h)]
            keys: list = [[] for _ in found]
            if full:
                for i, row in zip(full, band_keys(signatures([weighted(found[i]) for i in full], bands * rows), bands, rows), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("digest"), pa.array([len(h) for h in found], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return docs.select("_key", "digest", "_text").mapInArrow(tidy(run), "doc_id long, digest binary, n long, keys array<long>")


def element_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, elements: the sorted runs as 64-bit hashes, repeated ones made distinct by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, "_text", 1 << 20):
            sets = [np.sort(unit_cells(*weighted(h))[0]).tobytes() for h in run_hashes(texts(batch, "_text"), known, width)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "elements"])

    return docs.select("node", "_text").mapInArrow(tidy(run), "node long, elements binary")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard likeness of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left, right = (sets.select(F.col("node").alias(k), F.col("elements").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def prefix_size(n: np.ndarray, least: float) -> np.ndarray:
    """Sets of a likeness of at least `least` share that part of the larger one; so with elements in one order for all
    sets, each has a common one among so many first ones."""
    return n - np.ceil(n * least - 1e-6).astype(np.int64) + 1


def joining(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of sets of a likeness of at least `least` that join all components which any such pair joins. Pairs of one
    side are left out where there are two sides; they meet elsewhere."""
    size = np.array([len(x) for x in sets])
    begin = np.cumsum(size) - size
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    # Each set's elements, rare ones first; the prefixes' postings by element.
    order = np.lexsort((ids, df[ids], owner))
    ids = ids[order]
    inside = np.arange(len(ids)) - np.repeat(begin, size) < np.repeat(prefix_size(size, least), size)
    post = np.flatnonzero(inside & (df[ids] > 1))
    post = post[np.argsort(ids[post], kind="stable")]
    first, last = (np.searchsorted(ids[post], np.arange(len(df)), way) for way in ("left", "right"))
    holder = owner[post]
    two = side.min() != side.max()
    root = np.unique(comp, return_inverse=True)[1]
    chief = np.bincount(root).argmax()
    mine = np.zeros(len(df), bool)
    out = []
    for u in np.flatnonzero(root != chief):
        own = ids[begin[u] : begin[u] + size[u]]
        head = own[: prefix_size(size[u : u + 1], least)[0]]
        n = last[head] - first[head]
        at = np.repeat(first[head] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found = np.unique(holder[at])
        found = found[(root[found] != root[u]) & (np.minimum(size[found], size[u]) >= least * np.maximum(size[found], size[u]))]
        if two:
            found = found[side[found] != side[u]]
        if not len(found):
            continue
        mine[own] = True
        n = size[found]
        at = np.repeat(begin[found] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.add.reduceat(mine[ids[at]].astype(np.int64), np.cumsum(n) - n)
        mine[own] = False
        for v in found[common >= least * (size[u] + n - common)]:
            if root[v] != root[u]:
                out.append((u, v))
                root[root == root[u]] = root[v]
    return out


def block_links(least: float):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("elements")]
        found = joining(sets, table.column("comp").to_numpy(), table.column("side").to_numpy(), least)
        ends = [np.array([x[i] for x in found], np.int64) for i in (0, 1)]
        return pa.table({"a": nodes[np.minimum(*ends)], "b": nodes[np.maximum(*ends)]} if found else {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return run


def across(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join the components left in the band groups of members (k, node, n)."""
    placed = members.join(labels, "node", "left").select("k", "node", "n", F.coalesce("comp", "node").alias("comp"))
    several = placed.groupBy("k").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.ceil(F.sum("n") * 8 / BLOCK).alias("_blocks")).where("_low <> _high").select("k", "_blocks")
    open_ = saved(placed.join(several, "k"), "open-members")
    # Each block meets every block of its group, and itself, once; most groups are one block.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = open_.withColumn("side", F.pmod(F.xxhash64("node"), "_blocks")).withColumn("_other", other)
    dealt = dealt.select("k", F.least("side", "_other").alias("_lo"), F.greatest("side", "_other").alias("_hi"), "side", "node", "comp").join(sets, "node")
    return dealt.groupBy("k", "_lo", "_hi").applyInArrow(block_links(least), "a long, b long").distinct()


def grouped(docs: DataFrame, least: float, bands: int, rows: int, width: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of every row), (digest, rep, copies, comp of every text)."""
    own = pick(docs, _key=key, _text=text).select(F.col("_key").cast("long").alias("_key"), F.coalesce("_text", F.lit("")).alias("_text"))
    own = own.withColumn("digest", F.unhex(F.md5("_text")))
    sigs = saved(signed(own, bands, rows, width), "signatures")
    # The number is part of the written table, so a task that runs again can't give a text another one.
    nodes = sigs.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", "n", F.explode("keys").alias("k"))
    groups = banded.groupBy("k").agg(F.count("*").alias("m"), F.min("node").alias("low"), F.max("node").alias("high")).where("m > 1")
    members = saved(banded.join(groups, "k"), "band-members")
    # The texts of the nodes in question, each once: by its first document, which no group of copies makes hot.
    asked = saved(members.select("node").distinct().join(nodes.select("node", "rep", "digest"), "node").select(F.col("rep").alias("_key"), "node", F.col("digest").alias("_asked")), "asked")
    found = maybe_in(own, "_key", asked.select("_key")).join(asked, "_key").where("digest = _asked").dropDuplicates(["node"])
    sets = saved(element_sets(found, width), "element-sets", (asked,))
    stars = members.select(F.col("low").alias("a"), F.col("node").alias("b")).union(members.select(F.col("node").alias("a"), F.col("high").alias("b"))).where("a <> b").distinct()
    links = saved(alike(stars, sets, least), "links")
    labels = components(links)
    # Groups of four and more may hold several components yet; sets of very different sizes can't be alike.
    links = saved(links.unionByName(across(members.where("m > 3").select("k", "node", "n"), labels, sets, least)), "links", (links, members, sets))
    labels = components(links)
    placed = nodes.join(labels, "node", "left").select("digest", "rep", "copies", F.coalesce("comp", "node").alias("comp"))
    return sigs.select("doc_id", "digest"), saved(placed, "placed", (nodes,))


def near_classes(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, class_size for every row; class_id is the least doc_id of its class.

    Equal texts are one node from the start, so a group of copies of any size costs one signature's bands. Null and empty
    texts are one class of their own; a text under five words is one run; a text of any length is taken whole. Null ids
    name a class only where it has no other; a text of null ids alone is linked to equal texts only. Repeated rows are
    equal texts. An empty table gives no rows; further columns are ignored.
    """
    sigs, placed = grouped(docs, least, bands, rows, width, key, text)
    classes = placed.groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    by_text = placed.join(classes, "comp").select("digest", "class_id", "class_size")
    return sigs.join(by_text, "digest").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class: the row of the least doc_id (not null, if there is one), of several texts of
    it that of the least digest, of repeated rows that of the least other columns.

    Null and empty texts are one class, of which one row stays; long texts are taken whole; an empty table stays empty;
    further columns are kept as they are, whatever their names.
    """
    sigs, placed = grouped(docs, least, bands, rows, width, key, text)
    # A row is named by its id and text, as 128 bits.
    name = lambda id_, digest: F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), F.hex(digest)))
    keepers = placed.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("k")).select(name(F.col("k.rep"), F.col("k.digest")).alias("_own"), F.lit(True).alias("_keeper"))
    rows_ = sigs.groupBy(name(F.col("doc_id"), F.col("digest")).alias("_own")).agg(F.count("*").alias("_times"))
    others = saved(rows_.join(keepers, "_own", "left").where("_keeper is null or _times > 1").select("_own", F.coalesce("_keeper", F.lit(False)).alias("_keeper")), "others", (placed,))
    # Rows that are surely no others stay where they are; only the rest of the texts is shuffled.
    whole = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("_row"), name(F.col(f"`{key}`").cast("long"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))).alias("_own"))
    both = marked(whole, "_own", others.select("_own"))
    asked = both.where("_maybe").join(others, "_own", "left").where("_keeper is null or _keeper")
    rest = F.to_json(F.col("_row").dropFields(f"c{docs.columns.index(text)}"))
    first = F.row_number().over(W.partitionBy("_own").orderBy(rest)) == 1
    stay = both.where("not _maybe").select("_row").unionByName(asked.withColumn("_first", first).where("_first").select("_row"))
    return stay.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
