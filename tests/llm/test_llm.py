"""Every dealt operator against brute force, on small rows with nulls, empty and long texts, ties, repeated rows, extra
columns of clashing names, and empty tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from segscore.llm import bpe, chat, fingerprints, graph, lines, neardup, packing, repeats, rules, sharding, warc

BYTES = {b: c for c, b in bpe.byte_letters().items()}
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, node string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["the", "Of", "and,", "thing.", "été", "naïve", "x1", "anble", "3.5", "don't"]) + r.choice(["", "s", "ly"]) for _ in range(n))


def rows() -> list[tuple]:
    r = random.Random(7)
    shared = "Licensed under the terms of this great and common licence text, all rights kept."
    out = [(i, "\n".join([prose(r, r.randint(5, 60)), shared] if i % 3 else [prose(r, 80)]), "en", f"src{i % 12}", 0) for i in range(60)]
    out += [(60 + i, out[1][1], "fr", f"src{i}", 0) for i in range(5)]  # exact copies
    words = out[4][1].split(" ")
    out += [(70, " ".join(words[:-1]), "en", "a", 0), (71, out[0][1] + " " + prose(r, 4), None, None, 0)]  # near copies
    out += [(80, None, "en", "a", 0), (81, "", "en", None, 0), (82, "   \n\n", None, "a", 0), (83, "one", "en", "a", 0), (84, "a" * 3000, "en", "a", 0), (85, "#$% " * 200, "en", "a", 0)]
    out += [(86, prose(r, 20000), "en", "src1", 0), (87, "😀 \x1c é<|endoftext|> ##</turn>\\", "en", "a", 0)]
    out += [out[2], out[2], (None, out[3][1], "en", "a", 0), (None, "no id here, " * 9, "en", "a", 0)]
    return [(*x, "extra", "clash") for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def text_of(x) -> str:
    return x or ""


def test_written_shards_keep_a_users_shard(spark, tmp_path):
    tree = sharding.HashTree(2, 3, 4)
    df = spark.createDataFrame([(1, "mine", None), (1, "mine", None), (None, "x", "t"), (2, None, "")], "doc_id long, Shard string, text string")
    column = sharding.write_shards(df, tree, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert column == "shard_" and Counter(tuple(x) for x in back.select(*df.columns).collect()) == Counter(tuple(x) for x in df.collect())
    assert back.where("doc_id = 1").select("shard_").distinct().count() == 1


def test_pipeline_takes_any_column_name(spark):
    import corpus_pipeline

    made = [(i, f"Word {i} of this text stands here once and for all.\nSecond line {i}.", "en", f"s{i % 3}", 0, i) for i in range(20)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, "")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b"]
    assert df.count() > 0


def test_empty_tables(empty, spark):
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    tree = sharding.HashTree(2, 3, 4)
    for df in (packing.pack_documents(empty, WORD), lines.clean_lines(empty), neardup.near_classes(empty), chat.read_back(chat.format_windows(conv, BYTE, public_tokenizers.PATTERN)), warc.read_records(warc.write_archives(pages)), sharding.shard_documents(empty, tree, tree), repeats.removal_digests(empty), rules.judge(empty), bpe.encode_documents(empty, BYTE, public_tokenizers.PATTERN), fingerprints.fingerprint_documents(empty)):
        assert df.count() == 0


# ---- 1


def test_packing_holds_every_id_once(docs):
    t = Tokenizer.from_file(WORD)
    pieces = packing.pack_documents(docs.repartition(3), WORD, buffer=16).collect()
    want = Counter()
    for d, x, *_ in rows():
        want[(d, tuple(t.encode(text_of(x), add_special_tokens=False).ids + [2]))] += 1
    totals = Counter()
    for (d, ids), n in want.items():
        totals[d] += n * len(ids)
    got, seqs = Counter(), defaultdict(list)
    for p in pieces:
        got[p.doc_id] += p.length
        seqs[p.sequence_id].append(p)
    assert got == totals
    ids_of = defaultdict(list)
    for d, ids in want:
        ids_of[d].append(ids)
    for p in pieces:
        assert any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for ids in ids_of[p.doc_id])
    for parts in seqs.values():
        parts.sort(key=lambda p: p.offset)
        ends = list(itertools.accumulate(p.length for p in parts))
        assert [p.offset for p in parts] == [0, *ends[:-1]]
        assert ends[-1] == parts[0].sequence_length <= 4096
        assert ends[-1] & (ends[-1] - 1) == 0  # powers of two: nothing to pad


def test_step_groups_are_balanced_over_tasks(docs):
    pieces = packing.pack_documents(docs.repartition(64), WORD, groups=4).collect()
    of = {p.sequence_id: (p.step_group, p.sequence_length) for p in pieces}
    tokens, number = Counter(), Counter()
    for g, n in of.values():
        tokens[g] += n
        number[(n, g)] += 1
    assert set(tokens) == {0, 1, 2, 3} and max(tokens.values()) - min(tokens.values()) < 4096  # less than one sequence
    assert all(len({p.step_group for p in pieces if p.sequence_id == s}) == 1 for s in list(of)[:20])
    assert all(max(number[(n, g)] for g in range(4)) - min(number[(n, g)] for g in range(4)) <= 1 for n, _ in number)


def test_word_encoder_equals_the_library():
    t = Tokenizer.from_file(WORD)
    r = random.Random(1)
    texts = ["".join(r.choice("aAbÉ .,'s\n\t0\x1c_\u0301\u03a3İ<|endoftext|>") for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["A.B,c. ..,", "x_. y", "e.g.", "ΟΔΟΣ. ΣΑΣ"]
    encode = packing.WordEncoder(WORD, 2, memo=50)
    for i in range(0, len(texts), 100):
        for x, ids in zip(texts[i : i + 100], encode(texts[i : i + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids + [2]


# ---- 2


def test_line_dedup(docs):
    sites, short_sites, short = 5, 7, 20
    spread, first = defaultdict(set), {}
    for d, x, _, s, *_ in rows():
        for line in text_of(x).split("\n"):
            k = line.strip(" ")
            if line.strip(" \t\v\f\r"):
                spread[k].add(text_of(s))
                if d is not None:
                    first[k] = min(d, first.get(k, d))
    bad = {k for k, v in spread.items() if len(v) >= (short_sites if len(k) < short else sites)}
    assert bad
    want = []
    for d, x, *_ in rows():
        parts = text_of(x).split("\n")
        kept = [v for v in parts if not (v.strip(" ") in bad and (d is None and v.strip(" ") in first or d is not None and d != first.get(v.strip(" "))))]
        want.append((d, None if x is None else "\n".join(kept), 0 if x is None else len(parts) - len(kept)))
    out = lines.clean_lines(docs, sites, short_sites, short)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    key = lambda v: (v[0] is None, v[0] or 0, v[1] or "")
    assert sorted([(x.doc_id, x.text, x.n_removed) for x in out.collect()], key=key) == sorted(want, key=key)


def test_short_lines_need_more_sites(spark):
    """Short lines go from 15 sites on, in steps of one site around it; blank ones never."""
    rows = [(100 * n + i, f"own line of document {100 * n + i}\n  at {n}\n \t\r\n", f"s{i}") for n in (9, 10, 14, 15, 16, 30) for i in range(n)]
    rows += [(5000 + 100 * n + i, f"a line that stands on {n} sites", f"s{i}") for n in (9, 10, 11) for i in range(n)]
    got = {x.doc_id: x for x in lines.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for d, x, _ in rows:
        n, i = divmod(d % 5000, 100)
        gone = i > 0 and n >= (10 if d >= 5000 else 15)
        assert got[d].n_removed == gone
        assert got[d].text == ("\n".join(v for v in x.split("\n") if v != f"  at {n}" and not v.startswith("a line that")) if gone else x)


# ---- 3


def runs(x: str) -> Counter:
    w = x.encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def test_near_classes(docs):
    texts = sorted({text_of(x) for _, x, *_ in rows()})
    sets = [runs(x) for x in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both, all_ = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
        if all_ and both >= 0.8 * all_:
            parent[find(i)] = find(j)
    ids, sizes = {}, Counter()
    for d, x, *_ in rows():
        c = find(texts.index(text_of(x)))
        sizes[c] += 1
        if d is not None:
            ids[c] = min(d, ids.get(c, d))
    want = Counter((d, ids.get(find(texts.index(text_of(x)))), sizes[find(texts.index(text_of(x)))]) for d, x, *_ in rows())
    assert Counter((x.doc_id, x.class_id, x.class_size) for x in neardup.near_classes(docs).collect()) == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(set(ids.values()))
    assert len(kept) == len(sizes) and not Counter(tuple(x) for x in kept) - Counter(rows())  # whole rows, as they were


def test_near_classes_of_one_template(spark):
    """Pairs of likeness 0.81 among documents that all have 0.75 to each other, so that band groups hold many components."""
    r = random.Random(21)
    new = lambda n: [f"w{r.getrandbits(40)}" for _ in range(n)]
    template = new(244)
    made = []
    for _ in range(150):
        own = template + new(11)
        made += [" ".join(own + new(29)), " ".join(own + new(29))]
    a, b, c = (set(runs(made[i])) for i in (0, 1, 2))
    assert len(a & b) / len(a | b) >= 0.8 > 0.76 > len(a & c) / len(a | c)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.class_id for x in neardup.near_classes(df).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


@pytest.mark.parametrize("block", [16 << 20, 20_000])
def test_links_inside_a_group_of_chains(spark, block, monkeypatch):
    """Chains a - b - c whose ends are under 0.8, all sharing bands, in one block and in several."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(5)
    new = lambda n: [f"w{r.getrandbits(40)}" for _ in range(n)]
    template, made = new(120), []
    for _ in range(8):
        one = template + new(60)
        for i in range(5):  # each differs from the one before in nine words
            made.append(" ".join(one))
            one = one[: 125 + 10 * i] + new(9) + one[134 + 10 * i :]
    sets = [runs(x) for x in made]
    like = lambda i, j: sum((sets[i] & sets[j]).values()) / sum((sets[i] | sets[j]).values())
    parent = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if like(i, j) >= 0.8 and parent[i] != parent[j]:
                old = max(parent[i], parent[j])
                parent = [min(parent[i], parent[j]) if x == old else x for x in parent]
    assert len(set(parent)) < len(made) and any(like(i, parent[i]) < 0.75 for i in range(len(made)))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.class_id for x in neardup.near_classes(df).collect()}
    assert got == {i: min(j for j in range(len(made)) if parent[j] == parent[i]) for i in range(len(made))}


def test_signatures_estimate_weighted_likeness():
    r = np.random.default_rng(5)
    e = r.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = r.integers(1, 4, 300).astype(float), r.integers(1, 4, 300) + 0.5
    a, b = (np.sort(e[:300]), wa), (np.sort(e[100:]), wb)
    da, db = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
    want = sum(min(da.get(k, 0), db.get(k, 0)) for k in e) / sum(max(da.get(k, 0), db.get(k, 0)) for k in e)
    sig = neardup.signatures([a, b], 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_components(spark, monkeypatch):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(7, 7), (500, 499)]
    parent = {v: v for e in edges for v in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    want = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    for local in (2_000_000, 20, 0):  # in one task, after some rounds, by rounds alone
        monkeypatch.setattr(graph, "LOCAL", local)
        assert {x.node: x.comp for x in graph.components(df).collect()} == want


# ---- 4


def test_chat_round_trip(spark):
    r = random.Random(2)
    said = r"\### Assistant: </turn> ok"
    turns = [(-7, 0, "user", said), (-7, 1, "assistant", said), (None, 0, "user", "a"), (5, None, None, None), (5, 0, "system", "be good"), (5, 1, "assistant", ""), (5, 1, "assistant", ""), (6, 0, "a:b\n### x:\n", "##### </turn>\n</turn>\n")]
    turns += [(9, i, "system" if i == 0 else ("user", "assistant")[i % 2], prose(r, r.randint(0, 200)) + ("\\" * i)) for i in range(40)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, window string").repartition(3)
    want = {}
    order = lambda t: (t[1] is not None, t[1] or 0, text_of(t[2]), text_of(t[3]))
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=order)
        loss = "".join(text_of(t[3]) for t in own if t[2] == "assistant")
        want[conv] = (len(own), hashlib.sha256("".join(f"{text_of(t[2])}\n{text_of(t[3])}\n" for t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = chat.format_windows(df, BYTE, public_tokenizers.PATTERN, budget=900, history=300).cache()
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.read_back(windows).collect()}
    assert got == want
    nine = sorted(windows.where("conv_id = 9").collect(), key=lambda x: x.window)
    assert len(nine) > 3 and all(x.text.startswith("### system:\n") for x in nine)
    t = Tokenizer.from_file(BYTE)
    for x in nine:
        turns = [chat.render(r, said)[0] for r, said, *_ in chat.parse(x.text)]
        assert x.tokens == sum(len(t.encode(v, add_special_tokens=False).ids) for v in turns)
        alone = turns[:1] + turns[-1:] if len(turns) == 2 else None  # the system turn and one new turn
        assert x.tokens <= 900 or turns == alone and len(list(chat.parse(x.text[x.new_from :]))) == 1
    assert any(len(list(chat.parse(x.text))) > len(list(chat.parse(x.text[x.new_from :]))) + 1 for x in nine)  # history


# ---- 5


def test_warc(spark):
    big = "<p>" + "é" * 200
    pages = [(3, "http://a/x y", big), (1, "http://a/ü\r\nz", big), (2, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "v", "x" * 200_000), (1, "w", big), (9, "q", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(df)
    got = Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, x.digest_ok) for x in warc.read_records(index).collect())
    low = defaultdict(list)
    for p, _, h in pages:
        low[text_of(h)].append(p)
    want = Counter()
    for p, _, h in pages:
        raw = text_of(h).encode()
        again = len(raw) >= 100 and p != min(low[text_of(h)])
        want[(p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(low[text_of(h)]) if again else None, True)] += 1
    assert got == want
    some = index.where("page_id in (8, 9)")
    assert {x.page_id: bytes(x.payload).decode() for x in warc.read_records(some, payload=True).collect()} == {p: h for p, _, h in pages if p in (8, 9)}


def test_ranges_are_coalesced():
    assert list(warc.coalesced([(0, 10), (10, 5), (16, 4), (100, 3)], 1, 1000)) == [(0, 3, 0, 20), (3, 4, 100, 3)]
    assert [x[:2] for x in warc.coalesced([(0, 10), (10, 10), (20, 10)], 5, 20)] == [(0, 2), (2, 3)]


# ---- 6


def test_sharding(docs, spark):
    got = sharding.shard_documents(docs, sharding.HashTree(2, 3, 4), sharding.HashTree(2, 3, 4).grow(), buckets=3).collect()
    want = Counter((d, len(text_of(x).encode()) + 8, zlib.crc32(text_of(x).encode())) for d, x, *_ in rows())
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == want
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_moves_into_the_new_shard_only(spark):
    from pyspark.sql import functions as F

    a, b = sharding.HashTree(2, 3, 4), sharding.HashTree(2, 3, 4).grow()
    rows_ = spark.range(40_000).select(a.shard(F.col("id")).alias("a"), b.shard(F.col("id")).alias("b"), b.grow().shard(F.col("id")).alias("c")).collect()
    assert {x.b for x in rows_ if x.a != x.b} == {24} and {x.c for x in rows_ if x.b != x.c} == {25}
    for n, of in ((24, "a"), (25, "b")):
        sizes = Counter(x[of] for x in rows_)
        assert len(sizes) == n and max(abs(v - 40_000 / n) for v in sizes.values()) < 250
    heavy = sharding.HashTree(2, 3, 4, weights={0: 3.0})
    sizes = Counter(x.s for x in spark.range(40_000).select(heavy.shard(F.col("id")).alias("s")).collect())
    assert 2.7 < sizes[0] / (sum(sizes.values()) - sizes[0]) * 23 < 3.3


# ---- 7


def removed(items: list[tuple]) -> Counter:
    """doc, bytes, removed, spans, digest by the definition."""
    last = 2**63
    first: dict[bytes, int] = {}
    coded = [(last if d is None else d, text_of(x).encode()) for d, x in items]
    for d, b in sorted(coded):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = Counter()
    for d, b in coded:
        cover = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                cover[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[(None if d == last else d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeated_passages(docs, spark, hot, monkeypatch):
    r = random.Random(11)
    parts = ["".join(r.choice("ab c") for _ in range(r.randint(20, 140))) for _ in range(16)]
    made = [(i - 9, "é".join(r.choice(parts) for _ in range(r.randint(0, 6))) + "z" * r.choice([0, 49, 50, 51, 120])) for i in range(70)]
    monkeypatch.setattr(repeats, "HOT", hot)
    for items in (made, [x[:2] for x in rows()]):
        df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
        got = Counter(tuple(x) for x in repeats.removal_digests(df).collect())
        assert got == removed(items)


def test_removed_texts(docs, spark):
    clash = docs.withColumnsRenamed({"n_chars": "starts", "node": "_maybe"})
    cut = repeats.remove_repeats(clash)
    assert cut.columns == clash.columns
    want = Counter(digest for _, _, _, _, digest in removed([x[:2] for x in rows()]).elements())
    got = Counter(hashlib.sha256(text_of(x.text).encode()).hexdigest() for x in cut.collect())
    # Cuts inside a character leave less than the bytes that are kept; there are none in these rows.
    assert got == want
    others = [c for c in clash.columns if c != "text"]
    assert Counter(map(tuple, cut.select(others).collect())) == Counter(map(tuple, clash.select(others).collect()))
    assert cut.where("doc_id = 80").first().text is None


def test_merged_transforms_sort_all_contexts():
    r = np.random.default_rng(0)
    strings = [np.zeros((8, 14), np.uint16) for _ in range(3)]
    for s in strings:
        for row in s:
            n = r.integers(3, 13)
            row[:n] = r.integers(1, 4, n)
    for depth in (1, 4, 7):
        shards = [repeats.Shard(s, depth) for s in strings]
        which, row, block = repeats.merged_blocks(shards, depth)

        def context(k, i, depth=depth, shards=shards):
            own = strings[k][shards[k].owner[i]]
            n = int((own > 0).sum()) + 1
            return tuple(int(own[(shards[k].at[i] + j) % n]) for j in range(depth))

        seen = [context(k, i) for k, i in zip(which, row, strict=True)]
        assert seen == sorted(seen)
        assert all((seen[i] == seen[i - 1]) == (block[i] == block[i - 1]) for i in range(1, len(seen)))


# ---- 8


def measures(x: str) -> tuple:
    words = x.encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    own = [v for v in x.split("\n") if v.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(c not in " \t\n\x0b\x0c\r" for c in x), sum(c in "#*$%&|<>" for c in x), len(own) - len(set(own)), len(hit)


def test_quality_rules(docs):
    got = Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in rules.judge(docs).collect())
    want = Counter()
    for d, x, *_ in rows():
        m = measures(text_of(x))
        want[(d, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    judged = Counter(x.doc_id for x in rules.judge(docs).where("kept").collect())
    assert Counter(x.doc_id for x in kept.collect()) == judged
    assert not Counter(tuple(x) for x in kept.collect()) - Counter(rows())  # whole rows, as they were


def kept_rows(items: list[tuple]) -> list[tuple]:
    """The rows (doc_id, text, lang, source, ...) that the rules keep, from exact quantiles."""
    less = lambda n: n - math.sqrt(n) + 0.5
    told = []
    for x in items:
        m = measures(text_of(x[1]))
        lines = sum(bool(v.strip(" \t\n\x0b\x0c\r")) for v in text_of(x[1]).split("\n"))
        told.append((x, m, [math.log(v) for v in (less(m[2]) / (m[0] + 0.5), less(m[3]) / (lines + 0.5), m[1] / m[0], m[0])] if m[0] else None))
    quartiles = lambda of: np.array([sorted(of)[int(np.ceil(len(of) * q)) - 1] for q in (0.25, 0.5, 0.75)])

    def spread(x: tuple, i: int) -> np.ndarray:
        found = None
        for same in (lambda y: True, lambda y: y[2] == x[2], lambda y: y[2:4] == x[2:4]):
            own = [v[i] for y, _, v in told if v and same(y)]
            found = quartiles(own) if found is None else (len(own) * quartiles(own) + 200 * found) / (len(own) + 200)
        return found

    out = []
    for x, m, r in told:
        good = m[0] >= 10 and 100 * m[4] <= 20 * m[0]
        if good:
            (_, mid, high), (_, mid2, high2), (low3, mid3, high3), (_, words, _) = (spread(x, i) for i in range(4))
            wide = max(1, math.sqrt(math.exp(words) / m[0]))
            good &= m[2] <= 1 or r[0] - mid <= 4 * (high - mid)
            good &= m[3] <= 1 or r[1] - mid2 <= 2.5 * (high2 - mid2)
            good &= -6 * (mid3 - low3) * wide <= r[2] - mid3 <= 6 * (high3 - mid3) * wide
        if good:
            out.append(x)
    return out


def test_kept_with_planted_junk(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    clean = lambda: "\n".join(" ".join(word() for _ in range(10)) for _ in range(r.randint(3, 12)))
    piped = lambda: " | ".join(" ".join(word() for _ in range(2)) for _ in range(40))
    marked = lambda: " ".join(word() + r.choice(["###", "***"]) for _ in range(60))

    def repeated() -> str:  # short lines three times, between long ones: few words, many lines
        return "\n".join(x for _ in range(6) for v in [word() + " " + word()] for x in (v, " ".join(word() for _ in range(12)), v, v))

    for kinds in ((piped,), (marked,), (repeated,), (piped, marked, repeated)):
        made, junk = [], set()
        for share in (1, 6, 20):
            for i in range(400):
                d = len(made)
                bad = i < 4 * share
                x = kinds[i % len(kinds)]() if bad else clean()
                junk |= {d} if bad else set()
                made.append((d, x, "en", f"s{share}"))
        got = {x.doc_id for x in rules.judge(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).where("kept").collect()}
        assert got == {x[0] for x in kept_rows(made)} == set(range(len(made))) - junk


def test_bounds_come_from_the_groups(spark):
    """The same text is junk where symbols are rare and fine where they are usual; groups' bounds differ."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(r.randint(n, n + 4)))
    text = lambda n, share: " ".join(word(n) + ("%" if r.random() < share else "") for _ in range(r.randint(40, 400)))
    made = [(i, text(3, 0.0), "en", "prose") for i in range(3000)] + [(3000 + i, text(3, r.uniform(0.05, 0.4)), "en", "tables") for i in range(3000)]
    made += [(6000 + i, text(9, 0.0), "de", "long words") for i in range(3000)]
    probe = text(3, 0.15)
    made += [(9000, probe, "en", "prose"), (9001, probe, "en", "tables"), (9002, text(9, 0), "en", "prose"), (9003, text(9, 0), "de", "long words")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.kept for x in rules.judge(df).collect()}
    assert [got[i] for i in (9000, 9001, 9002, 9003)] == [False, True, False, True]
    assert sum(not got[i] for i in range(9000)) < 20
    bounds = rules.thresholds(rules.measure(df, ["lang", "source"]).withColumnsRenamed({"_k0": "lang", "_k1": "source"}), rules.PRIOR).collect()
    for m in ("symbols", "word_length"):  # every text is one line
        assert len({round(x[f"{m}_high"], 6) for x in bounds}) == 3


def test_quantiles_of_merged_sketches_are_near_exact(spark):
    r = random.Random(4)
    values = [(r.choice("ab"), "m", r.lognormvariate(0, 1), 1) for _ in range(3000)] + [("a", "m", 0.0, 1)] * 10
    df = spark.createDataFrame(values, "g string, metric string, x double, n int")
    for by, part in ((["g"], "a"), ([], None)):
        s = rules.sketch(df, ["g"])
        q = rules.quantiles(rules.merged(s, by), by, {"mid": 0.5, "high": 0.95}).collect()
        row = next(x for x in q if part is None or x.g == part)
        own = sorted(v[2] for v in values if part in (None, v[0]))
        assert row.total == len(own)
        for name, at in (("mid", 0.5), ("high", 0.95)):
            exact = own[int(np.ceil(at * len(own))) - 1]
            assert exact / 1.021 <= row[name] <= exact * 1.021


def test_hash_collisions_of_windows_do_not_count(monkeypatch):
    words = np.array([1, 2, 3, 1, 2, 3, 9, 8, 7], np.int64)
    assert rules.repeated_words(words, np.array([0, 6]), 3).tolist() == [6, 0]
    assert rules.repeated_words(words, np.array([0, 3, 9]), 3).tolist() == [0, 0, 0]


# ---- 9


def test_bpe_automaton(docs):
    t = Tokenizer.from_file(BYTE)
    got = Counter(tuple(x) for x in bpe.encode_documents(docs, BYTE, public_tokenizers.PATTERN).collect())
    want = Counter()
    for d, x, *_ in rows():
        ids = t.encode(text_of(x), add_special_tokens=False).ids
        told = ",".join(map(str, ids))
        want[(d, len(ids), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(docs, BYTE, public_tokenizers.PATTERN, ids=True), BYTE)
    assert Counter(x.text for x in back.collect()) == Counter(text_of(x) for _, x, *_ in rows())


def test_bpe_automaton_on_random_words():
    t = Tokenizer.from_file(BYTE)
    e = bpe.Encoder(BYTE, public_tokenizers.PATTERN, memo=20)
    r = random.Random(9)
    for _ in range(4000):
        x = "".join(r.choice(["a", "th", "e", " ", "  ", "\n", "é", "ing", "0", ".", "'s", "\xa0", "<|endoftext|>", "QZ"]) for _ in range(r.randint(0, 25)))
        assert e.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_bpe_automaton_with_a_small_table(monkeypatch):
    """The table starts anew within words, and nothing changes."""
    t = Tokenizer.from_file(BYTE)
    monkeypatch.setattr(bpe.Automaton, "STATES", 7)
    monkeypatch.setattr(bpe.Automaton, "KEPT", 5)
    a = bpe.Automaton(BYTE)
    for word in ("internationalisation", " " * 300, "a" * 1000, "abcabcabcab" * 20, "é中é中", "theretheing"):
        assert a.encode(word.encode()) == [x.id for x in t.model.tokenize("".join(BYTES[b] for b in word.encode()))]
        assert a.decode(a.encode(word.encode())) == word
        assert len(a.opened) <= 8 and len(a.arcs) <= 5
    assert a.encode(b"") == []


# ---- 10


def test_fingerprints(docs):
    got = fingerprints.fingerprint_documents(docs).collect()
    base = [(d, text_of(x)) for d, x, *_ in rows()]
    assert Counter(x.doc_id for x in got) == Counter(d for d, _ in base)
    texts = defaultdict(set)
    for d, x in base:
        texts[d].add(x)
    ids = sorted(d for d in texts if d is not None)
    by_text, of = {}, {d: x for d, x in base}
    for x in got:
        if x.doc_id is None:
            continue
        own = of[x.doc_id]
        nxt = of[ids[(ids.index(x.doc_id) + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert (x.n_chars, x.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(own, x.fingerprint) == x.fingerprint
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if own == nxt:
            assert x.near_next == 1
    long_ = next(x for x in got if x.doc_id == 86)
    assert 0.1 < long_.near_edited < 0.9
    assert all(x.near_next is None for x in got if x.doc_id is None)


def test_likeness_is_of_all_anchors(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    words = lambda n: [f"w{r.getrandbits(40)}" for _ in range(n)]
    passage = words(60)
    made = [(1, " ".join(words(2500) + passage + words(2500))), (2, " ".join(words(700) + passage + words(4000))), (3, " ".join(words(300) * 3)), (4, "")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    hashes = {x.doc_id: [(a["hash"], a["at"]) for a in x.a] for x in df.select("doc_id", fingerprints.anchors(F.col("text")).alias("a")).collect()}
    for x in fingerprints.fingerprint_documents(df).collect():
        first, other = ({h: at for h, at in reversed(hashes[d])} for d in (x.doc_id, x.doc_id % 4 + 1))
        both = first.keys() & other.keys()
        assert len(x.fingerprint.split(",")) == max(1, len(first))
        assert x.near_next == (len(both) / len(first.keys() | other.keys()) if first or other else 1.0)
        assert [tuple(p) for p in x.next_places] == sorted((first[h], other[h]) for h in both)
        if x.doc_id == 1:
            assert len(both) > 15 and {a - b for a, b in x.next_places} == {1800} and 0 < x.near_next < 0.02

def signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def chained(*values) -> int:
    """The engine's 64-bit hash of strings and longs one after another."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def test_anchors_by_definition(spark):
    from pyspark.sql import functions as F

    r = random.Random(17)
    texts = [" ".join(r.choice("ab") * r.randint(1, 20) for _ in range(n)) for n in (0, 1, 3, 4, 5, 6, 9, 60, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fingerprints.anchors(F.col("t")).alias("a"))
    for x in df.collect():
        words = [w[i : i + 16] for w in texts[x.i].split() for i in range(0, len(w), 16)]
        h = [chained(w) for w in words]
        pairs = [chained(a, b) for a, b in itertools.pairwise(h)]
        want = [(i, chained(pairs[i], pairs[i + 2], pairs[i + 3])) for i in range(len(pairs) - 3) if min(pairs[i], pairs[i + 3]) == min(pairs[i : i + 4])]
        if not want and words:
            want = [(0, chained(*h))]
        assert [(a["at"], a["hash"]) for a in x.a] == want


def test_shards_by_plain_descent(spark):
    from math import log

    from pyspark.sql import functions as F

    tree = sharding.HashTree(2, 3, 4, weights={3: 2.5}).grow()
    for x in spark.range(300).select("id", tree.shard(F.col("id")).alias("s")).collect():
        steps = tree.steps
        for _ in range(3):
            best = min(steps, key=lambda p: -log(((chained(p.name, x.id) % 2**64 >> 11) + 0.5) * 2.0**-53) / p.weight)  # noqa: B023
            steps = best.children
        assert best.shard == x.s


def test_anchors_are_context_free(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(6))
    passage = [word() for _ in range(60)]
    df = spark.createDataFrame([(" ".join([word() for _ in range(9)] + passage), " ".join(passage + [word() for _ in range(5)]))], "a string, b string")
    m = df.select(fingerprints.positional_matches(fingerprints.anchors(F.col("a")), fingerprints.anchors(F.col("b"))).alias("m")).first().m
    inside = {(x.left, x.right) for x in m}
    assert len(inside) > 15 and all(a - b == 9 for a, b in inside)


# ---- the pipeline


def test_pipeline_stages(docs, spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "passage dedup", "packing"]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        if name == "passage dedup":
            assert out.count() == now.count()
        now = out
    assert 0 < now.count() < docs.count()
    assert now.where("n_chars <> length(text)").count() == 0


def sorted_rows(items) -> list[tuple]:
    return sorted((tuple(x) for x in items), key=repr)


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    """Every stage's rows, each from the rows that the brute force of the stage before gave, and the pieces of run()."""
    import corpus_pipeline

    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(9))
    footer, passage = line(), " ".join(line() for _ in range(7))
    made = []
    for i in range(120):
        lines = [line() for _ in range(r.randint(2, 9))] + [footer] * (i % 3 == 0)
        lines += [line() + " " + passage + " " + line()] * (i % 5 == 1)
        made.append((i, "\n".join(lines), "en" if i % 4 else "fr", f"s{i % 14}", 0))
    made += [(200 + i, made[i][1], "en", "s1", 0) for i in range(0, 30, 3)]  # copies
    for i in range(10):  # near copies
        words = made[40 + i][1].split(" ")
        made.append((300 + i, " ".join([*words[:-1], word()]), None, "s2", 0))
    made += [(400, None, "en", "s1", 0), (401, "", "en", None, 0), (402, "## $$ | | " * 30 + line(), "en", "s3", 0), (403, "few words only", "en", "s1", 0), made[7], made[7], (None, line() + " " + line(), "en", "s4", 0)]
    made = [(a, b, c, d, len(text_of(b))) for a, b, c, d, _ in made]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(made, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    now = made
    fresh = lambda x, text: (x[0], text, *x[2:4], None if text is None else len(text))

    # 1
    want = kept_rows(now)
    assert 0 < len(want) < len(now)
    step = lambda name: sorted_rows(stages[name](spark, spark.createDataFrame(now, schema).repartition(3), str(tmp_path)).collect())
    assert step("quality rules") == sorted_rows(want)
    now = want
    # 2
    spread, first = defaultdict(set), {}
    for d, x, _, s, _ in now:
        for k in {v.strip(" ") for v in x.split("\n")}:
            spread[k].add(text_of(s))
            first[k] = d if k not in first else min(first[k], d, key=lambda v: (v is None, v or 0))
    gone = {k for k, v in spread.items() if k and len(v) >= (15 if len(k) < 20 else 10)}
    assert gone
    want = [fresh(x, "\n".join(v for v in x[1].split("\n") if v.strip(" ") not in gone or x[0] == first[v.strip(" ")])) for x in now]
    assert step("line dedup") == sorted_rows(want)
    now = want
    # 3
    sets, parent = [runs(x[1]) for x in now], list(range(len(now)))
    for i, j in itertools.combinations(range(len(now)), 2):
        both = sum((sets[i] & sets[j]).values())
        if both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both) and parent[i] != parent[j]:
            old, new = parent[j], parent[i]
            parent = [new if v == old else v for v in parent]
    best = {}
    for x, c in zip(now, parent, strict=True):
        best[c] = min(best.get(c, x), x, key=lambda v: (v[0] is None, v[0] or 0))
    want = list(best.values())
    assert len(want) < len(now) - 12 and step("near dedup") == sorted_rows(want)
    now = want
    # 4
    seen: dict[bytes, int] = {}
    last = 2**63
    coded = sorted(((last if x[0] is None else x[0], x[1].encode(), x) for x in now), key=lambda v: v[:2])
    for d, raw, _ in coded:
        for i in range(len(raw) - 49):
            seen.setdefault(raw[i : i + 50], d)
    want = []
    for d, raw, x in coded:
        cover = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < d:
                cover[i : i + 50] = b"\1" * 50
        want.append(fresh(x, bytes(v for v, c in zip(raw, cover, strict=True) if not c).decode()))
    assert any(len(a[1]) < len(b[2][1]) for a, b in zip(want, coded, strict=True)) and step("passage dedup") == sorted_rows(want)
    # 5, through run(): every id of every text that is left, once, in sequences without gaps
    t = Tokenizer.from_file(WORD)
    ids = {x[0]: [*t.encode(x[1], add_special_tokens=False).ids, 2] for x in want}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        got[p.doc_id] += range(p.start, p.start + p.length)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(len(v))) for k, v in ids.items()}


def test_stages_take_an_empty_table(empty, spark, tmp_path):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)
