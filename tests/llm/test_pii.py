"""Personal data: base spans against plain patterns, and the bootstrapping against plain loops over dictionaries."""

import hashlib
import math
import random
import re
from collections import defaultdict

from segscore.llm import pii

ROWS = "doc_id long, text string, hits string, key string, kind int"
#: The contract's patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


LONG = ["a", "1", "1 ", ".", "+1", "(", "1.", "@", "a@", "1:", "-1"]


def luhn(n: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(n))) % 10 == 0


def card(r: random.Random, good: bool = True) -> str:
    body = "".join(str(r.randint(0, 9)) for _ in range(15))
    return next(body + d for d in "0123456789" if luhn(body + d) == good)


def base(text: str) -> list[tuple]:
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), True))
    return sorted(out)


def by_hand(texts: list[str], rounds: int = 3, support: float = 5, confidence: float = 0.7, score: float = 0.9) -> dict[str, list[tuple]]:
    """All spans of each distinct text."""
    spans, places, edges = {}, defaultdict(list), defaultdict(bool)
    for text in set(texts):
        seeds_of = base(text)
        spans[text] = list(seeds_of)
        for patterns, seed in ((pii.BASE, True), (pii.LOOSE, False)):
            for k, kind in enumerate(pii.KINDS):
                # \G is Java's; a run can only be entered behind the last match or at its start.
                found = list(re.finditer(PLAIN[kind] if seed else patterns[kind], text))
                if seed and kind == "card":
                    found = [m for m in found if len(re.sub("[^0-9]", "", m[0])) >= 14]
                for i, m in enumerate(found):
                    at = (m.start(), k, m.end(), True)
                    if seed and at not in seeds_of:
                        continue
                    if not seed and any(a < m.end() and m.start() < e for a, _, e, _ in seeds_of):
                        continue
                    lo, hi = found[i - 1].end() if i else 0, found[i + 1].start() if i + 1 < len(found) else len(text)
                    words = [[w for w in re.split(r"[ \t\n\x0b\f\r]+", re.sub("[0-9]", "0", x.lower())) if w] for x in (text[lo : m.start()][-60:], text[m.end() : hi][:60])]
                    a, b = ["", "", *words[0]][-2:]
                    value = m[0].lower() if k < 2 else re.sub("[^0-9]", "", m[0])
                    shown = [f"{a} {b} _"] * bool(a and b) + [f"{b} _"] * bool(b) + ([f"{b} _ {words[1][0]}"] if b and words[1] else [])
                    for p in shown:
                        edges[k, value, p] |= seed
                    if not seed:
                        places[k, value].append((text, m.start(), m.end()))
    seeds = {(k, v): 1.0 for (k, v, _), seed in edges.items() if seed}
    known = dict(seeds)
    for _ in range(rounds):
        conf = {}
        by_pattern = defaultdict(list)
        for (k, v, p), seed in edges.items():
            by_pattern[p].append((k, v, seed))
        for p, group in by_pattern.items():
            for kind in range(4):
                f = sum(known.get((k, v), 0) for k, v, _ in group if k == kind)
                n = sum(k == kind or seed for k, v, seed in group)
                if f >= support and f / (n + 1) >= confidence:
                    conf[p, kind] = f / (n + 1)
        misses = defaultdict(float)
        for (k, v, p), seed in edges.items():
            if (k, v) not in seeds and (p, k) in conf:
                misses[k, v] += math.log(1 - conf[p, k])
        known = seeds | {kv: 1 - math.exp(x) for kv, x in misses.items() if 1 - math.exp(x) >= score}
    for (k, v), where in places.items():
        if (k, v) in known:
            for text, start, end in where:
                spans[text].append((start, k, end, False))
    return {t: sorted(s) for t, s in spans.items()}


def rows() -> list[tuple]:
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7)))
    fill = lambda n: " ".join(word() for _ in range(n))
    out = []
    for _ in range(30):
        out.append(f"{fill(6)} please charge card {card(r)} today {fill(3)}")
        out.append(f"{fill(4)} you may ring me at +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} after lunch {fill(5)} 😀 mail {word()}.{r.randint(1, 99)}@ex-{r.randint(1, 9)}.example.com")
        out.append(f"{fill(5)} the host {r.randint(0, 255)}.{r.randint(0, 255)}.1.{r.randint(0, 300)} {fill(8)} {r.randint(10, 99999)}")
    out += [f"{fill(3)} please charge card {card(r, good=False)} today {fill(2)}", f"you may ring me at (415) 555-{r.randint(1000, 9999)} after lunch"]
    out += [out[-2].split("card ")[1].split(" today")[0] + " stands alone here", f"order {card(r, good=False)} {fill(4)}"]
    out += ["a@b.com_x@c.org.. a@b.com@d.org 1.2.3.4.5.6.7.8 1.2.3.4 5", "+1 2 +12 345 678 90 12 345)) 0.0.0.00256 1111 1111 1111 1117 é😀", "a.b@c", "x (at) y.com z [at] q.org", "+(((((1234567890", "4-0-1-2 8888 8888 8881 881 12345678901234567890123 --1"]
    out += ["", " ", *(x * 300 for x in LONG), "a@" + "b." * 300 + "c", "x " * 2000 + card(r)]
    out += [out[0]] * 7
    return [(i, t) for i, t in enumerate(out)] + [(None, out[1]), (None, None), (3, out[5]), (3, out[3])]


def test_spans_equal_plain_loops(spark):
    df = spark.createDataFrame([(*x, "clash", "clash", 1) for x in rows()], ROWS).repartition(3)
    got = sorted(((x.doc_id, [tuple(s) for s in x.spans]) for x in pii.found_spans(df).collect()), key=str)
    hand = by_hand([t or "" for _, t in rows()])
    want = sorted(((d, hand[t or ""]) for d, t in rows()), key=str)
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w] == []
    new = [(t, s) for t, spans in hand.items() for s in spans if not s[3]]
    assert any("charge" in t and s[1] == 2 for t, s in new) and any("ring" in t and s[1] == 3 for t, s in new)
    assert any("stands alone" in t for t, _ in new)  # known from its context, found without it
    assert not any("order" in t for t, _ in new)


def test_digests(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    for x in pii.digests(pii.found_spans(df)).collect():
        texts = [t or "" for d, t in rows() if d == x.doc_id]
        told = [",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, _ in base(t)) for t in texts]
        assert x.base_sha256 in [hashlib.sha256(t.encode()).hexdigest() for t in told]
        assert len(x.spans.split(",")) * bool(x.spans) == x.n_email + x.n_ip + x.n_card + x.n_phone + x.n_discovered


def test_patterns_are_learned(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    found = {(x.pattern, pii.KINDS[x.kind]) for x in pii.learned(df).collect()}
    assert {("charge card _", "card"), ("me at _", "phone")} <= found


def test_very_long_texts(spark):
    """Hundreds of thousands of characters that a pattern with second tries would never end on."""
    texts = [x * (400_000 // len(x)) for x in LONG] + ["a@" + "b." * 200_000 + "c"]
    found = pii.digests(pii.found_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    got = {x.doc_id: (x.n_email, x.n_ip, x.n_card, x.n_phone) for x in found}
    assert got == {**{i: (0, 0, 0, 0) for i in range(len(LONG))}, 6: (0, 50_000, 0, 0), len(LONG): (1, 0, 0, 0)}


def test_empty_table(spark):
    assert pii.digests(pii.found_spans(spark.createDataFrame([], ROWS))).count() == 0
