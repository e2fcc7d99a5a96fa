"""Conversation repair against a plain loop without blocks, signatures or joins."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from segscore.llm import repair

ROWS = "conv_id long, turn long, role string, text string, block string, _c string"
EMPTY = hashlib.sha256(b"").hexdigest()


def by_hand(rows: list[tuple]) -> dict:
    """The contract, conversation by conversation."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        mine += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: solve(mine) for c, mine in convs.items()}


def solve(rows: list[tuple]) -> tuple:
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not shown else "d" if (role, text) in seen else "" if shown[-1] in ".!?" else "t")
        seen.add((role, text))
    initials = [x[1][:1] for x in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i: int, state: str, new: int):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        moves = []
        if i < len(rows):
            moves.append((2, "D", i + 1, state, None))
            if faults[i] not in ("b", "d"):
                extra = 5 if faults[i] == "t" else 0
                moves.append((extra, "K", i + 1, step.get((state, initials[i])), rows[i][1] + ":" + rows[i][2]))
                moves += [(1 + extra, "R", i + 1, step.get((state, r[0])), r + ":" + rows[i][2]) for r in ("user", "assistant")]
        if new < 3:
            moves += [(5, "I", i, step.get((state, r[0])), r + ":") for r in ("user", "assistant")]
        for cost, letter, at, then, said in moves:
            if then is not None and (rest := best(at, then, new + 1 if letter == "I" else 0)):
                found.append((cost + rest[0], letter + rest[1], (*([said] if said is not None else []), *rest[2])))
        return min(found) if found else None

    cost, audit, said = best(0, "", 0)
    turns = [x[0] for x in rows if x[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def rows() -> list[tuple]:
    r = random.Random(5)
    said = ["Yes.", "No!", "cut off", "what?", "", " \n\t", None, "end. \n", "é…", "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    out = []
    for conv in range(120):
        for turn in range(r.randint(1, 14)):
            role = r.choice(roles) if conv % 3 else ["user", "assistant"][turn % 2]
            out.append((conv, turn * r.choice([1, 1, 1, 3]), role, r.choice(said) if conv % 2 else f"Text {turn}."))
    out += [(200, None, "user", "a."), (200, None, "system", "b."), (200, 3, "user", "a."), (None, 1, "user", "x."), (None, None, None, None), (None, 2, "assistant", "y.")]
    out += [(201, 1, "user", "same."), (201, 1, "user", "same."), (201, 1, "user", "same."), (201, 2, "assistant", "same.")] + [(202, 0, "user", "")] * 9
    out += [(203, i, ["user", "assistant"][i % 2], f"{i} " + "long " * 3000 + ".") for i in range(6)]
    out += [(c, c % 7, "user", "dropped?") for c in range(300, 360)]  # some have no row left
    return out


def check(spark, block: int) -> None:
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows()], ROWS).repartition(3)
    got = {x.conv_id: tuple(x)[1:] for x in repair.report(df, block, harm=True).collect()}
    want = by_hand(rows())
    assert got.keys() == want.keys()
    assert [(c, got[c], want[c]) for c in want if got[c] != want[c]] == []
    assert (0, 0, 0, 0, 0, 0, "", EMPTY) in want.values()
    back: dict = {}
    for x in repair.repaired(df, block, harm=True).collect():
        back.setdefault(x.conv_id, []).append((x.position, f"{x.role}:{x.text}", x.role[:1]))
    for c, w in want.items():
        said = sorted(back.get(c, []))
        assert hashlib.sha256("\n".join(x[1] for x in said).encode()).hexdigest() == w[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[2] for x in said))


def test_sound_conversations_stay(spark):
    sound = [(c, t, ["system", "user", "assistant"][t], f"Said {c} {t}.") for c in range(40) for t in range(3)]
    df = spark.createDataFrame(sound, "conv_id long, turn long, role string, text string")
    assert sorted((x.conv_id, x.position, x.role, x.text) for x in repair.repaired(df).collect()) == sound
    assert {(x.cost, x.audit) for x in repair.report(df).collect()} == {(0, "KKK")}


def test_whole_signatures(spark):
    check(spark, repair.BLOCK)


def test_blocks_meet(spark):
    check(spark, 3)  # nearly every conversation has several blocks


def test_long_conversations_in_blocks():
    """The recursion over blocks gives the same as one over all rows, with the state and costs carried between them."""
    r, cheapest = random.Random(9), repair.Solver()
    for _ in range(300):
        whole = "".join(r.choice("suaxSUAXdduaua") for _ in range(r.randint(0, 30))) + "."
        want = cheapest(whole, 0, repair.END)
        size = r.randint(1, 5)
        parts = [whole[i : i + size] for i in range(0, len(whole) - 1, size)] or [""]
        parts[-1] = parts[-1].rstrip(".") + "."
        rests = [repair.END]
        for p in reversed(parts[1:]):
            rests.append(tuple(cheapest(p, s, rests[-1])[0] for s in range(4)))
        state, cost, audit = 0, 0, ""
        for p, rest in zip(parts, reversed(rests), strict=True):
            c, a, last = cheapest(p, state, rest)
            cost, audit, state = cost + c - rest[last], audit + a, last
        assert (cost, audit) == want[:2]


def test_a_full_memo_starts_anew(monkeypatch):
    r = random.Random(4)
    strings = ["".join(r.choice("suaxSUAXd") for _ in range(12)) + "." for _ in range(50)]
    want = [repair.Solver()(x, 0, repair.END) for x in strings]
    monkeypatch.setattr(repair.Solver, "MOST", 200)
    small = repair.Solver()
    assert [small(x, 0, repair.END) for x in strings] == want


def test_empty_table(spark):
    assert repair.report(spark.createDataFrame([], ROWS)).count() == 0
    assert repair.repaired(spark.createDataFrame([], ROWS)).count() == 0
