"""Fill-in-the-middle against a plain loop and its SQL."""

import hashlib
import random

from segscore.llm import infill

ROWS = "doc_id long, text string, n string, _text int, blocks string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def by_hand(doc_id, text) -> tuple:
    t = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, sha(t), sha(t)
    p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
    spm = h4 % 100 < 20
    return doc_id, len(t), "spm" if spm else "psm", a, b - a, sha(s + p + m if spm else p + s + m), sha(t)


def rows() -> list[tuple]:
    r = random.Random(3)
    lengths = [0, 1, 2, 3, 50, 4095, 4096, 4097, 8192, 8193, 20000]
    out = [(i, "".join(r.choice("ab\n é😀<PSM>\ŕ ") for _ in range(lengths[i % 11]))) for i in range(220)]
    out += [(None, "no id"), (None, None), (5, None), (5, ""), (6, "x<S"), (7, "a<M>b"), (8, "😀" * 200_000), (9, "<P"), (10, "same"), (10, "same")]
    return out


def test_cuts_forms_and_restoration(spark):
    df = spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows()], ROWS)
    got = sorted(map(tuple, infill.digests(infill.arrange(df)).collect()), key=str)
    want = sorted((by_hand(*x) for x in rows()), key=str)
    assert got == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_output_keeps_whole_texts(spark):
    df = spark.createDataFrame([(i, f"text {i} <P" + "é" * i) for i in range(60)], "doc_id long, text string")
    arranged = infill.arrange(df, rate=100)
    assert arranged.select((arranged["output"].contains("<M>")).alias("m")).where("not m").count() == 0
    back = arranged.select("doc_id", infill.restored(arranged["output"], arranged["form"]).alias("text"))
    assert {tuple(x) for x in back.collect()} == {tuple(x) for x in df.collect()}


def test_empty_table(spark):
    assert infill.digests(infill.arrange(spark.createDataFrame([], ROWS))).count() == 0
