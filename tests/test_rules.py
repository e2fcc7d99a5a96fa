"""Rules on exports, offsets, errors and gates: single cases by hand."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from segscore.functions import text as T
from segscore.operators import calllog as L
from segscore.operators import checks as K
from segscore.sources import listing


def test_offsets_round_trip_with_wide_characters(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab é\n😀𝒳") for _ in range(r.randint(0, 30))) for _ in range(40)] + ["", "😀", "😀😀"]
    rows = [(i, t, p) for i, t in enumerate(texts) for p in range(len(t) + 1)]
    df = spark.createDataFrame(rows, "i long, t string, p long").withColumn("u", T.utf16_offset(F.col("t"), F.col("p")))
    for x in df.withColumn("b", T.code_point_offset(F.col("t"), F.col("u"))).collect():
        assert x.u == len(x.t[: x.p].encode("utf-16-be")) // 2 and x.b == x.p
    half = [(t, u) for t in texts for u in range(len(t.encode("utf-16-be")) // 2 + 2)]
    for x in spark.createDataFrame(half, "t string, u long").withColumn("b", T.code_point_offset(F.col("t"), F.col("u"))).collect():
        assert x.b == len(x.t.encode("utf-16-be")[: 2 * x.u].decode("utf-16-be", "replace")), (x.t, x.u)
    spans = spark.createDataFrame([("a😀b😀", [(0, 1), (1, 4)])], "t string, s array<struct<start:long,end:long>>")
    assert [tuple(s) for s in spans.select(T.utf16_spans(F.col("t"), F.col("s")).alias("s")).first().s] == [(0, 1), (1, 6)]


def test_export_rules_fire_once_each(spark):
    text = "The licence 😀 ends."
    good = {"text_sha256": hashlib.sha256(text.encode()).hexdigest(), "checklist": {"A": "marked", "B": "not present"}, "spans": [{"category": "A", "start": 0, "end": len(text)}]}
    span = good["spans"][0]
    cases = [
        (good, []),
        (good | {"text_sha256": None}, [("text", "text_sha256")]),
        (good | {"checklist": {"A": "marked"}}, [("missing", "checklist.B")]),
        (good | {"checklist": {**good["checklist"], "C": "marked"}}, [("disagrees", "checklist.C"), ("unknown", "checklist.C")]),
        (good | {"checklist": {"A": "marked", "B": "maybe"}}, [("state", "checklist.B")]),
        (good | {"spans": [span, {**span, "category": "Z"}]}, [("category", "spans.1")]),
        (good | {"spans": [span, {**span, "start": 1.5}, {**span, "end": "9"}, {"category": "A", "end": 3}, {**span, "start": True}]}, [("type", f"spans.{i}") for i in (1, 2, 3, 4)]),
        (good | {"spans": [span, {**span, "start": -1}, {**span, "end": len(text) + 1}, {**span, "start": 3, "end": 3}]}, [("range", f"spans.{i}") for i in (1, 2, 3)]),
        (good | {"spans": []}, [("disagrees", "checklist.A")]),
        (good | {"checklist": {"A": "not present", "B": "not present"}}, [("disagrees", "checklist.A")]),
        ([], [("json", "")]),
    ]
    rows = [(i, json.dumps(e)) for i, (e, _) in enumerate(cases)] + [(90, "no json"), (91, None), (92, json.dumps(good))]
    texts = [(i, text) for i in range(len(cases))] + [(90, text), (91, text)]
    got: dict = {}
    for x in K.export_violations(spark.createDataFrame(rows, "id long, export string"), spark.createDataFrame(texts, "id long, text string"), "id", ["A", "B"]).collect():
        got.setdefault(x.id, []).append((x.rule, x.path))
    for i, (_, want) in enumerate(cases):
        assert sorted(got.get(i, [])) == sorted(want), i
    assert got[90] == got[91] == [("json", "")] and ("text", "text_sha256") in got[92]


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((10.0, 50.0, 20.0, True, False), ("neither", False, None)),
        ((10.0, 50.0, 20.0, True, True), ("both", False, None)),
        ((60.0, 50.0, 20.0, True, True), ("both", True, "second")),
        ((90.0, 55.0, 20.0, True, True), ("both", True, "second, decide")),
        ((10.0, 50.0, 20.0, False, True), ("second", False, None)),
        ((120.0, 50.0, 20.0, True, True), ("second", True, "neither")),
        ((140.0, 50.0, 20.0, True, True), ("neither", False, None)),
    ],
)
def test_gate(spark, row, want):
    df = spark.createDataFrame([row], "s double, b double, o double, x boolean, y boolean")
    assert tuple(df.select(L.gate(F.col("s"), F.col("b"), F.col("o"), F.col("x"), F.col("y"), 100.0, 150.0).alias("g")).first().g) == want


def test_errors_and_costs(spark):
    said = {"HTTPStatusError: Client error '403 Forbidden' for": True, "HTTPStatusError: Client error '400 Bad' for": False, "RuntimeError: gave up after": False, "ValueError: x": True}
    got = spark.createDataFrame([(m,) for m in said], "m string").select("m", L.is_setup_error(F.col("m")).alias("s")).collect()
    assert {x.m: x.s for x in got} == said
    cost = spark.range(1).select(L.prompt_cost(F.lit(5000), F.lit(1000), F.lit(500), {"input": 2.0, "cached": 0.5, "output": 10.0})).first()[0]
    assert cost == pytest.approx((4000 * 2 + 1000 * 0.5 + 500 * 10) / 1e6)
    df = spark.createDataFrame([("a", True)], "key string, done boolean")
    none = spark.createDataFrame([], "key string, segment_id string")
    fine = spark.createDataFrame([("a", 5, 10.0, None)], "key string, output long, latency_ms double, retry_errors array<string>")
    assert L.smoke_reasons(df, fine, none, 9, 99.0).count() == 0


def test_a_hit_is_listed_once(spark, tmp_path):
    hit = lambda i, **s: {"_id": i, "_source": s}
    pages = [{"query": "q", "offset": 0, "hits": {"total": {"value": 3, "relation": "eq"}, "hits": [hit("1:a", ciks=["7", "8"], file_type="EX"), hit("2:b:c", ciks=[])]}}, {"query": "q", "offset": 2, "hits": {"total": {"value": 3, "relation": "gte"}, "hits": [hit("1:a", ciks=["9"]), hit("3:d", file_type=None)]}}, {"query": "r", "offset": 0, "hits": {"total": {"value": 0, "relation": "eq"}, "hits": []}}, {"query": "s"}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, pages)))
    found = listing.read_pages(spark, str(tmp_path))
    assert sorted(tuple(x) for x in listing.hits(found).collect()) == [("1", "a", "7", "EX"), ("2", "b:c", "", ""), ("3", "d", "", "")]
    told = {x.query: (x.total, x.truncated, x.pages, x.distinct_hits) for x in listing.report(found, 10).collect()}
    assert told == {"q": (3, True, 2, 3), "r": (0, False, 1, 0), "s": (None, None, 1, 0)}
