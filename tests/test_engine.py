"""Hand-computed cases, equivalences, and a DuckDB comparison of a few queries at the smallest scale."""

import random

import pytest
from pyspark.sql import functions as F

from segscore.functions import text as T
from segscore.functions.agreement import span_f1
from segscore.functions.hashing import draw
from segscore.operators import bootstrap as B
from segscore.operators import calllog as L
from segscore.operators import curation as C
from segscore.operators import drift as D
from segscore.operators import intervals as I
from segscore.operators import metrics as M
from segscore.operators import ordered
from segscore.operators import sampling as S
from segscore.operators import thresholds as H
from segscore.plans import world as P
from segscore.sources import io
from segscore.sources.scorer import KeywordScorer, Registry, probabilities

TOY_Y, TOY_P = [[1, 0], [1, 1], [0, 1], [0, 0]], [[1, 0], [0, 1], [1, 1], [0, 0]]
SCORES = [[0.9, 0.1], [0.4, 0.8], [0.6, 0.7], [0.1, 0.2]]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, i, "AB"[j], bool(TOY_Y[i][j]), SCORES[i][j], bool(TOY_P[i][j])) for i in range(4) for j in range(2)]
    return spark.createDataFrame(rows, "segment_id long, contract_id long, label string, y boolean, p double, pred boolean").cache()


def test_scores_by_hand(toy):
    f1 = {r.label: r.f1 for r in M.prf(M.label_counts(toy, ["label"])).collect()}
    assert f1 == {"A": 0.5, "B": 1.0}
    s = M.macro_micro(M.label_counts(toy, ["label"]), []).first()
    assert (s.macro_f1, s.micro_f1) == (0.75, 0.75)
    assert M.none_counts(toy, []).first().none_fp == 0
    ap = {r.label: r.ap for r in M.average_precision(toy, ["label"]).collect()}
    assert ap["A"] == pytest.approx(5 / 6) and ap["B"] == 1.0


def test_weights_equal_duplication(toy, spark):
    w = spark.createDataFrame([(0, 0, 2), (0, 2, 1)], "resample int, contract_id long, w int")
    got = B.resampled(M.label_counts(toy, ["contract_id", "label"]), w, "contract_id", ["label"], ["tp", "fp", "fn"])
    twice = toy.where("contract_id = 0").unionAll(toy.where("contract_id in (0, 2)"))
    want = M.label_counts(twice, ["label"])
    assert {(r.label, r.tp, r.fp, r.fn) for r in got.collect()} == {(r.label, r.tp, r.fp, r.fn) for r in want.collect()}


def test_bootstrap_draws(spark):
    c = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(30)], "id long, t string")
    a = B.weights(c, "id", "t", 7, "s").cache()
    assert {r.n for r in a.groupBy("resample").agg(F.sum("w").alias("n")).collect()} == {30}
    per = a.join(c, "id").groupBy("resample", "t").agg(F.sum("w").alias("n"))
    assert {r.n for r in per.collect()} == {10}
    again = B.weights(c.orderBy(F.desc("id")), "id", "t", 7, "s")
    assert a.exceptAll(again).isEmpty() and not a.exceptAll(B.weights(c, "id", "t", 7, "other")).isEmpty()


def test_a_model_never_differs_from_itself(spark):
    s = spark.createDataFrame([(i, i / 10) for i in range(20)], "resample int, f double")
    r = B.paired(s, s, ["f"], 12).first()
    assert (r.low, r.high, r.claim, r.n) == (0, 0, "none", 20)


def test_thresholds(spark):
    long = spark.createDataFrame([("A", 0.9, True), ("A", 0.8, True), ("A", 0.3, False), ("A", 0.2, False)], "label string, p double, y boolean")
    assert H.best_f1(long, ["label"]).first().threshold == 0.5
    rule = spark.createDataFrame([("A", 0.85)], "label string, threshold double")
    r = H.high_recall(long, rule).first()
    assert (r.t90, r.threshold, r.recall) == (0.8, 0.8, 1.0)


def test_grid_bins_agree_with_comparison(spark):
    values = [i / 100 for i in range(101)] + [random.Random(1).random() for _ in range(500)] + [0.29, 0.57, 0.58, 1.1 * 0.1]
    got = spark.createDataFrame([(v,) for v in values], "p double").select("p", H.grid_bin(F.col("p")).alias("i")).collect()
    assert all(r.i == max(i for i in range(0, 101) if i / 100.0 <= r.p) for r in got)


def test_intervals(spark):
    s = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 10, 12), ("a", 11, 11), ("b", 3, 4)], "k string, start long, end long")
    assert {tuple(r) for r in I.union_intervals(s, ["k"]).collect()} == {("a", 0, 8), ("a", 10, 12), ("b", 3, 4)}
    r = random.Random(5)
    made = lambda n, a, z: spark.createDataFrame([(r.randint(0, 2), x := r.randint(0, 300), x + r.randint(1, 90)) for _ in range(n)], f"k int, {a} long, {z} long")
    x, y = made(60, "s_start", "s_end").cache(), made(50, "g_start", "g_end").cache()
    assert sorted(map(tuple, I.overlap_join(x, y, "k").collect())) == sorted(map(tuple, I.overlap_join(x, y, "k", bucket=37).collect()))



def test_segments_cover_the_text():
    r = random.Random(8)
    for _ in range(300):
        t = "".join(r.choice(["word ", "Ab. ", "\n", "\n\n", "x" * 40, ";", " ", "Long sentence here. "]) for _ in range(r.randint(0, 120)))
        spans = T.segment_spans(t, 20, 200)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert "".join(t.split()) == "".join("".join(t[a:b] for a, b in spans).split())
        assert len(spans) <= 1 or all(b - a >= 20 for a, b in spans)
    assert T.segment_spans("") == [] and T.segment_spans(" \n ") == []
    assert T.segment_spans("Title\n\nBody of the text that is long enough to stand alone.") == [(0, 59)]


def test_line_table(spark):
    d = spark.createDataFrame([(1, "a\n\n\n  b \nc\n"), (2, ""), (3, "\n\nx")], "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.start, r.end, r.line, r.blank_before) for r in T.line_table(d).collect())
    assert got == [(1, 0, 0, 1, "a", False), (1, 1, 6, 7, "b", True), (1, 2, 9, 10, "c", False), (3, 0, 2, 3, "x", True)]


def test_html(spark):
    assert T.html_to_text("<p>A&amp;B</p><script>x</p></script><div> c \xa0 d<br>e</div>") == "A&B\n\nc d\ne\n"
    assert T.html_to_text("<p>a<script>\n</script>b</p>") == "ab\n"  # a line end that is data, and silent
    assert T.html_to_text("a<style>\n</style>\n<br>b") == "a\n\nb\n"
    d = spark.createDataFrame([("<style>a",), (None,), ("x",)], "h string").select(T.html_text("h").alias("t")).select("t.*")
    assert [tuple(r) for r in d.collect()] == [(None, "a script or style has no end"), (None, None), ("x\n", None)]
    raw = spark.createDataFrame([(b"\xe2\x82\xac",), (b"\x80",)], "b binary").select(T.decoded(F.col("b")).alias("t"))
    assert [r.t for r in raw.collect()] == ["€", "€"]


def test_quotas(spark):
    counts = {"License": 40, "Service": 28, "Supply": 12, "Agency": 10, "Affiliate": 10}
    want = {"License": 4, "Service": 3, "Supply": 1, "Agency": 1, "Affiliate": 1}
    assert S.quotas_with_capacity(counts, 10, dict.fromkeys(counts, 10)) == want
    df = spark.createDataFrame(list(counts.items()), "t string, n long")
    assert {r.t: r.slots for r in S.quotas(df, "t", "n", 10).collect()} == want
    assert S.quotas_with_capacity({"A": 1, "B": 1}, 1, {"A": 1, "B": 1}) == {"A": 1, "B": 0}
    assert S.quotas_with_capacity({"A": 9, "B": 1}, 4, {"A": 1, "B": 9}) == {"A": 1, "B": 3}
    with pytest.raises(ValueError):
        S.quotas_with_capacity({"A": 1}, 2, {"A": 1})


def test_splits(spark):
    items = spark.createDataFrame([(i, "abcd"[i % 4] if i < 40 else "e") for i in range(53)], "id long, t string")
    a = {r.id: r.split for r in S.stratified_split(items, "id", "t").collect()}
    assert a == {r.id: r.split for r in S.stratified_split(items.orderBy(F.desc("id")), "id", "t").collect()}
    assert len(a) == 53 and [sum(v == s for v in a.values()) for s in ("train", "val", "test")] == [32, 11, 10]


def test_shingles(spark):
    d = spark.createDataFrame([("a b c d e f g h i",), ("a b",), ("",)], "t string")
    assert [r.n for r in d.select(F.size(T.shingles(F.col("t"))).alias("n")).collect()] == [2, 0, 0]


def test_phrases(spark):
    d = spark.createDataFrame([("Hosting Services Agreement",), ("Co-Branding and Marketing Agreement",), ("EX-10.1",), (None,)], "t string")
    p = {"services agreement": "Service", "hosting services agreement": "Hosting", "co-branding": "Co", "marketing agreement": "Marketing"}
    assert [(r.type, r.type_status) for r in C.phrase_class(d, p, F.col("t")).collect()] == [("Hosting", "one"), (None, "ambiguous"), (None, "none"), (None, "none")]


def test_responses():
    ok = '{"segments":[{"id":"S1","labels":[{"label":"a","confidence":0.9},{"label":"a","confidence":0.4},{"label":"b","confidence":0.05}]}]}'
    check = lambda t, finish="ok", ids=("S1",), **k: L.validate_response(t, finish, list(ids), {"a", "b"}, **k)
    assert check(ok) == {"scores": {"S1": {"a": 0.9}}, "errors": []}
    assert check(ok, ids=("S1", "S2"))["errors"] == ["missing@S2"]
    assert check("{", "ok")["scores"] == {} and check(ok, "max_tokens")["errors"] == ["finish:max_tokens"]
    assert check('{"segments":{"S1":{"a":1,"b":0}}}', dense=True)["scores"] == {"S1": {"a": 1.0, "b": 0.0}}
    for bad in ('{"segments":[{"id":"S1","labels":[{"label":"z","confidence":1}]}]}', '{"segments":[{"id":"S1","labels":[{"label":"a","confidence":true}]}]}', '{"segments":[{"id":"S1","labels":[]},{"id":"S1","labels":[]}]}', '{"segments":[{"id":"S1","labels":3}]}'):
        r = check(bad)
        assert r["scores"] == {} and r["errors"]


def test_agreement():
    r = random.Random(14)
    for _ in range(300):
        made = lambda: sorted((x := r.randint(0, 40), x + r.randint(1, 15)) for _ in range(r.randint(0, 8)))
        a, b = made(), made()
        for strict in (False, True):
            taken: set[int] = set()
            for s, e in a:  # the definition: the first free partner in order
                both = lambda j, s=s, e=e: (min(e, b[j][1]) - max(s, b[j][0]), e - s, b[j][1] - b[j][0])
                fits = lambda j: (c := both(j))[0] > 0 and (all if strict else any)(2 * c[0] >= n for n in c[1:])
                hit = next((j for j in range(len(b)) if j not in taken and fits(j)), None)
                taken |= {hit} - {None}
            want = 2 * len(taken) / (len(a) + len(b)) if a or b else None
            assert span_f1(a[::-1], b[::-1], strict) == want
    assert span_f1([], []) is None and span_f1([(0, 10)], [(4, 30)]) == 1.0 and span_f1([(0, 10)], [(4, 30)], strict=True) == 0.0
    assert span_f1([(0, 10), (0, 10)], [(0, 10)]) == pytest.approx(2 / 3)


def test_span_agreement_by_islands(spark):
    import __spark_entry__ as e
    from segscore.queries import spans

    d = "/root/testdata/sf0.001"
    sides: dict = {}
    for x in spans(spark, d).collect():
        sides.setdefault(x.user_id, ([], []))[x.event_id % 2].append((x.start, x.end))
    got = {x.user_id: x.f1 for x in e.queries()["span_agreement"](spark, d).collect()}
    assert got.keys() == sides.keys()
    assert all(got[u] == pytest.approx(span_f1(*v), abs=1e-6) for u, v in sides.items())


def test_label_segments_by_hand(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    marks = {k: [(c, i, i + 40) for c, w in (("license", "Licensed"), ("rights", "Copyright")) for i in range(len(t)) if t.startswith(w, i)] for k, t in texts.items()}
    rows = e.queries()["label_segments"](spark, d).collect()
    assert any(x.labels for x in rows)
    for x in rows:
        want = set()
        for c in ("license", "rights"):
            common = [min(x.g_end, z) - max(x.g_start, a) for k, a, z in marks[x.doc_id] if k == c]
            common = [v for v in common if v > 0]
            if common and (max(common) >= 20 or sum(common) * 2 >= x.g_end - x.g_start):
                want.add(c)
        assert x.labels == ",".join(sorted(want))


def test_numbers_do_not_depend_on_bounds(spark):
    r = random.Random(3)
    rows = [(f"k{r.randint(0, 10**6)}", "ab"[i % 2]) for i in range(200)] + [(None, "a")]
    df = spark.createDataFrame(sorted(set(rows), key=str), "k string, s string")
    for parts in (1, 3, 20):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {(x.s, x.k): (x._i, x._n) for x in ordered.numbered(df, "k", "s").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        for s in "ab":
            own = sorted((k for z, k in got if z == s), key=lambda k: (k is not None, k or ""))
            assert [got[(s, k)] for k in own] == [(i, len(own)) for i in range(len(own))]


def test_checks(spark):
    from segscore.operators import checks as K

    a = spark.createDataFrame([(1, "x", 3.0), (1, "x", 3.0), (2, "y", 1.0)], "id long, t string, v double")
    b = spark.createDataFrame([(1, "x", 3.5), (3, "z", 1.0)], "id long, t string, v double")
    got = {x.check: x.n for x in K.pair_audit(a, b, ["id"], ["t", "v"]).collect()}
    assert got == {"only a": 1, "only b": 1, "t differs": 0, "v differs": 2, "repeated in a": 1, "repeated in b": 0}
    assert {tuple(x) for x in K.not_covered_once(a, b, ["id"]).collect()} == {(2, 0), (3, None)}
    with pytest.raises(K.Refused):
        K.refuse(K.differing(a.union(b), ["id"], "v"), "v")
    K.refuse(K.differing(a, ["id"], "v"), "v")
    t = spark.createDataFrame([(1, "a b", " a b "), (2, "a", "a"), (3, "a", "b"), (4, None, "b")], "id long, x string, y string")
    assert {x.id: x.kind for x in K.text_match(t, t, "id", "x", "y").collect()} == {1: "stripped", 2: "exact", 3: "different", 4: "missing"}
    p = spark.createDataFrame([(0.9, 0.9), (0.2, 0.6)], "a double, b double")
    r = K.parity(p, [], "a", "b", 0.5).first()
    assert (r.pairs, r.disagreements, r.flagged, r.passed) == (2, 1, 2, False) and r.max_diff == pytest.approx(0.4)
    assert K.bad_fractions(spark.createDataFrame([(0.6,), (0.2,), (0.2,)], "f double"), "f").count() == 0
    assert K.bad_fractions(spark.createDataFrame([(0.6,)], "f double"), "f").count() == 1


def test_costs_and_settings(spark, tmp_path):
    e = spark.createDataFrame([({"input": 1_000_000, "cached": 2_000_000, "thinking": 1_000_000},)], "m map<string,long>")
    cost = lambda **p: e.select(L.call_cost("m", p).alias("c")).first().c
    assert cost(input=3, output=15, cached=0.3) == pytest.approx(3 + 0.6 + 15) and cost(input=3, output=15) == pytest.approx(9 + 15)
    assert io.settings({"A": "x, y", "N": ""}, {"A": "", "B": "z"}, {"N": 1.5}) == {"A": ["x", "y"], "B": ["z"], "N": 1.5}
    c = io.ResponseCache(spark, str(tmp_path / "cache"))
    c.save(spark.createDataFrame([("k", "2024-01-01 00:00:00", "old"), ("k", "2024-01-02 00:00:00", "new")], "key string, at string, record string"))
    got = c.load(spark.createDataFrame([("k",), ("miss",)], "key string")).collect()
    assert {x.key: x.record for x in got} == {"k": "new", "miss": None}
    d = spark.createDataFrame([(1, 'a "b", c')], "i long, t string")
    io.write_csv(d, str(tmp_path / "csv"))
    assert io.read_csv(spark, str(tmp_path / "csv"), "i long, t string").collect() == d.collect()
    names = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "x"), (4, "q")], "k long, n string")
    titles = spark.createDataFrame([("ab",), ("abc",), ("xy",), ("xz",)], "t string")
    assert {tuple(r) for r in C.unique_prefix(names, "k", "n", titles, "t").collect()} == {(1, "ab", "exact")}
    assert {tuple(r) for r in C.unique_prefix(names.where("k = 4 or k = 2"), "k", "n", titles.where("t <> 'ab'"), "t").collect()} == {(2, "abc", "prefix")}


def test_verdicts_and_detection(spark):
    c = lambda *x: spark.createDataFrame(list(enumerate(x)), "metric long, claim string")
    told = lambda *x: B.verdict(c(*x)).first().verdict
    assert told("A", "A") == "A" and told("A", "none") == "per metric: 0 A, 1 none"
    assert told("none", "none") == "per metric: 0 none, 1 none" and told("A", None) == "per metric: 0 A, 1 none"
    i = spark.createDataFrame([("test", 0.1, 0.2), ("shift", 0.25, 0.4)], "part string, low double, high double")
    assert D.detected(i).first().detected and not D.detected(i.withColumn("high", F.lit(0.3))).first().detected


def test_drift(spark):
    h = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "b double, r double")
    assert D.psi(h, 2).first().psi == pytest.approx(0) and D.js_distance(h).first().js == pytest.approx(0)
    none = spark.createDataFrame([(0.0, 1.0)], "b double, r double")
    assert D.psi(none, 2).first().psi is None and D.js_distance(none).first().js is None
    null = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    vals = spark.createDataFrame([(1, 2.0), (2, 9.0), (3, None)], "id int, v double")
    assert {r.id: r.p for r in D.upper_p(null, vals, "id", "v").collect()} == {1: 4 / 5, 2: 1 / 5, 3: 1.0}
    t = D.tie_safe_threshold(spark.createDataFrame([(0.1,), (0.1,), (0.5,), (0.9,)], "s double"), "s", 0.5).first()
    assert (t.threshold, t.null_share) == (0.1, 0.5)


def test_nearest_ties_go_to_the_smaller_key(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [3.0, 0.0])], "id long, v array<double>")
    assert {r.id: r.neighbour for r in C.nearest(v, "id", "v", block=2).collect()} == {1: 3, 3: 1, 4: 1, 2: 1}


def test_scorer_keeps_order(spark):
    s = KeywordScorer({"a": ["x"], "b": ["yy"]})
    texts = ["x yy", "", "long text with x", None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(probabilities(s)(F.col("t")).alias("p")).collect()]
    assert got == s.score([t or "" for t in texts]).tolist()
    r = Registry()
    r.load("ok", lambda: s)
    r.load("bad", lambda: 1 / 0)
    assert list(r.loaded) == ["ok"] and "ZeroDivisionError" in r.failed["bad"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"data":[{"title":"T","paragraphs":[{"context":"ab cd","qas":[{"id":"T__X","is_impossible":false,"answers":[{"text":"cd","answer_start":3}]},{"id":"T__Y","is_impossible":true,"answers":[]}]}]}]}')
    c = io.read_corpus(spark, str(tmp_path / "c.json"))
    assert sorted((r.category, r.answer_start, r.answer_end) for r in io.spans(c).na.fill(-1).collect()) == [("X", 3, 5), ("Y", -1, -1)]
    assert io.contexts(c).first().text == "ab cd"
    rows = spark.createDataFrame([("1_0", 1, "test", 0, 5, ["a"], [0.9, 0.2], 1.0, 0.0)], "segment_id string, contract_id long, split string, start long, end long, true_labels array<string>, proba array<double>, latency_ms double, cost_usd double")
    p = io.prediction_frame(rows, ["a", "b"], {"a": 0.5, "b": 0.5}, "m", "v1")
    io.write_predictions(p, str(tmp_path / "p"), ["a", "b"], {"k": "v"})
    back, order, notes = io.read_predictions(spark, str(tmp_path / "p"))
    assert order == ["a", "b"] and notes == {"k": "v"} and back.first().pred_labels[0].label == "a" and back.first().parse_failure is False
    with pytest.raises(ValueError):
        io.conformed(rows)
    io.append_ledger(spark.createDataFrame([(1.5,)], "cost_usd double"), str(tmp_path / "l"))
    io.append_ledger(spark.createDataFrame([(2.0,)], "cost_usd double"), str(tmp_path / "l"))
    assert io.ledger_total(spark, str(tmp_path / "l")) == 3.5
    files = io.walk(spark, str(tmp_path), "*.json")
    assert len(io.fingerprint(files.where("path like '%c.json'")).first().version) == 12


def test_stream(spark, tmp_path):
    from segscore.streaming.drift import monitor

    ref = spark.createDataFrame([(i % 3,) for i in range(30)], "bin int")
    ref.write.parquet(str(tmp_path / "in"))
    q = monitor(spark.readStream.schema(ref.schema).parquet(str(tmp_path / "in")), ref, "bin", 3, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r.n for r in rows) == 30 and rows[0].psi == pytest.approx(0, abs=1e-9)


def test_draws_depend_on_seed_and_stream(spark):
    r = spark.range(50).select(draw("a", "id").alias("a"), draw("b", "id").alias("b"), draw("a", "id", seed=1).alias("c")).collect()
    assert len({x.a for x in r}) == 50 and all(x.a != x.b != x.c for x in r)


DUCK = ["per_label_prf", "dense_key", "phrase_classify", "calibration_bins", "stratified_split", "bootstrap_weights", "interval_union", "line_table", "psi", "null_pvalues"]


@pytest.mark.parametrize("name", DUCK)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "documents", "events", "part"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = e.queries()[name](spark, d)
    cols = sorted(df.columns)
    rel = con.execute(e.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    norm = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_classify(spark):
    docs = spark.createDataFrame([(1, "The license of this text is long enough to be one segment, and it stands alone."), (2, None)], "doc_id long, text string")
    out = P.classify_documents(docs, KeywordScorer({"license": ["license"], "zebra": ["zebra"]}), {"license": 0.5, "zebra": 0.5}).collect()
    assert [[f.label for f in r.flags] for r in out] == [["license"]]
