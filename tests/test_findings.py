"""Small cases of a reviewer's findings: each failed before its fix."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as e
from segscore.operators import curation as C
from segscore.operators import framedraw as V
from segscore.operators import metrics as M
from segscore.sources.written import folder


def events_in(spark, folder, rows):
    """A folder with `events`: rows of (user_id, minute, event_type, value)."""
    at = datetime.datetime(2024, 1, 1)
    told = [(i, at + datetime.timedelta(minutes=m), u, t, v, "{}") for i, (u, m, t, v) in enumerate(rows)]
    spark.createDataFrame(told, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def against_sql(spark, folder, name):
    """Rows of a query, and of its SQL, in order; NaN by its name."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from '{folder}/events.parquet/*.parquet'")
    df = e.queries()[name](spark, folder)
    rel = con.execute(e.oracle_sql()[name])
    at = [[x[0] for x in rel.description].index(c) for c in df.columns]
    norm = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted(str(tuple(map(norm, r))) for r in df.collect()), sorted(str(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())


def test_means_do_not_hang_on_the_order_of_sums(spark, tmp_path):
    # Doubles sum seven times 0.05 up to less than 0.35, so that the mean fell under the tie.
    d = events_in(spark, tmp_path, [(1, i, "view", 0.05) for i in range(7)] + [(2, 0, "view", 0.1)])
    got = {r.user_id: (r.v, r.p) for r in e.queries()["null_pvalues"](spark, d).collect()}
    assert got == {1: (0.1, 1.0)}


#: Users without any value, odd and even, beside NaN, infinity, values under 0 and an unknown user.
ODD = [(1, 0, "view", None), (2, 0, "view", None), (3, 0, "view", 9.0), (3, 1, "view", None), (4, 0, "view", 9.0), (5, 0, "view", float("nan")), (6, 0, "view", 1.0), (7, 0, "view", -2.25), (8, 0, "view", -2.25), (9, 0, "view", float("inf")), (11, 0, "click", None), (None, 0, "view", 5.0)]


def test_users_without_values_have_p_values_as_in_sql(spark, tmp_path):
    got, want = against_sql(spark, events_in(spark, tmp_path, ODD), "null_pvalues")
    assert got == want and "(1, None, 0.2)" in got


def test_users_of_equal_means_share_a_percentile(spark, tmp_path):
    d = events_in(spark, tmp_path, [(1, i, "view", 0.05) for i in range(7)] + [(2, 0, "view", 0.1), (3, 0, "view", 9.0), (4, 0, "view", None)])
    got = {r.user_id: r.percentile for r in e.queries()["score_percentile"](spark, d).where("user_id < 4").collect()}
    assert got[1] == got[2] < got[3]


def test_users_without_values_have_percentiles_as_in_sql(spark, tmp_path):
    got, want = against_sql(spark, events_in(spark, tmp_path, ODD), "score_percentile")
    assert got == want and len(got) == 11 and "(11, 90.909091)" in got


def test_means_of_what_no_decimal_holds(spark):
    rows = spark.createDataFrame([("a", 1e30), ("a", 1.0), ("b", float("nan")), ("c", float("inf")), ("d", None), ("e", 0.1), ("e", None)], "k string, v double")
    got = {r.k: r.m for r in rows.groupBy("k").agg(M.exact_mean(F.col("v")).alias("m")).collect()}
    assert got["a"] == 5e29 and math.isnan(got["b"]) and got["c"] == math.inf and got["d"] is None and got["e"] == 0.1


#: Empty spans (value 0): inside another category's span and a segment, in a bucket's first minute, where segments meet, and a
#: user's only one.
EMPTY = [(1, 100, "view", 50.0), (1, 120, "click", 0.0), (1, 1440, "click", 0.0), (1, 1430, "view", 30.0), (1, 720, "error", 0.0), (2, 720, "view", 0.0), (3, 5, "view", 0.0), (4, 2000, "click", 300.0), (4, 2100, "view", 0.0)]


def test_empty_spans_lie_in_segments(spark, tmp_path):
    got, want = against_sql(spark, events_in(spark, tmp_path, EMPTY), "interval_overlap_join")
    assert got == want and sum("nan" in r for r in got) == 3


def test_empty_spans_are_found_in_segments(spark, tmp_path):
    got, want = against_sql(spark, events_in(spark, tmp_path, EMPTY), "span_recall")
    assert got == want == ["('click', 3, 2)", "('error', 1, 0)", "('view', 5, 4)"]


#: Spans without an end, beside, inside and before others; events without a time; a missing user or category.
OPEN = [(1, 100, "view", None), (1, 100, "view", 20.0), (1, 100, "click", 30.0), (1, 110, "click", None), (1, 900, "view", None), (1, 900, "view", 5.0), (1, 905, "error", None), (2, 50, "view", None), (None, 60, "view", 9.0), (1, 120, None, 9.0)]


def test_spans_without_an_end_are_counted_as_in_sql(spark, tmp_path):
    got, want = against_sql(spark, events_in(spark, tmp_path, OPEN), "span_recall")
    assert got == want and "('view', 4, 2)" in got


def test_spans_without_an_end_overlap_as_in_sql(spark, tmp_path):
    got, want = against_sql(spark, events_in(spark, tmp_path, OPEN), "cross_category_overlap")
    assert got == want == ["('click', 'view', 1)"]


def test_empty_spans_overlap_other_categories(spark, tmp_path):
    got, want = against_sql(spark, events_in(spark, tmp_path, EMPTY), "cross_category_overlap")
    assert got == want == ["('click', 'view', 3)"]


def test_shingles_of_one_text_alone_are_not_kept(spark):
    """One shuffle of all shingles; what is written afterwards are those of two and more texts. Repeated rows count once."""
    from pathlib import Path

    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    docs = spark.createDataFrame([(1, word(0, 30)), (2, word(10, 31)), (2, word(10, 31)), (3, word(100, 400)), (4, word(500, 507)), (5, None)], "doc_id long, text string")
    at = Path(folder(spark).removeprefix("file:"))
    before = set(at.glob("shingles-*"))
    got = [tuple(r) for r in C.contained_pairs(docs, "doc_id", "text", 0.5).collect()]
    assert got == [(1, 2, 13, 13 / 14)]
    (new,) = set(at.glob("shingles-*")) - before
    assert spark.read.parquet(f"file://{new}").count() == 2 * 13 + 1  # one stands in the repeated rows alone
    assert sorted(r.doc_id for r in C.without_copies(docs.union(docs.where("doc_id = 1").selectExpr("9", "text")), "doc_id", "text").collect()) == [1, 2, 2, 3, 4, 5]


def test_a_draw_needs_no_pairs_of_copies(spark):
    """Classes of copies by the key that stands for them give the log that all their pairs give."""
    rows = spark.createDataFrame([(i, "ab"[i % 2], None, None, i % 12) for i in range(60)], "key long, stratum string, first string, later string, same long")
    all_pairs = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60) if {i % 12, j % 12} in ({0, 3}, {i % 12})], "a long, b long")
    log = lambda r, p: sorted(map(str, V.draw_frame(r, p, {"a": 1, "b": 1}, 10).collect()))
    got = log(rows, spark.createDataFrame([(0, 3)], "a long, b long"))
    assert got == log(rows.drop("same"), all_pairs) and sum("duplicate" in r for r in got) > 0


def test_nearest_examples_write_a_row_per_document(spark, tmp_path):
    """No table of (document, term) rows is written; blocks of targets and both ways to the counts of terms give one result."""
    import random
    from pathlib import Path

    from segscore.operators import retrieval as R

    r = random.Random(5)
    texts = {i: None if i == 20 else " ".join(r.choice(["amber", "birch", "cedar", "delta", f"only{i}", "ember"]) for _ in range(r.randint(2, 9))) for i in range(1, 90)}
    texts[60] = texts[7]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(1, 80)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = Path(folder(spark).removeprefix("file:"))
    before = set(at.glob("*"))
    got = sorted(tuple(x) for x in e.queries()["nearest_examples"](spark, str(tmp_path)).collect())
    assert len(got) == 3 and got[-2][0] == 60 and got[-2][3:] == (7, 1.0)
    assert max(spark.read.parquet(f"file://{x}").count() for x in set(at.glob("*")) - before) <= len(texts)
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(e.oracle_sql()["nearest_examples"]).fetchall())
    counts = C.counted_terms(docs, ["doc_id"], "text")
    df = C.document_counts(counts)
    one, two = (C.packed(C.term_weights(counts, df, len(texts), ["doc_id"], held), "doc_id", unit=True) for held in (10**6, 0))
    both = one.join(two.toDF("doc_id", "t", "w"), "doc_id")
    vectors = lambda t, w: dict(zip(np.frombuffer(t, "<i8").tolist(), np.frombuffer(w, "<f8").round(12).tolist(), strict=True))
    assert [x.doc_id for x in both.collect() if vectors(x.terms, x.weights) != vectors(x.t, x.w)] == [] and both.count() == len(texts)
    pool = one.selectExpr("doc_id as id", "doc_id % 3 = 0 as labelled", "terms", "weights")
    targets = one.where("doc_id % 2 = 0 and length(terms) > 0").withColumnRenamed("doc_id", "target")
    whole, blocks = (sorted(map(tuple, R.nearest_packed(pool, targets, held=h).collect())) for h in (1 << 20, 500))
    assert whole == blocks and len(whole) > 30


def test_prompt_examples_write_a_row_per_document(spark, tmp_path):
    """As the nearest examples do; places and examples are those of the SQL."""
    import random
    from pathlib import Path

    import duckdb

    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["amber", "birch", "cedar", "delta", "ember", "fir"]) for _ in range(r.randint(2, 30))), "ab"[i % 40 == 0]) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at = Path(folder(spark).removeprefix("file:"))
    before = set(at.glob("*"))
    got = sorted(tuple(x) for x in e.queries()["prompt_examples"](spark, str(tmp_path)).collect())
    assert max(spark.read.parquet(f"file://{x}").count() for x in set(at.glob("*")) - before) <= len(rows)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(e.oracle_sql()["prompt_examples"]).fetchall()) and len(got) > 5


def test_drift_vectors_shuffle_sums_alone(spark, tmp_path):
    """Rows of (document, term) stay in place; a study of one split makes the vectors of its contracts only."""
    from segscore.plans import world as P

    words = ["amber", "birch", "cedar", "delta", "ember"]
    rows = [(i, None if i == 9 else " ".join(words[(i * j) % 5] for j in range(1, 4 + i % 7)), f"s{i % 6}", "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    segments, vectors = P.drift_world(spark, str(tmp_path))
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(contract" in plan
    splits = {x.contract: x.split for x in segments.select("contract", "split").distinct().collect()}
    part = min(splits.values())
    own = {x.contract for x in P.drift_world(spark, str(tmp_path), part)[1].collect()}
    assert own == {c for c, s in splits.items() if s == part} and {x.contract for x in vectors.collect()} == set(splits)
    by_doc = {r.doc_id: r.n_tokens for r in segments.collect()}
    assert by_doc == {i: len(t.split()) if t else 0 for i, t, _, _ in rows}


def test_blocks_of_terms_grow_with_the_vectors(spark, monkeypatch):
    """Products are the same with more blocks than asked for, as many as the rows need."""
    from segscore.operators import driftstudy as Y

    rows = [(f"k{i}", j, float(1 + (i * j) % 3)) for i in range(5) for j in range(30) if (i + j) % 4]
    df = spark.createDataFrame(rows, "key string, term long, weight double")
    one = sorted(map(tuple, Y.gram(df, "key", term_blocks=1).collect()))
    monkeypatch.setattr(Y, "TILE_ROWS", 10)
    assert sorted(map(tuple, Y.gram(df, "key", term_blocks=1).collect())) == one and len(one) == 15


def test_tables_beside_rows_either_way(spark):
    """A table that may not be broadcast meets its rows by a shuffle, with the same result."""
    rows = spark.createDataFrame([(i % 7, i) for i in range(50)], "term long, x long")
    table = spark.createDataFrame([(i, i * 10) for i in range(5)], "term long, df long")
    near, far = (C.beside(rows, table, "term", held) for held in (5, 4))
    assert "Exchange hashpartitioning(" not in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect())) and far.count() == 50


def test_rows_of_frequent_terms_stay_beside_large_tables(spark, tmp_path, monkeypatch):
    """Of a table too large for a broadcast the most frequent keys still go to their rows; vectors don't change with it."""
    from functools import partial

    from pyspark.sql import functions as F

    from segscore.plans import world as P

    # Keys 0 and 1 have 30 and 20 rows, 2 to 4 have three each, 5 is unknown.
    keys = [0] * 30 + [1] * 20 + [2, 3, 4] * 3 + [5]
    rows = spark.range(0, len(keys), 1, 3).select("id", F.array(*map(F.lit, keys))[F.col("id").cast("int")].alias("term"), F.spark_partition_id().alias("at"))
    table = spark.createDataFrame([(k, keys.count(k)) for k in range(5)], "term int, df long")
    known = lambda df: sorted((r.id, r.df or 0) for r in df.collect())
    want = [(i, keys.count(k) if k < 5 else 0) for i, k in enumerate(keys)]
    for held in (0, 1, 2, 3, 4, 5):
        got = C.beside(rows, table, "term", held, "df").select("id", "term", "df", "at", F.spark_partition_id().alias("now"))
        assert known(got) == want
        assert {r.term for r in got.where("at = now").collect()} >= set(range(min(held, 2)))
    words = ["amber", "birch", "cedar", "delta", "ember", "fir"]
    docs = [(i, " ".join(w for j, w in enumerate(words) if i % (j + 1) == 0) + f" once{i}", f"s{i % 6}", "en") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def world():
        segments, vectors = P.drift_world(spark, str(tmp_path))
        return sorted((r.doc_id, r.n_tokens, r.n_oov) for r in segments.collect()), sorted((r.contract, r.term, round(r.weight, 12)) for r in vectors.collect())

    whole = world()
    monkeypatch.setattr(P, "beside", partial(C.beside, held=3))
    assert world() == whole and len(whole[1]) > 20


def test_drift_broadcasts_a_bounded_part_of_its_tables(spark, tmp_path):
    """What the driver makes of a table for a broadcast doesn't grow with it: of 600,000 terms or norms no more than half a million."""
    from segscore.plans import world as P

    spark.range(600_000).selectExpr("id as term", "case when id < 1000 then 9 else 2 end as df").write.parquet(f"{tmp_path}/terms")
    table, rows = spark.read.parquet(f"{tmp_path}/terms"), spark.range(0, 700_000, 7000, 2).withColumnRenamed("id", "term")
    for often in ("df", None):
        got = P.beside(rows, table, "term", often=often)
        assert "Exchange hashpartitioning(" in got._jdf.queryExecution().executedPlan().toString()
        assert {r.term: r.df for r in got.collect()} == {i: (9 if i < 1000 else 2) if i < 600_000 else None for i in range(0, 700_000, 7000)}


def test_a_shard_is_sorted_by_short_keys(monkeypatch):
    """Rows of a transform are ranked by keys of eight bytes at most, at any number of letters, in the order of the letters."""
    import numpy as np

    from segscore.llm import repeats

    r = np.random.default_rng(8)
    size = r.integers(3, 12, 40)
    strings = np.where(np.arange(13) < size[:, None], r.integers(1, 3, (40, 13)) + 300 * (np.arange(13) == 1), 0).astype(np.uint16)
    cycles = [x[: n + 1].tolist() for x, n in zip(strings, size, strict=True)]
    sort, wide = np.argsort, []
    monkeypatch.setattr(repeats.np, "argsort", lambda a, *x, **y: (wide.append(a.itemsize), sort(a, *x, **y))[1])
    for depth in (1, 3, 4, 5, 8, 9, 27):
        got = repeats.Shard(strings, depth)
        turned = [tuple(c[(p + i) % len(c)] for i in range(depth)) for c, p in ((cycles[o], p) for o, p in zip(got.owner, got.at, strict=True))]
        assert turned == sorted(turned) and len(turned) == sum(map(len, cycles))
        assert got.letter.tolist() == [cycles[o][p - 1] for o, p in zip(got.owner, got.at, strict=True)]
        assert [(got.owner[i], got.at[i]) for i in got.earlier] == [(o, (p - 1) % len(cycles[o])) for o, p in zip(got.owner, got.at, strict=True)]
    assert max(wide) <= 8


def test_small_models_are_fitted_at_the_same_time(spark, monkeypatch):
    """Training rows that settings share are written once; models of few weights are fitted together, with the log of one by one."""
    import threading
    from pathlib import Path

    from segscore.operators import baseline as A

    words = ["amber", "birch", "cedar", "delta", "ember", "fir"]
    rows = [(i, ("train", "train", "val")[i % 3], " ".join(words[(i * j) % 6] for j in range(1, 5 + i % 3)), i % 2 == 0, i % 5 < 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, split string, text string, a boolean, b boolean")
    settings = [A.Setting(1, False, 1.0), A.Setting(1, True, 10.0)]
    inner, together = A.fit, threading.Barrier(2)

    def fit(*job):
        together.wait(60)  # for a second model at the same time
        return inner(*job)

    at = Path(folder(spark).removeprefix("file:"))
    before = set(at.glob("train-*"))
    monkeypatch.setattr(A, "fit", fit)
    log = lambda: sorted(map(str, A.search(df, "text", ["a", "b"], settings).collect()))
    got = log()
    assert len(set(at.glob("train-*")) - before) == 1 and len(got) == 2
    monkeypatch.setattr(A, "fit", inner)
    monkeypatch.setattr(A, "HELD", 1)
    assert log() == got


def test_models_take_few_jobs_and_share_passes(spark, monkeypatch):
    """Rows that a task may hold are fitted in one job a model; beyond, models go over the rows together, with the same log."""
    from segscore.operators import baseline as A

    words = ["amber", "birch", "cedar", "delta", "ember", "fir"]
    rows = [(i, ("train", "train", "val")[i % 3], " ".join(words[(i * j) % 6] for j in range(1, 5 + i % 3)) if i else "", i % 2 == 0, i % 5 < 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, split string, text string, a boolean, b boolean")
    settings = [A.Setting(1, w, c) for w in (False, True) for c in (1.0, 10.0)]
    log = lambda: sorted(map(str, A.search(df, "text", ["a", "b"], settings).collect()))
    jobs = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup())
    spark.range(1).collect()
    before = jobs()
    got = log()
    assert jobs() - before < 200
    over, asked = A.Training.over, []
    monkeypatch.setattr(A, "TASK", 0)
    monkeypatch.setattr(A.Training, "over", lambda self, now: (asked.append(len(now)), over(self, now))[1])
    assert log() == got and max(asked) > 4 and len(asked) < sum(asked) / 2
    constant = df.withColumn("b", F.lit(True))
    assert {r.p for r in A.scored(constant.join(A.vectors(constant.selectExpr("id", "split = 'train' as train", "text"), "text", 1)[0], "id"), constant.join(A.vectors(constant.selectExpr("id", "true as train", "text"), "text", 1)[0], "id"), ["b"], A.Setting()).collect()} == {1.0}


def test_no_run_of_words_takes_the_slow_call():
    """The library's `encode` finds offsets too, which nobody asks for: runs of words go through the call without them."""
    import numpy as np
    import public_tokenizers

    from segscore.llm.packing import WordEncoder

    class Fast:
        def __init__(self, inner):
            self.inner, self.encode_batch_fast = inner, inner.encode_batch_fast

    enc = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    library, enc.tokenizer = enc.tokenizer, Fast(enc.tokenizer)
    texts = ["Größe über naïve façade", "plain words only", "日本語 mixed über 12,5", ""]
    want = [[*library.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(texts)] == want
