"""The query registry over the driver's tables: name -> callable, and name -> DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import oracles as O
from .functions import text as T
from .functions.agreement import matches
from .functions.hashing import draw
from .operators import bootstrap as B
from .operators import calllog as L
from .operators import curation as C
from .operators import drift as D
from .operators import intervals as I
from .operators import metrics as M
from .operators import sampling as S
from .operators import thresholds as H
from .plans import world as P
from .sources import io
from .sources.scorer import KeywordScorer
from .sources.written import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places: sums differ in their last bits between engines and orders."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def long(spark: SparkSession, d: str, stream: str = "score") -> DataFrame:
    return P.long_form(P.table(spark, d, "events"), stream)


def tuned(spark: SparkSession, d: str, stream: str = "score") -> DataFrame:
    rows = long(spark, d, stream)
    return H.applied(rows, H.best_f1(rows.where("split = 'val'"), ["label"]))


# ---- scans, filters, groupings


@query(O.CATEGORY_SUMMARY)
def category_summary(spark, d):
    docs = P.table(spark, d, "documents")
    n = F.length("text")
    return r6(docs.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.percentile(n, F.lit(0.5)).alias("median_chars"), F.percentile(n, F.lit(0.9)).alias("p90_chars"), M.n_if(F.col("text").contains("\n")).alias("multiline"), F.avg(n).alias("mean_chars"), F.stddev_samp(n).alias("std_chars"), F.max(n).cast("long").alias("max_chars")))


@query(O.LABEL_SUPPORT_PIVOT)
def label_support_pivot(spark, d):
    rows = long(spark, d).where("y").select("label", "split", "contract_id").distinct()
    return rows.groupBy("label").pivot("split", ["val", "test", "shift"]).agg(F.count("contract_id")).na.fill(0)


@query(O.SPLIT_SUMMARY)
def split_summary(spark, d):
    seg = long(spark, d).groupBy("split", "segment_id").agg(F.bool_or("y").alias("any_y"))
    s = seg.groupBy("split").agg(F.count("*").alias("segments"), M.n_if(F.col("any_y")).alias("positive"), M.n_if(~F.col("any_y")).alias("none"))
    return r6(s.withColumn("none_pct", 100 * F.col("none") / F.col("segments")))


@query(O.RULE_SUPPORT_FILTER)
def rule_support_filter(spark, d):
    rows = long(spark, d).where("y and split = 'test'").groupBy("label").agg(F.countDistinct("contract_id").alias("contracts"))
    return rows.where("contracts >= 10")


@query(O.OUTER_FLATTEN_PROPS)
def outer_flatten_props(spark, d):
    ev = P.table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return ev.select("event_id", F.explode_outer(F.map_filter("m", lambda k, v: v.cast("long") >= 50)).alias("name", "v")).select("event_id", "name", F.col("v").cast("long").alias("v"))


@query(O.DENSE_KEY)
def dense_key(spark, d):
    return io.dense_key(P.table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "key")


@query(O.NESTED_CORPUS)
def nested_corpus(spark, d):
    """Documents as a nested corpus, flattened again: one row per answer, one null row per question without any."""
    docs = P.table(spark, d, "documents")
    answers = F.when(F.col("lang") == "en", F.array(F.struct(F.substring("text", 1, 5).alias("text"), F.lit(0).cast("long").alias("answer_start")))).otherwise(F.array().cast("array<struct<text:string,answer_start:bigint>>"))
    qa = F.struct(F.concat(F.col("doc_id").cast("string"), F.lit("__"), F.col("source")).alias("id"), (F.col("lang") != "en").alias("is_impossible"), answers.alias("answers"))
    corpus = docs.select(F.col("doc_id").cast("string").alias("title"), F.array(F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))
    return io.spans(corpus)


@query(O.REDACTION_RATE)
def redaction_rate(spark, d):
    docs = P.table(spark, d, "documents")
    return r6(docs.select("doc_id", *(c.alias(n) for n, c in C.marker_rates(F.col("text")).items())))


@query(O.EXCLUSION_CASCADE)
def exclusion_cascade(spark, d):
    docs = P.table(spark, d, "documents").withColumns(C.marker_rates(F.col("text")))
    head = F.lower(F.substring("text", 1, 500))
    rules = [("too_short", F.length("text") < 500), ("too_long", F.length("text") > 20000), ("amendment", head.rlike("amend") & ~head.contains("amended and restated")), ("form_or_template", F.col("blank_markers") >= 3), ("redacted", F.col("per_1000") > 1)]
    return docs.select("doc_id", C.first_reason(rules).alias("reason"))


@query(O.FUZZY_PREFIX_MATCH)
def fuzzy_prefix_match(spark, d):
    """Part names to the titles of parts with an even key, cut to their first ten characters where the key divides by
    four: exact first, else the one title of which either is a prefix of the other."""
    part = P.table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))
    titles = part.where("p_partkey % 2 = 0").select(F.when(F.col("p_partkey") % 4 == 0, F.substring("name", 1, 10)).otherwise(F.col("name")).alias("t"))
    return C.unique_prefix(part, "p_partkey", "name", titles, "t")


@query(O.PHRASE_CLASSIFY)
def phrase_classify(spark, d):
    phrases = {"services agreement": "Service", "hosting services agreement": "Hosting", "license": "License", "apache license": "Software", "the": "Common"}
    return C.phrase_class(P.table(spark, d, "documents"), phrases, F.col("text")).select("doc_id", "type", "type_status")


@query(O.GRID_CROSS)
def grid_cross(spark, d):
    """Every setting of a grid for every language's documents, with the penalty that its number of segments makes of c."""
    one = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    langs = P.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("segments"), F.countDistinct("text").alias("texts"))
    grid = langs.select("*", one([1, 2], "n")).select("*", one([0.1, 1.0, 10.0], "c")).select("*", one(["none", "balanced"], "weighting"))
    told = F.concat_ws("-", "lang", F.col("n").cast("string"), F.format_string("%.1f", "c"), "weighting")
    return grid.select("lang", "segments", "texts", F.col("n").cast("long").alias("ngram_max"), "c", "weighting", told.alias("config_id"), F.round(1 / (F.col("c") * F.col("segments")), 9).alias("penalty"))


@query(O.KV_MISSING_CALLS)
def kv_missing_calls(spark, d):
    c = P.table(spark, d, "conversations")
    cache = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return L.missing_calls(c.where("role = 'user'").select("conv_id", "turn"), cache, ["conv_id", "turn"])


@query(O.ALIGNED_PAIR_AUDIT)
def aligned_pair_audit(spark, d):
    a = long(spark, d).select("segment_id", "label", F.col("y").alias("ya"))
    b = long(spark, d, "other").where("segment_id % 97 <> 0").select("segment_id", "label", F.col("y").alias("yb"))
    j = a.join(b, ["segment_id", "label"], "full")
    return j.agg(M.n_if(F.col("yb").isNull()).alias("only_a"), M.n_if(F.col("ya").isNull()).alias("only_b"), M.n_if(F.col("ya") != F.col("yb")).alias("different"), F.count("*").alias("n"))


@query(O.FULL_OUTER_KINDS)
def full_outer_kinds(spark, d):
    one = lambda s: tuned(spark, d, s).where("split = 'test' and pred").groupBy("contract_id", "label").agg(F.count("*").alias(f"n_{s}"))
    j = one("score").join(one("other"), ["contract_id", "label"], "full")
    kind = F.when(F.col("n_other").isNull(), "a").when(F.col("n_score").isNull(), "b").otherwise("both")
    return j.groupBy("label", kind.alias("kind")).agg(F.count("*").alias("n"))


# ---- metrics and thresholds


@query(O.PER_LABEL_PRF)
def per_label_prf(spark, d):
    rows = tuned(spark, d).where("split = 'test'")
    out = M.prf(M.label_counts(rows, ["label"])).join(M.average_precision(rows, ["label"]), "label", "left")
    return r6(out)


@query(O.MICRO_MACRO_SUMMARY)
def micro_macro_summary(spark, d):
    return r6(M.macro_micro(M.label_counts(tuned(spark, d), ["split", "label"]), ["split"]))


@query(O.NONE_FP_RATE)
def none_fp_rate(spark, d):
    return r6(M.none_counts(tuned(spark, d), ["split"]).withColumn("rate", M.ratio(F.col("none_fp"), F.col("none"))))


@query(O.AVERAGE_PRECISION)
def average_precision(spark, d):
    return r6(M.average_precision(long(spark, d), ["split", "label"]))


@query(O.THRESHOLD_TUNING)
def threshold_tuning(spark, d):
    return r6(H.best_f1(long(spark, d).where("split = 'val'"), ["label"]))


@query(O.POOLED_THRESHOLD)
def pooled_threshold(spark, d):
    return r6(H.pooled(long(spark, d).where("split = 'val'"), ["buy", "hot"]))


@query(O.HIGH_RECALL)
def high_recall_thresholds(spark, d):
    rows = long(spark, d).where("split = 'val'")
    return r6(H.high_recall(rows, H.best_f1(rows, ["label"])))


@query(O.NEAR_BEST)
def near_best_selection(spark, d):
    """Of the thresholds 0.01..0.99 of one label: within 0.005 of the best F1, then recall, then the lowest."""
    g = H.grid(long(spark, d).where("split = 'val' and label = 'pricey'"), ["label"])
    rows = g.select("i", "t", F.round(M.ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), 9).alias("f1"), F.round(M.ratio(F.col("tp"), F.col("positives")), 9).alias("recall"))
    return r6(H.near_best(rows, "f1", "recall", ["i"]))


@query(O.CALIBRATION_BINS)
def calibration_bins(spark, d):
    bins = M.calibration_bins(long(spark, d).where("split = 'test'"), [])
    every = spark.range(10).select(F.col("id").alias("bin"))
    out = every.join(bins, "bin", "left")
    return r6(out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), M.ratio(F.col("sum_p"), F.col("n")).alias("mean_p"), M.ratio(F.col("sum_y"), F.col("n")).alias("rate")))


@query(O.CALIBRATION_PER_LABEL)
def calibration_per_label(spark, d):
    rows = long(spark, d)
    bins = M.calibration_bins(rows, ["label"])
    means = rows.groupBy("label").agg(F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"))
    return r6(M.ece(bins, ["label"]).join(means, "label"))


@query(O.MISSED_LABELS)
def missed_labels(spark, d):
    rows = tuned(spark, d).where("split = 'test'")
    seg = rows.groupBy("segment_id").agg(F.bool_or("pred").alias("any_pred"))
    fn = rows.where("y and not pred").join(seg, "segment_id")
    return fn.groupBy("label").agg(F.count("*").alias("missed"), M.n_if(~F.col("any_pred")).alias("missed_without_prediction"))


@query(O.CONFUSION_PAIRS)
def confusion_pairs_top15(spark, d):
    return M.confusion_pairs(tuned(spark, d)).orderBy(F.desc("n"), "true_label", "predicted_label").limit(15)


@query(O.ERROR_SAMPLES)
def error_samples(spark, d):
    rows = tuned(spark, d).where("split = 'test' and y <> pred").withColumn("kind", F.when(F.col("y"), "fn").otherwise("fp"))
    return S.first_by_draw(rows.select("label", "kind", "segment_id"), ["label", "kind"], 5, "errors", "segment_id")


@query(O.CLASS_WEIGHTS)
def class_weights(spark, d):
    g = long(spark, d).groupBy("label").agg(M.n_if(F.col("y")).alias("pos"), F.count("*").alias("n"))
    return r6(g.select("label", F.sqrt(M.ratio(F.col("n") - F.col("pos"), F.col("pos"))).alias("weight")))


# ---- sampling and bootstrap


@query(O.STRATIFIED_SPLIT)
def stratified_split(spark, d):
    return S.stratified_split(P.table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source")


@query(O.NEGATIVE_DOWNSAMPLE)
def negative_downsample(spark, d):
    rows = long(spark, d).where("split = 'val' and label = 'pricey'").select("segment_id", "y")
    return S.downsample(rows, F.col("y"), "segment_id", 0.5)


@query(O.ROUND_ROBIN)
def round_robin_sample(spark, d):
    per = P.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("ctype", F.col("user_id") % 4)
    return S.round_robin(per, "user_id", "ctype", "n", 1500)


@query(O.QUOTA_ALLOCATION)
def quota_allocation(spark, d):
    return S.quotas(P.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 37)


@query(O.HALF_SAMPLE)
def half_sample(spark, d):
    return S.half(P.table(spark, d, "events"), "user_id")


@query(O.CONTEXT_WINDOWS)
def context_windows(spark, d):
    c = S.consecutive_windows(P.table(spark, d, "conversations"), "conv_id", "turn", 3)
    return c.groupBy("conv_id", "window").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(O.BOOTSTRAP_WEIGHTS)
def bootstrap_weights(spark, d):
    return B.weights(P.segments(P.table(spark, d, "events")).select("contract_id", "ctype").distinct(), "contract_id", "ctype", 50, "test")


def boot_weights(spark, d, stream: str, split: str, stratum: str | None = "ctype", n: int = 200):
    # Contracts come from the segments alone: no threshold has to be tuned for them.
    contracts = P.segments(P.table(spark, d, "events")).where(F.col("split") == split).select("contract_id", "ctype").distinct()
    return B.weights(contracts, "contract_id", stratum, n, stream)


def boot(spark, d, stream: str, split: str, stratum: str | None = "ctype", score: str = "score", w: DataFrame | None = None):
    rows = tuned(spark, d, score).where(F.col("split") == split)
    w = boot_weights(spark, d, stream, split, stratum) if w is None else w
    return B.resampled_f1(M.label_counts(rows, ["contract_id", "label"]), w, "contract_id")


BOTH = ["macro_f1", "micro_f1"]


@query(O.BOOTSTRAP_F1_CI)
def bootstrap_f1_ci(spark, d):
    return r6(B.interval(boot(spark, d, "test", "test"), BOTH))


@query(O.BOOTSTRAP_UNSTRATIFIED)
def bootstrap_unstratified_ci(spark, d):
    return r6(B.interval(boot(spark, d, "fresh", "test", None), BOTH))


@query(O.PAIRED_COMPARISON)
def paired_comparison(spark, d):
    w = written(boot_weights(spark, d, "test", "test"), "weights")
    return r6(B.paired(boot(spark, d, "test", "test", w=w), boot(spark, d, "test", "test", score="other", w=w), BOTH, 12))


@query(O.TEST_MINUS_SHIFT)
def test_minus_shift(spark, d):
    return r6(B.paired(boot(spark, d, "test", "test"), boot(spark, d, "shift", "shift"), BOTH, 1).drop("claim"))


@query(O.ECE_BOOTSTRAP)
def ece_bootstrap(spark, d):
    rows = long(spark, d).where("split = 'test'")
    w = B.weights(rows.select("contract_id", "ctype").distinct(), "contract_id", "ctype", 100, "test")
    sums = B.resampled(M.calibration_bins(rows, ["contract_id"]), w, "contract_id", ["bin"], ["n", "sum_p", "sum_y"])
    return r6(B.interval(M.ece(sums, ["resample"]), ["ece"]))


# ---- intervals


def spans(spark, d):
    """Events as spans in minutes since 2024: [ts, ts + value minutes)."""
    at = (F.unix_timestamp("ts") / 60).cast("long") - 28401120
    return P.table(spark, d, "events").select("event_id", "user_id", "event_type", at.alias("start"), (at + F.ceil("value").cast("long")).alias("end"))


@query(O.INTERVAL_UNION)
def interval_union(spark, d):
    return I.union_intervals(spans(spark, d), ["user_id", "event_type"])


@query(O.INTERVAL_OVERLAP_JOIN)
def interval_overlap_join(spark, d):
    merged = I.union_intervals(spans(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    segs = I.fixed_segments(merged, "user_id", 720)
    pairs = I.overlap_join(merged, segs, "user_id", bucket=1440)
    return r6(I.covered(pairs, ["user_id", "g_start", "event_type"]))


@query(O.CROSS_CATEGORY)
def cross_category_overlap(spark, d):
    s = I.union_intervals(spans(spark, d), ["user_id", "event_type"])
    a = s.select("user_id", F.col("event_type").alias("cat_a"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    b = s.select("user_id", F.col("event_type").alias("cat_b"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    return I.overlap_join(a, b, "user_id", bucket=1440).where("cat_a < cat_b").groupBy("cat_a", "cat_b").agg(F.count("*").alias("n"))


@query(O.SAME_CATEGORY)
def same_category_overlap(spark, d):
    w = W.partitionBy("user_id", "event_type").orderBy("start", "end", "event_id")
    s = spans(spark, d).withColumn("overlaps", F.coalesce(F.lead("start").over(w) < F.col("end"), F.lit(False)))
    return s.groupBy("event_type").agg(M.n_if(F.col("overlaps")).alias("n"))


@query(O.BIN_LOOKUP)
def bin_lookup(spark, d):
    edges = [1.0, 10.0, 50.0, 100.0, 250.0]
    return P.table(spark, d, "events").groupBy(I.edge_index(edges, F.col("value")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(O.PAGE_OFFSETS)
def page_offsets(spark, d):
    c = P.table(spark, d, "conversations")
    return I.prefix_offsets(c, ["conv_id"], "turn", F.length("text"), 2).select("conv_id", "turn", "offset")


# ---- text and curation


@query(O.LINE_TABLE)
def line_table(spark, d):
    return T.line_table(P.table(spark, d, "documents"))


@query()
def segment_documents(spark, d):
    return T.segment_documents(P.table(spark, d, "documents"))


@query()
def label_segments(spark, d):
    """Segments labelled by spans (40 characters from every "Licensed" or "Copyright" on) by the coverage rule."""
    docs = P.table(spark, d, "documents")
    segs = T.segment_documents(docs).select("doc_id", "segment_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    # Between two finds lies one part of a split, so the lengths before give every place.
    parts = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(w).alias("word"), F.split("text", w).alias("parts")) for c, w in (("license", "Licensed"), ("rights", "Copyright"))))).alias("x"))
    cut = parts.select("doc_id", "x.category", "x.word", F.posexplode("x.parts").alias("i", "part"))
    upto = F.sum(F.length("part") + F.length("word")).over(W.partitionBy("doc_id", "category").orderBy("i").rowsBetween(W.unboundedPreceding, -1)) - F.length("word")
    marks = cut.withColumn("s_start", upto.cast("long")).where("i > 0").select("doc_id", "category", "s_start", (F.col("s_start") + 40).alias("s_end"))
    hits = I.covered(I.overlap_join(marks, segs, "doc_id"), ["doc_id", "segment_id", "category"])
    labels = hits.groupBy("segment_id").agg(F.sort_array(F.collect_set("category")).alias("labels"))
    return segs.join(labels, "segment_id", "left").select("segment_id", "doc_id", "g_start", "g_end", F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


@query()
def html_text(spark, d):
    return P.table(spark, d, "pages").select("page_id", T.html_text("html").alias("t")).select("page_id", "t.text", "t.error")


@query(O.CHARSET_DECODE)
def charset_decode(spark, d):
    """Whole pages from their UTF-8 bytes, and from these in ISO-8859-1 with a byte 233 behind, which is no UTF-8."""
    p = P.table(spark, d, "pages")
    odd = F.concat(F.encode("html", "UTF-8"), F.lit(bytearray(b"\xe9")))
    return p.select("page_id", F.sha2(T.decoded(F.encode("html", "UTF-8")), 256).alias("sha"), F.length(T.decoded(odd)).cast("long").alias("n_odd"), F.substring(T.decoded(odd), -1, 1).alias("last"))


@query(O.VOCAB)
def vocab_min_df(spark, d):
    return C.vocabulary(P.table(spark, d, "documents"), "doc_id", "text", grams=1)


@query(O.TFIDF)
def tfidf_top_terms(spark, d):
    t = C.tfidf(P.table(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))
    w = W.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return t.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")


@query(O.OOV_RATE)
def oov_rate(spark, d):
    docs = P.table(spark, d, "documents")
    vocab = C.vocabulary(docs.where("lang = 'en'"), "doc_id", "text", grams=1).select("term", F.lit(True).alias("known"))
    rows = docs.select("lang", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    j = rows.join(vocab, "term", "left")
    return r6(j.groupBy("lang").agg(F.sum("n").alias("tokens"), M.ratio(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)), F.sum("n")).alias("oov")))


@query(O.NEAREST)
def nearest_neighbour(spark, d):
    return r6(C.nearest(P.table(spark, d, "embeddings"), "vec_id", "embedding"))


@query(O.WORD_OVERLAP)
def word_overlap(spark, d):
    """Multiset overlap of words of benchmark items with documents of the same number."""
    count = lambda n, k: P.table(spark, d, n).select(F.col(k).alias("id"), F.explode(T.words(F.col("text"))).alias("w")).groupBy("id", "w").agg(F.count("*").alias(f"n_{n}"))
    j = count("documents", "doc_id").join(count("benchmark", "item_id"), ["id", "w"], "full").na.fill(0)
    return j.groupBy("id").agg(F.sum(F.least("n_documents", "n_benchmark")).alias("common"), F.sum("n_documents").alias("left"), F.sum("n_benchmark").alias("right")).where("right > 0")


@query(O.SHINGLE_CONTAINMENT)
def shingle_containment(spark, d):
    left = C.shingle_rows(P.table(spark, d, "documents"), "doc_id", "text")
    right = C.shingle_rows(P.table(spark, d, "benchmark"), "item_id", "text")
    return r6(C.containment(left, right, "doc_id", "item_id"))


@query(O.MAX_CONTAINMENT)
def max_containment(spark, d):
    """Per document the highest containment against any benchmark item, 0 where there is none."""
    docs = P.table(spark, d, "documents")
    c = C.containment(C.shingle_rows(docs, "doc_id", "text"), C.shingle_rows(P.table(spark, d, "benchmark"), "item_id", "text"), "doc_id", "item_id")
    top = c.groupBy("doc_id").agg(F.max("containment").alias("c"))
    return r6(docs.select("doc_id").join(top, "doc_id", "left").select("doc_id", F.coalesce("c", F.lit(0.0)).alias("containment")))


@query(O.LONGEST_SENTENCES)
def longest_sentences(spark, d):
    return C.longest_sentences(P.table(spark, d, "documents"), "doc_id", "text").select("doc_id", "rank", "n_words", "sentence")


@query(O.MONTH_WINDOWS)
def month_windows(spark, d):
    span = P.table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("z"))
    m = span.select("a", "z", F.explode(F.sequence(F.trunc("a", "MM"), "z", F.expr("interval 1 month"))).alias("m"))
    return m.select(F.greatest("a", "m").cast("string").alias("start"), F.least("z", F.last_day("m")).cast("string").alias("end"))


@query(O.TITLE_KEYS)
def title_keys(spark, d):
    key = F.lower(F.rtrim(F.regexp_replace(F.trim("p_name"), "-+$", "")))
    return P.table(spark, d, "part").select("p_partkey", key.alias("key"), L.request_key("p_partkey", "p_size").alias("request"))


# ---- drift


def weeks(spark, d, bin_):
    return P.table(spark, d, "events").select((F.dayofmonth("ts") > 15).cast("int").alias("side"), bin_.alias("bin"))


@query(O.PSI)
def psi(spark, d):
    return r6(D.psi(D.two_sides(weeks(spark, d, I.edge_index([5.0, 20.0, 60.0, 150.0], F.col("value"))), "side", "bin"), 5))


@query(O.JS_DISTANCE)
def js_distance(spark, d):
    return r6(D.js_distance(D.two_sides(weeks(spark, d, F.col("event_type")), "side", "bin")))


@query(O.CENTROID_COSINE)
def centroid_cosine(spark, d):
    v = P.table(spark, d, "embeddings").select((F.col("label") % 2).alias("side"), F.posexplode("embedding").alias("i", "x")).select("side", "i", F.col("x").cast("double").alias("x"))
    return r6(D.cosine_of_sums(v, "side", "i", "x"))


@query(O.SHARE_DIFF)
def share_diff(spark, d):
    rows = weeks(spark, d, F.col("event_type") == "purchase")
    share = lambda s: F.avg(F.when(F.col("side") == s, F.col("bin").cast("double")))
    return r6(rows.agg((share(1) - share(0)).alias("diff"), F.abs(share(1) - share(0)).alias("abs_diff")))


@query(O.SPEARMAN)
def spearman(spark, d):
    return r6(M.spearman(P.table(spark, d, "orders").select(F.round("o_totalprice", -3).alias("x"), F.dayofyear("o_orderdate").alias("y")), "x", "y"))


@query(O.BATCH_DRAWS)
def batch_draws(spark, d):
    m = P.table(spark, d, "events").groupBy("user_id").agg((F.count("*") % 3).alias("times"))
    return S.batches(m, "user_id", "times", 5, 20)


@query(O.LEAVE_BATCH_OUT)
def leave_batch_out(spark, d):
    ev = P.table(spark, d, "events")
    m = ev.groupBy("user_id").agg((F.count("*") % 3).alias("times"))
    sums = ev.groupBy("user_id").agg(F.count("*").alias("n"), M.n_if(F.col("value") > 250).alias("high"))
    return D.leave_out(sums, S.batches(m, "user_id", "times", 5, 20), "user_id", ["n", "high"])


def user_scores(spark, d):
    """Users' mean values to one place; a mean that lies just between two goes up, as an exact sum tells."""
    return P.table(spark, d, "events").groupBy("user_id").agg(F.round(M.exact_mean(F.col("value")), 1).alias("v"))


@query(O.NULL_PVALUES)
def null_pvalues(spark, d):
    u = user_scores(spark, d)
    return r6(D.upper_p(u.where("user_id % 2 = 0"), u.where("user_id % 2 = 1"), "user_id", "v", counted=True))


@query(O.TIE_SAFE)
def tie_safe_alarm(spark, d):
    """Leave-one-out p-values as scores, the threshold at 0.1, and the alarm rate it gives."""
    p = D.leave_one_out_p(user_scores(spark, d), "v", "p0").withColumn("p", F.round("p0", 9))
    t = D.tie_safe_threshold(p, "p", 0.1)
    return r6(p.crossJoin(t).agg(F.first("threshold").alias("threshold"), F.first("null_share").alias("null_share"), F.avg((F.col("p") <= F.col("threshold")).cast("double")).alias("alarm_rate")))


# ---- agreement, call logs, reports


@query(O.KAPPA)
def kappa_presence(spark, d):
    lab = P.table(spark, d, "labels").select(F.col("quality").alias("x"), F.when(draw("rater", "doc_id") % 10 < 8, F.col("quality")).otherwise(1 - F.col("quality")).alias("y"))
    return r6(M.kappa(lab, "x", "y"))


@query()
def span_agreement(spark, d):
    """Greedy one-to-one span F1 of two annotators: the spans of even against those of odd events, per user.

    Spans that don't reach each other can't match, so a user's spans are matched island by island (spans that overlap or
    touch one after the other), and the counts summed.
    """
    s = spans(spark, d).select("user_id", (F.col("event_id") % 2).alias("rater"), F.struct("start", "end").alias("span"))
    order = W.partitionBy("user_id").orderBy("span.start", "span.end", "rater")
    new = F.coalesce(F.col("span.start") > F.max("span.end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    islands = s.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order))
    pick = lambda r: F.collect_list(F.when(F.col("rater") == r, F.col("span")))
    g = islands.groupBy("user_id", "island").agg(pick(0).alias("a"), pick(1).alias("b"))
    counts = g.select("user_id", matched("a", "b").alias("m"), (F.size("a") + F.size("b")).alias("n"))
    return r6(counts.groupBy("user_id").agg(M.ratio(2 * F.sum("m"), F.sum("n")).alias("f1")))


@F.pandas_udf(LongType())  # a type by name would need a session when this module is imported
def matched(a: pd.Series, b: pd.Series) -> pd.Series:
    rows = lambda v: np.array([(x["start"], x["end"]) for x in v], np.int64).reshape(-1, 2)
    return pd.Series([matches(rows(x), rows(y)) for x, y in zip(a, b, strict=True)])


@query(O.USAGE_COSTS)
def usage_costs(spark, d):
    ev = P.table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("double").alias("k"), "value")
    return r6(L.usage(ev.withColumn("n", F.lit(10)), ["event_type"], "k", "value", "n"))


@query(O.COST_PROJECTION)
def cost_projection(spark, d):
    """The mean cost of a measured call (attempts summed) times the calls still missing."""
    ev = P.segments(P.table(spark, d, "events"))
    calls = ev.where("split = 'val'").groupBy("contract_id").agg(F.sum("k").alias("cost"))
    mean = calls.agg(F.avg("cost").alias("per_call"))
    left = ev.where("split <> 'val'").agg(F.countDistinct("contract_id").alias("missing"))
    return r6(mean.crossJoin(left).withColumn("projected", F.col("per_call") * F.col("missing")))


@query(O.MERGED_ATTEMPTS)
def merged_attempts(spark, d):
    """Events as attempts of a call (user, type): the last that parsed (k under 90) gives the value."""
    ev = P.segments(P.table(spark, d, "events"))
    return L.latest_parsed(ev, ["contract_id", "event_type"], "segment_id", "k", F.col("k") < 90)


@query(O.RUN_HEALTH)
def run_health(spark, d):
    rows = long(spark, d).withColumn("listed", F.col("p") >= 0.3)
    seg = rows.groupBy("split", "segment_id").agg(F.sum(F.col("listed").cast("int")).alias("n"), F.bool_or(F.col("listed") & (F.col("p") < 0.35)).alias("low"))
    return r6(seg.groupBy("split").agg(F.avg((F.col("n") == 0).cast("double")).alias("empty_share"), F.avg("n").alias("mean_labels"), F.avg(F.col("low").cast("double")).alias("low_share")))


@query(O.REPEATABILITY)
def repeatability(spark, d):
    runs = None
    for name in ("run1", "run2", "run3"):
        one = long(spark, d, name).groupBy("segment_id").agg(F.collect_list(F.when(F.col("p") >= 0.5, F.col("label"))).alias("labels")).withColumn("run", F.lit(name))
        runs = one if runs is None else runs.unionByName(one)
    return r6(L.repeatability(runs, "run", "segment_id", "labels"))


@query()
def response_validation(spark, d):
    """Conversations' answers as responses: scores of valid targets and what is wrong."""
    a = P.table(spark, d, "conversations").where("role = 'assistant'")
    text = F.when(F.col("turn") == 1, F.to_json(F.struct(F.array(F.struct(F.lit("S1").alias("id"), F.array(F.struct(F.lit("hot").alias("label"), (F.length("text") % 10 / 10).alias("confidence"))).alias("labels"))).alias("segments")))).otherwise(F.col("text"))
    v = L.validated(["buy", "hot", "pricey"])(text, F.lit("ok"), F.array(F.lit("S1")))
    out = a.select("conv_id", "turn", v.alias("v"))
    return out.select("conv_id", "turn", F.col("v.scores")["S1"]["hot"].alias("hot"), F.size("v.errors").alias("errors"))


@query(O.SCORE_PERCENTILE)
def score_percentile(spark, d):
    """Each user's mean value as a percentile of all (mean of the strict and the weak rank)."""
    u = user_scores(spark, d)
    ranked = M.average_rank(u, "v", "rank").crossJoin(u.agg(F.count("*").alias("n")))
    return r6(ranked.select("user_id", (100 * F.col("rank") / F.col("n")).alias("percentile")))


@query(O.IQR_EXAMPLE)
def iqr_example(spark, d):
    docs = P.table(spark, d, "documents").select("lang", "doc_id", F.length("text").alias("chars"))
    q = docs.groupBy("lang").agg(F.percentile("chars", F.lit(0.25)).alias("q1"), F.percentile("chars", F.lit(0.75)).alias("q3"))
    inside = docs.join(q, "lang").where("chars between q1 and q3")
    return S.first_by_draw(inside.select("lang", "doc_id", "q1", "q3"), ["lang"], 1, "guide", "doc_id")


@query(O.DQ_VIOLATIONS)
def dq_violations(spark, d):
    docs, ev = P.table(spark, d, "documents"), P.table(spark, d, "events")
    checks = {
        "n_chars differs": docs.where(F.length("text") != F.col("n_chars")),
        "doc_id repeats": docs.groupBy("doc_id").count().where("count > 1"),
        "event without props": ev.where(F.get_json_object("props", "$.k").isNull()),
        "label without document": P.table(spark, d, "labels").join(docs, "doc_id", "left_anti"),
        "same text": docs.groupBy(F.sha2("text", 256)).count().where("count > 1"),
    }
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(O.FLAG_EXPORT)
def flag_export(spark, d):
    """One row per (segment, flag), and a row for each segment of the shift contracts, which aren't scored."""
    rows = tuned(spark, d)
    flags = rows.where("split = 'test' and pred").select("segment_id", F.col("label").alias("flag"))
    return flags.unionByName(rows.where("split = 'shift'").select("segment_id", F.lit("NOT CLASSIFIED").alias("flag")).distinct())


@query(O.MARKDOWN_REPORT)
def markdown_report(spark, d):
    rows = M.prf(M.label_counts(tuned(spark, d).where("split = 'test'"), ["label"]))
    return P.markdown(rows, ["label", "support", "f1"], ["label"])


@query()
def classify_documents(spark, d):
    scorer = KeywordScorer({"license": ["licens", "copyright"], "the": ["the", "and", "of"]})
    rows = P.classify_documents(P.table(spark, d, "documents"), scorer, {"license": 0.5, "the": 0.9})
    return rows.select("segment_id", "doc_id", "start", "end", F.array_join(F.transform("flags", lambda f: f["label"]), ",").alias("flags"))


# ---- the same operators over lineitem, for scale


@query(O.LINEITEM_PIVOT)
def lineitem_pivot(spark, d):
    li = P.table(spark, d, "lineitem")
    return r6(li.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))))


@query(O.LINEITEM_BOOTSTRAP)
def lineitem_bootstrap(spark, d):
    """Orders as contracts of five priorities: the discount's share of lines over 5%, resampled by order."""
    li = P.table(spark, d, "lineitem").groupBy("l_orderkey").agg(M.n_if(F.col("l_discount") > 0.05).alias("hits"), F.count("*").alias("n"))
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    w = B.weights(li.join(o, "l_orderkey").select("l_orderkey", "o_orderpriority"), "l_orderkey", "o_orderpriority", 20, "scale")
    s = B.resampled(li, w, "l_orderkey", [], ["hits", "n"]).withColumn("share", M.ratio(F.col("hits"), F.col("n")))
    return r6(B.interval(s, ["share"]))


from . import queries_audit, queries_rules, queries_study  # noqa: E402, F401  register their queries
