"""Further queries of the registry: families of intervals, checks, label maps, reports, prompt windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracles as O
from .functions.text import words
from .operators import bootstrap as B
from .operators import calllog as L
from .operators import checks as K
from .operators import curation as C
from .operators import drift as D
from .operators import intervals as I
from .operators import metrics as M
from .operators import sampling as S
from .operators import thresholds as H
from .plans import world as P
from .queries import long, query, r6, spans, tuned

r6s = O.r6


# ---- bootstrap families

TEST_W = f"r AS (SELECT * FROM tuned WHERE split = 'test'), k AS (SELECT DISTINCT contract_id, ctype FROM r), {O.weights('k', 'contract_id', 'ctype', 200, 'test')}"
CI = f"SELECT metric, {r6s('quantile_cont(v, 0.025)')} AS low, {r6s('quantile_cont(v, 0.975)')} AS high, count(v) AS n"


def test_weights(rows, n=200):
    return B.weights(rows.select("contract_id", "ctype").distinct(), "contract_id", "ctype", n, "test")


@query(f"""WITH {O.tuned()}, {TEST_W}, c AS (SELECT contract_id, label, {O.COUNTS} FROM r GROUP BY ALL),
s AS (SELECT resample, label, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn FROM c JOIN w USING (contract_id) GROUP BY ALL),
g AS (SELECT contract_id, segment_id, bool_or(y) AS a, bool_or(pred) AS b FROM r GROUP BY ALL), z AS (SELECT contract_id, count_if(NOT a) AS n, count_if(NOT a AND b) AS f FROM g GROUP BY 1),
q AS (SELECT resample, sum(w * f)::DOUBLE / nullif(sum(w * n), 0) AS v FROM z JOIN w USING (contract_id) GROUP BY 1),
m AS (SELECT 'precision:' || label AS metric, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS v FROM s UNION ALL SELECT 'recall:' || label, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END FROM s
UNION ALL SELECT 'f1:' || label, CASE WHEN tp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END FROM s UNION ALL SELECT 'none_fp_rate', v FROM q)
{CI} FROM m GROUP BY metric""")
def bootstrap_family_ci(spark, d):
    """Per label precision, recall and F1 under resampling, and the none-FP rate."""
    rows = tuned(spark, d).where("split = 'test'")
    none = M.none_counts(rows, ["contract_id"])
    return r6(B.long_interval(B.resampled_family(M.label_counts(rows, ["contract_id", "label"]), none, test_weights(rows), "contract_id")))


@query(f"""WITH {O.long('score', 'tuned')}, {TEST_W.replace('200', '50')}, a AS (SELECT contract_id, label, p, count_if(y) AS pos, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT resample, label, p, sum(w * pos) AS pos, sum(w * n) AS n FROM a JOIN w USING (contract_id) GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w2 AS tp, sum(n) OVER w2 AS seen FROM b WINDOW w2 AS (PARTITION BY resample, label ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT resample, 'ap:' || label AS metric, sum(pos * tp::DOUBLE / seen) / nullif(sum(pos), 0) AS v FROM c GROUP BY ALL),
z AS (SELECT metric, v FROM m UNION ALL SELECT 'macro_ap', avg(v) FROM m GROUP BY resample) {CI} FROM z GROUP BY metric""")
def bootstrap_ap_ci(spark, d):
    """Average precision per label under resampling, and its mean over the labels that a resample supports."""
    rows = long(spark, d).where("split = 'test'")
    ap = B.resampled_ap(rows, test_weights(rows, 50), "contract_id", ["label"])
    each = ap.select("resample", F.concat(F.lit("ap:"), F.col("label")).alias("metric"), F.col("ap").alias("v"))
    macro = ap.groupBy("resample").agg(F.avg("ap").alias("v")).select("resample", F.lit("macro_ap").alias("metric"), "v")
    return r6(B.long_interval(each.unionByName(macro)))


@query(f"""WITH {O.tuned()}, l AS (SELECT split, label, {O.COUNTS} FROM tuned GROUP BY ALL), sup AS (SELECT label, count(DISTINCT contract_id) AS c FROM tuned WHERE y AND split = 'test' GROUP BY 1),
rules AS (SELECT 'all' AS rule, label FROM sup UNION ALL SELECT 'supported', label FROM sup WHERE c >= 10 UNION ALL SELECT 'priced', label FROM sup WHERE label <> 'buy')
SELECT split, rule, {r6s('avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) FILTER (WHERE tp + fn > 0)')} AS macro_f1, {r6s('2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} AS micro_f1, count(*) AS labels
FROM l JOIN rules USING (label) WHERE tp + fn > 0 GROUP BY split, rule""")
def evaluate_scopes(spark, d):
    """The summary per split (scope) and rule, a rule being a set of labels."""
    rows = tuned(spark, d)
    sup = rows.where("y and split = 'test'").groupBy("label").agg(F.countDistinct("contract_id").alias("c"))
    rules = sup.select(F.lit("all").alias("rule"), "label").unionByName(sup.where("c >= 10").select(F.lit("supported").alias("rule"), "label")).unionByName(sup.where("label <> 'buy'").select(F.lit("priced").alias("rule"), "label"))
    scoped = M.prf(M.label_counts(rows, ["split", "label"])).where("support > 0").join(rules, "label")
    s = {c: F.sum(c) for c in ("tp", "fp", "fn")}
    return r6(scoped.groupBy("split", "rule").agg(F.avg("f1").alias("macro_f1"), M.ratio(2 * s["tp"], 2 * s["tp"] + s["fp"] + s["fn"]).alias("micro_f1"), F.count("*").alias("labels")))


@query(f"""WITH {O.long()}, v AS (SELECT * FROM long WHERE split = 'val'), {O.grid('v', 'label')}, f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(tp + fp + positives, 0), 0) AS f1 FROM grid),
b AS (SELECT label, t FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, abs(i - 50), i) = 1), h AS (SELECT label, coalesce(max(t) FILTER (WHERE tp::DOUBLE / nullif(positives, 0) >= 0.9), 0.01) AS t90, max(positives) AS pos FROM grid GROUP BY 1),
pts AS (SELECT 'rule' AS point, label, t FROM b UNION ALL SELECT 'high_recall', label, CASE WHEN pos = 0 THEN t ELSE least(t, t90) END FROM b JOIN h USING (label)),
c AS (SELECT point, label, count_if(y AND p >= t) AS tp, count_if(NOT y AND p >= t) AS fp, count_if(y AND p < t) AS fn FROM v JOIN pts USING (label) GROUP BY ALL),
s AS (SELECT point, segment_id, bool_or(y) AS a, bool_or(p >= t) AS b FROM v JOIN pts USING (label) GROUP BY ALL), n AS (SELECT point, count_if(NOT a AND b)::DOUBLE / count_if(NOT a) AS r FROM s GROUP BY 1)
SELECT point, {r6s('avg(2.0::DOUBLE * tp / (2 * tp + fp + fn))')} AS macro_f1, {r6s('2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} AS micro_f1, {r6s('sum(tp)::DOUBLE / sum(tp + fp)')} AS micro_precision,
{r6s('sum(tp)::DOUBLE / sum(tp + fn)')} AS micro_recall, {r6s('any_value(r)')} AS none_fp_rate FROM c JOIN n USING (point) GROUP BY point""")
def operating_points(spark, d):
    """Both threshold tables as operating points: micro and macro scores and the none-FP rate at each."""
    rows = long(spark, d).where("split = 'val'")
    rule = H.best_f1(rows, ["label"])
    points = rule.select(F.lit("rule").alias("point"), "label", "threshold").unionByName(H.high_recall(rows, rule).select(F.lit("high_recall").alias("point"), "label", "threshold"))
    at = rows.join(points, "label").withColumn("pred", F.col("p") >= F.col("threshold"))
    none = M.none_counts(at, ["point"]).select("point", M.ratio(F.col("none_fp"), F.col("none")).alias("none_fp_rate"))
    return r6(M.macro_micro(M.label_counts(at, ["point", "label"]), ["point"]).join(none, "point"))


# ---- label maps, keys, small rules

MAP = {"buy": "trade", "pricey": "trade", "hot": None}


@query(f"""WITH {O.long()}, g AS (SELECT segment_id, list_distinct(list_filter(list(CASE label WHEN 'buy' THEN 'trade' WHEN 'pricey' THEN 'trade' END) FILTER (WHERE y), lambda x: x IS NOT NULL)) AS l, bool_or(y AND label = 'hot') AS rare FROM long GROUP BY 1)
SELECT segment_id, coalesce(array_to_string(l, ','), '') AS labels, coalesce(len(l), 0) = 0 AND rare AS exclude FROM g""")
def label_map_exclusion(spark, d):
    """Raw categories mapped to labels (or to none); a segment of rare categories alone is marked for exclusion."""
    g = C.mapped_labels(long(spark, d).where("y"), "segment_id", "label", MAP, {"hot"})
    every = long(spark, d).select("segment_id").distinct()
    return every.join(g, "segment_id", "left").select("segment_id", F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"), F.coalesce("exclude", F.lit(False)).alias("exclude"))


@query(f"""WITH {O.long()}, g AS (SELECT split, segment_id, bool_or(y AND label <> 'hot') AS kept, bool_or(y AND label = 'hot') AS rare FROM long GROUP BY ALL)
SELECT split, count_if(rare AND NOT kept)::BIGINT AS excluded, count_if(NOT (rare AND NOT kept))::BIGINT AS loaded FROM g GROUP BY split""")
def load_filter(spark, d):
    """How many segments of a split are left out on loading, and how many are loaded."""
    rows = long(spark, d)
    g = rows.select("split", "segment_id").distinct().join(C.mapped_labels(rows.where("y"), "segment_id", "label", MAP, {"hot"}), "segment_id", "left")
    out = F.coalesce("exclude", F.lit(False))
    return g.groupBy("split").agg(M.n_if(out).alias("excluded"), M.n_if(~out).alias("loaded"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(p_type, '_', ' ')), '[^a-z ]', '', 'g'), '\b(filing|agreements?)\b', '', 'g'), ' +', ' ', 'g')) AS type_key FROM part""")
def type_keys(spark, d):
    return P.table(spark, d, "part").select("p_partkey", C.type_key(F.col("p_type")).alias("type_key"))


MESSAGE = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Timeout after 60 s' WHEN 2 THEN 'HTTP 429: slow down' WHEN 3 THEN 'HTTP 503: busy' WHEN 4 THEN 'HTTP 400: bad' ELSE 'connection reset' END"


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN m IS NULL THEN 'none' WHEN lower(m) LIKE 'timeout%' THEN 'timeout' WHEN m LIKE 'HTTP 429%' THEN 'rate_limit' WHEN m LIKE 'HTTP 5%' THEN 'server' WHEN m LIKE 'HTTP 4%' THEN 'client' ELSE 'other' END AS kind
FROM (SELECT {MESSAGE} AS m FROM events)) GROUP BY kind""")
def transport_errors(spark, d):
    m = P.table(spark, d, "events").select(F.expr(MESSAGE).alias("m"))
    return m.groupBy(F.coalesce(L.transport_error(F.col("m")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH u AS (SELECT user_id, sum(value) AS spent, avg(value) * 10 AS projected FROM events GROUP BY 1)
SELECT user_id, CASE WHEN spent >= 8000 THEN 'stop' WHEN spent + projected > 8000 THEN 'shrink' WHEN spent + projected >= 6400 THEN 'ask' ELSE 'go' END AS branch FROM u""")
def budget_branches(spark, d):
    u = P.table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("spent"), (F.avg("value") * 10).alias("projected"))
    return u.select("user_id", L.budget_branch(F.col("spent"), F.col("projected"), F.lit(8000.0)).alias("branch"))


@query("""WITH t AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 0 ELSE user_id * 10 END AS cached FROM events)
SELECT event_id, round((event_id % 1000 * 3.0 + cached * CASE event_id % 2 WHEN 0 THEN 0.3 ELSE 3.0 END + user_id * 15.0)::DOUBLE / 1e6, 9) AS cost FROM t""")
def call_costs(spark, d):
    """Two price models: one charges cached tokens apart, one as input."""
    e = P.table(spark, d, "events").select("event_id", F.create_map(F.lit("input"), F.col("event_id") % 1000, F.lit("cached"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") * 10), F.lit("output"), F.col("user_id")).alias("tokens"))
    apart, plain = L.call_cost("tokens", {"input": 3, "cached": 0.3, "output": 15}), L.call_cost("tokens", {"input": 3, "output": 15})
    return e.select("event_id", F.round(F.when(F.col("event_id") % 2 == 0, apart).otherwise(plain), 9).alias("cost"))


@query("""SELECT event_type, 'in' AS kind, sum(event_id % 100)::BIGINT AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, 'retry', sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT FROM events GROUP BY 1""")
def token_totals(spark, d):
    """Sums of map entries per group: tokens, and retries as one more kind."""
    e = P.table(spark, d, "events").select("event_type", F.create_map(F.lit("in"), F.col("event_id") % 100, F.lit("retry"), (F.col("event_id") % 7 == 0).cast("long")).alias("m"))
    return L.token_sums(e, ["event_type"], "m")


# ---- joins and sets


@query("""SELECT (SELECT count(*) FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND lang = 'en')) AS kept,
(SELECT count(*) FROM documents d WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS uncovered""")
def restricted_labels(spark, d):
    """Labels of English documents (semi join), and the English documents that no label covers."""
    en = P.table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    lab = P.table(spark, d, "labels")
    return lab.join(en, "doc_id", "left_semi").agg(F.count("*").alias("kept")).crossJoin(en.join(lab, "doc_id", "left_anti").agg(F.count("*").alias("uncovered")))


@query(f"""WITH {O.SPANS}, {O.UNION_}, g AS (SELECT user_id, i * 720 AS a, i * 720 + 720 AS z FROM (SELECT user_id, unnest(range(min(start) // 720, (max("end") - 1) // 720 + 1)) AS i FROM u GROUP BY user_id)),
c AS (SELECT g.user_id, a, z, event_type, max((least(z, "end") - greatest(a, start))::DOUBLE / ("end" - start)) AS x, sum(least(z, "end") - greatest(a, start))::DOUBLE / 720 AS y FROM g JOIN u ON g.user_id = u.user_id AND start < z AND a < "end" GROUP BY ALL),
h AS (SELECT * FROM c WHERE x >= 0.5 OR y >= 0.5)
SELECT u.event_type, count(*) AS spans, count_if(EXISTS (SELECT 1 FROM h WHERE h.user_id = u.user_id AND h.event_type = u.event_type AND h.a < u."end" AND u.start < h.z))::BIGINT AS found FROM u GROUP BY 1""")
def span_recall(spark, d):
    """Merged spans, and those of them that overlap a segment which carries their category."""
    merged = I.union_intervals(spans(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    pairs = I.overlap_join(merged, I.fixed_segments(merged, "user_id", 720), "user_id", bucket=1440)
    carried = I.covered(pairs, ["user_id", "g_start", "event_type"]).select("user_id", "g_start", "event_type")
    found = pairs.join(carried, ["user_id", "g_start", "event_type"], "left_semi").select("user_id", "event_type", "s_start").distinct().withColumn("hit", F.lit(1))
    return merged.join(found, ["user_id", "event_type", "s_start"], "left").groupBy("event_type").agg(F.count("*").alias("spans"), F.count("hit").alias("found"))


@query(f"""WITH {O.tuned()}, g AS (SELECT contract_id, label, bool_or(y) AS y, bool_or(pred) AS p FROM tuned WHERE split = 'test' GROUP BY ALL)
SELECT contract_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE y AND p), '') AS common, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE p AND NOT y), '') AS extra,
coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE y AND NOT p), '') AS missed FROM g GROUP BY contract_id""")
def contract_label_sets(spark, d):
    """Per contract the union of its segments' labels, true and predicted, and their set algebra."""
    rows = tuned(spark, d).where("split = 'test'")
    g = rows.groupBy("contract_id").agg(F.collect_set(F.when(F.col("y"), F.col("label"))).alias("t"), F.collect_set(F.when(F.col("pred"), F.col("label"))).alias("p"))
    told = lambda a: F.array_join(F.sort_array(a), ",")
    return g.select("contract_id", told(F.array_intersect("p", "t")).alias("common"), told(F.array_except("p", "t")).alias("extra"), told(F.array_except("t", "p")).alias("missed"))


@query(f"""WITH {O.tuned()}, {O.tuned('other', 'tb')}, a AS (SELECT contract_id, label, bool_or(pred) AS p FROM tuned WHERE split = 'test' GROUP BY ALL), b AS (SELECT contract_id, label, bool_or(pred) AS p FROM tb WHERE split = 'test' GROUP BY ALL)
SELECT label, CASE WHEN a.p AND b.p THEN 'both' WHEN a.p THEN 'a' WHEN b.p THEN 'b' ELSE 'neither' END AS kind, count(*) AS n FROM a JOIN b USING (contract_id, label) GROUP BY ALL""")
def model_kinds(spark, d):
    """Contracts and labels by who flags them: a, b, both or neither."""
    one = lambda s: tuned(spark, d, s).where("split = 'test'").groupBy("contract_id", "label").agg(F.bool_or("pred").alias(f"p_{s}"))
    a, b = F.col("p_score"), F.col("p_other")
    j = one("score").join(one("other"), ["contract_id", "label"], "full")
    return j.groupBy("label", F.when(a & b, "both").when(a, "a").when(b, "b").otherwise("neither").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT role AS name FROM conversations UNION SELECT event_type FROM events UNION SELECT lang FROM documents")
def type_union(spark, d):
    one = lambda t, c: P.table(spark, d, t).select(F.col(c).alias("name"))
    return one("conversations", "role").union(one("events", "event_type")).union(one("documents", "lang")).distinct()


# ---- counts and summaries


@query(f"""SELECT lang, min(length(text))::BIGINT AS least, {r6s('avg(length(text))')} AS mean, {r6s('stddev_samp(length(text))')} AS std, {r6s('quantile_cont(length(text)::DOUBLE, 0.25)')} AS q25,
{r6s('quantile_cont(length(text)::DOUBLE, 0.75)')} AS q75, {r6s('quantile_cont(length(text)::DOUBLE, 0.99)')} AS q99, max(length(text))::BIGINT AS most FROM documents GROUP BY lang""")
def describe_lengths(spark, d):
    n = P.table(spark, d, "documents").select("lang", F.length("text").alias("n")).groupBy("lang", "n").agg(F.count("*").alias("c"))
    total, mean = F.sum("c"), F.sum(F.col("n") * F.col("c")) / F.sum("c")
    q = lambda p: F.percentile("n", F.lit(p), F.col("c"))
    std = F.sqrt((F.sum(F.col("n").cast("double") * F.col("n") * F.col("c")) - total * mean * mean) / (total - 1))
    return r6(n.groupBy("lang").agg(F.min("n").cast("long").alias("least"), mean.alias("mean"), std.alias("std"), q(0.25).alias("q25"), q(0.75).alias("q75"), q(0.99).alias("q99"), F.max("n").cast("long").alias("most")))


@query(f"""WITH {O.long('run1', 'l1')}, {O.long('run2', 'l2')}, {O.long('run3', 'l3')}, a AS (SELECT segment_id, label, p FROM l1 UNION ALL SELECT segment_id, label, p FROM l2 UNION ALL SELECT segment_id, label, p FROM l3),
g AS (SELECT segment_id, label, count(DISTINCT p >= 0.5::DOUBLE) AS k, list(p) FILTER (WHERE p > 0) AS v FROM a GROUP BY ALL),
h AS (SELECT label, k, CASE len(v) WHEN 3 THEN abs(v[1] - v[2]) + abs(v[1] - v[3]) + abs(v[2] - v[3]) WHEN 2 THEN abs(v[1] - v[2]) ELSE 0 END AS s, CASE len(v) WHEN 3 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS m FROM g)
SELECT label, {r6s('avg((k = 1)::INT)')} AS agree, {r6s('sum(s) / sum(m)')} AS mean_diff FROM h GROUP BY label""")
def label_agreement(spark, d):
    """Per label: how often three runs agree, and the mean difference of their confidences."""
    rows = None
    for name in ("run1", "run2", "run3"):
        one = long(spark, d, name).select(F.lit(name).alias("run"), "segment_id", "label", "p")
        rows = one if rows is None else rows.unionByName(one)
    return r6(L.label_repeatability(rows, 0.5))


@query(f"""WITH {O.long()} SELECT label, count(*) AS n, {r6s('count_if(y AND p >= 0.5)::DOUBLE / nullif(count_if(p >= 0.5), 0)')} AS precision, {r6s('count_if(y AND p >= 0.5)::DOUBLE / nullif(count_if(y), 0)')} AS recall,
count_if(p > 0 AND p < 0.1)::BIGINT AS below_floor FROM long WHERE split = 'val' GROUP BY label""")
def probe_stats(spark, d):
    """A probe at the plain cut: precision and recall at 0.5, and scores under the floor."""
    rows = long(spark, d).where("split = 'val'").withColumn("pred", F.col("p") >= 0.5)
    c = rows.groupBy("label").agg(F.count("*").alias("n"), M.n_if((F.col("p") > 0) & (F.col("p") < 0.1)).alias("below_floor"))
    f = M.label_counts(rows, ["label"]).select("label", M.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), M.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return r6(c.join(f, "label"))


@query(f"""WITH {O.tuned()}, f AS (SELECT * FROM tuned WHERE split = 'test' AND pred)
SELECT contract_id, label, count(*) AS n, string_agg(segment_id::VARCHAR, ',' ORDER BY segment_id) AS segments, {r6s('max(p)')} AS best FROM f GROUP BY ALL""")
def clause_summary(spark, d):
    """Per contract and label its flagged segments, their number and the best confidence; a contract's segments are few."""
    f = tuned(spark, d).where("split = 'test' and pred").groupBy("contract_id", "label")
    return r6(f.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("segment_id")), lambda x: x.cast("string")), ",").alias("segments"), F.max("p").alias("best")))


@query(f"""WITH {O.tuned()} SELECT label, count(*) AS n FROM tuned WHERE pred GROUP BY label ORDER BY n DESC, label""")
def flag_counts(spark, d):
    return tuned(spark, d).where("pred").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


PARITY = "count(*) AS pairs, count_if((a.p >= 0.5::DOUBLE) <> (b.p >= 0.5::DOUBLE))::BIGINT AS disagreements, count_if(a.p >= 0.5::DOUBLE OR b.p >= 0.5::DOUBLE)::BIGINT AS flagged"


@query(f"""WITH {O.long()}, {O.long('other', 'lb')}, t AS (SELECT label, {PARITY}, max(abs(a.p - b.p)) AS m FROM long a JOIN lb b USING (segment_id, label) GROUP BY label)
SELECT label, pairs, disagreements, flagged, {r6s('m')} AS max_diff, disagreements = 0 OR disagreements * 1000 <= pairs AND disagreements * 100 <= flagged AS passed FROM t""")
def parity_totals(spark, d):
    """Two deployments' scores of the same pairs, and whether they pass as equal."""
    rows = long(spark, d).select("segment_id", "label", "p").join(long(spark, d, "other").select("segment_id", "label", F.col("p").alias("q")), ["segment_id", "label"])
    return r6(K.parity(rows, ["label"], "p", "q", 0.5))


@query("""SELECT source, lang, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share, count_if(length(text) >= 5000)::BIGINT AS truncated FROM documents GROUP BY source, lang""")
def listing_report(spark, d):
    """Counts and shares by source and language, and those over a page's bound."""
    g = P.table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), M.n_if(F.length("text") >= 5000).alias("truncated"))
    return r6(g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("source"))).select("source", "lang", "n", "share", "truncated"))


@query(f"""WITH {O.SPANS}, {O.UNION_}, w AS (SELECT unnest([360, 720, 1440]) AS width), c AS (SELECT unnest([0.25, 0.5]) AS cover), g AS (SELECT width, user_id, i * width AS a, i * width + width AS z FROM (SELECT width, user_id, unnest(range(min(start) // width, (max("end") - 1) // width + 1)) AS i FROM u, w GROUP BY width, user_id)),
o AS (SELECT width, g.user_id, a, event_type, max((least(z, "end") - greatest(a, start))::DOUBLE / ("end" - start)) AS x, sum((least(z, "end") - greatest(a, start))::DOUBLE / width) AS y FROM g JOIN u ON g.user_id = u.user_id AND start < z AND a < "end" GROUP BY ALL),
l AS (SELECT width, cover, user_id, a, count_if(x >= cover OR y >= cover) AS k FROM o, c GROUP BY ALL), s AS (SELECT width, cover, count(*) AS labelled, count_if(k = 1) AS one, count_if(k = 2) AS two, count_if(k >= 3) AS more FROM l WHERE k > 0 GROUP BY ALL), t AS (SELECT width, count(*) AS n FROM g GROUP BY 1)
SELECT width, cover::DOUBLE AS cover, n AS segments, {r6s('100.0 * (n - labelled) / n')} AS none_pct, {r6s('100.0 * one / labelled')} AS one_pct, {r6s('100.0 * two / labelled')} AS two_pct, {r6s('100.0 * more / labelled')} AS more_pct FROM s JOIN t USING (width)""")
def segment_grid(spark, d):
    """Segment statistics per cell of a grid of widths and coverage thresholds."""
    merged = I.union_intervals(spans(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    out = None
    for width in (360, 720, 1440):
        segs = I.fixed_segments(merged, "user_id", width)
        pairs = I.overlap_join(merged, segs, "user_id", bucket=1440)
        total = segs.agg(F.count("*").alias("segments"))
        for cover in (0.25, 0.5):
            k = I.covered(pairs, ["user_id", "g_start", "event_type"], cover).groupBy("user_id", "g_start").agg(F.count("*").alias("k"))
            s = k.agg(F.count("*").alias("l"), *(M.n_if(c).alias(f"_{a}") for a, c in (("one", F.col("k") == 1), ("two", F.col("k") == 2), ("more", F.col("k") >= 3)))).crossJoin(total)
            pct = lambda c: (100 * M.ratio(F.col(f"_{c}"), F.col("l"))).alias(f"{c}_pct")
            one = s.select(F.lit(width).alias("width"), F.lit(cover).alias("cover"), "segments", (100 * (F.col("segments") - F.col("l")) / F.col("segments")).alias("none_pct"), pct("one"), pct("two"), pct("more"))
            out = one if out is None else out.unionByName(one)
    return r6(out)


@query("""SELECT 'stars' AS pattern, count_if(regexp_matches(text, '\\*{3,}'))::BIGINT AS documents, sum(len(regexp_extract_all(text, '\\*{3,}')))::BIGINT AS hits FROM documents
UNION ALL SELECT 'lines', count_if(regexp_matches(text, '_{5,}'))::BIGINT, sum(len(regexp_extract_all(text, '_{5,}')))::BIGINT FROM documents
UNION ALL SELECT 'brackets', count_if(regexp_matches(text, '\\[[^\\]\\n]{1,40}\\]'))::BIGINT, sum(len(regexp_extract_all(text, '\\[[^\\]\\n]{1,40}\\]')))::BIGINT FROM documents""")
def redaction_census(spark, d):
    """Documents and places that match each pattern, in one pass."""
    patterns = {"stars": r"\*{3,}", "lines": "_{5,}", "brackets": r"\[[^\]\n]{1,40}\]"}
    hits = P.table(spark, d, "documents").select(F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in patterns.items()))).alias("x")).select("x.*")
    return hits.groupBy("pattern").agg(M.n_if(F.col("n") > 0).alias("documents"), F.sum("n").cast("long").alias("hits"))


@query(f"""WITH {O.long()}, q AS (SELECT label, avg(y::INT) AS q FROM long WHERE split = 'val' GROUP BY 1), e AS (SELECT label, y, q, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM long JOIN q USING (label) WHERE split = 'test')
SELECT label, {r6s('avg(-CASE WHEN y THEN ln(q) ELSE ln(1 - q) END)')} AS prior_bce, {r6s('avg(-CASE WHEN y THEN ln(p) ELSE ln(1 - p) END)')} AS bce FROM e GROUP BY label""")
def cross_entropy(spark, d):
    """Binary cross-entropy of the scores, and of the prior share alone."""
    rows = long(spark, d)
    prior = rows.where("split = 'val'").groupBy("label").agg(F.avg(F.col("y").cast("double")).alias("q"))
    return r6(M.cross_entropy(rows.where("split = 'test'").join(prior, "label"), ["label"]))


# ---- top lists, windows, navigation

TOKEN = r"unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1))"


@query(f"SELECT w, count(*) AS n FROM (SELECT {TOKEN} AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 15")
def common_words(spark, d):
    return P.table(spark, d, "documents").select(F.explode(words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(15)


@query("SELECT doc_id, length(text)::BIGINT AS chars FROM documents ORDER BY chars DESC, doc_id LIMIT 10")
def longest_documents(spark, d):
    return P.table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars")).orderBy(F.desc("chars"), "doc_id").limit(10)


@query(f"""WITH {O.tuned()} SELECT label, segment_id FROM tuned WHERE y AND pred QUALIFY row_number() OVER (PARTITION BY label ORDER BY segment_id) <= 5""")
def head_examples(spark, d):
    """The first five hits of every label."""
    w = W.partitionBy("label").orderBy("segment_id")
    return tuned(spark, d).where("y and pred").withColumn("r", F.row_number().over(w)).where("r <= 5").select("label", "segment_id")


@query("""SELECT conv_id // 10 AS block, text, min(conv_id * 1000 + turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1, 2""")
def first_seen(spark, d):
    """The user texts of a block of ten conversations, each at the place where it is first seen."""
    c = P.table(spark, d, "conversations").where("role = 'user'").select(F.floor(F.col("conv_id") / 10).alias("block"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return c.groupBy("block", "text").agg(F.min("at").alias("first"))


@query(f"""WITH {O.tuned()}, f AS (SELECT DISTINCT contract_id, segment_id FROM tuned WHERE split = 'test' AND pred)
SELECT contract_id, segment_id, coalesce(lead(segment_id) OVER w, first_value(segment_id) OVER w) AS next, coalesce(lag(segment_id) OVER w, max(segment_id) OVER (PARTITION BY contract_id)) AS previous FROM f WINDOW w AS (PARTITION BY contract_id ORDER BY segment_id)""")
def flag_navigation(spark, d):
    """From every flagged segment to the next and the previous one of its contract, round the ends."""
    f = tuned(spark, d).where("split = 'test' and pred").select("contract_id", "segment_id").distinct()
    w, whole = W.partitionBy("contract_id").orderBy("segment_id"), W.partitionBy("contract_id")
    return f.select("contract_id", "segment_id", F.coalesce(F.lead("segment_id").over(w), F.min("segment_id").over(whole)).alias("next"), F.coalesce(F.lag("segment_id").over(w), F.max("segment_id").over(whole)).alias("previous"))


# ---- text and prompts


@query("SELECT p_partkey, 'https://example.org/' || p_size || '/' || replace(p_brand, '#', '') || '.txt' AS url FROM part")
def url_template(spark, d):
    return P.table(spark, d, "part").select("p_partkey", F.format_string("https://example.org/%d/%s.txt", F.col("p_size").cast("int"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("url"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN contains(substr(t, 1, 401), ' ') THEN regexp_replace(substr(t, 1, 401), ' [^ ]*$', '') ELSE substr(t, 1, 400) END AS snippet FROM s""")
def snippets(spark, d):
    return P.table(spark, d, "documents").select("doc_id", C.snippet(F.col("text"), 400).alias("snippet"))


@query(r"""SELECT page_id, trim(regexp_replace(split_part('Highlight the parts. Details: ' || url || E' \n  of a  page', 'Details:', 2), '\s+', ' ', 'g')) AS definition FROM pages""")
def definitions(spark, d):
    """What a question says behind "Details:", white space collapsed."""
    q = F.concat(F.lit("Highlight the parts. Details: "), F.col("url"), F.lit(" \n  of a  page"))
    return P.table(spark, d, "pages").select("page_id", C.definition(q).alias("definition"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\n{2,}', chr(1), 'g'), '\n', ' ', 'g'), chr(1), E'\n\n', 'g')) AS sha FROM documents""")
def reflowed(spark, d):
    """Wrapped lines joined, blank lines kept."""
    return P.table(spark, d, "documents").select("doc_id", F.sha2(C.reflow(F.col("text")), 256).alias("sha"))


@query("""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS win FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, win ORDER BY turn) AS k FROM r)
SELECT conv_id, win AS "window", string_agg('<segment id="S' || k || '" role="' || CASE role WHEN 'user' THEN 'target' ELSE 'context' END || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</segment>', chr(10) ORDER BY turn) AS prompt FROM n GROUP BY ALL""")
def prompt_windows(spark, d):
    """Windows of three turns as prompts, with local ids and each segment's role."""
    c = S.consecutive_windows(P.table(spark, d, "conversations"), "conv_id", "turn", 3)
    return C.prompts(c, ["conv_id", "window"], "turn", F.when(F.col("role") == "user", "target").otherwise("context"), F.col("text"))


# ---- drift


@query("""WITH u AS (SELECT user_id, round(avg(value), 1) AS a, round(max(value), 1) AS b FROM events GROUP BY 1), n AS (SELECT * FROM u WHERE user_id % 2 = 0),
p AS (SELECT user_id, (1 + (SELECT count(*) FROM n WHERE n.a >= u.a))::DOUBLE / (1 + (SELECT count(*) FROM n)) AS p1, (1 + (SELECT count(*) FROM n WHERE n.b >= u.b))::DOUBLE / (1 + (SELECT count(*) FROM n)) AS p2 FROM u WHERE user_id % 2 = 1)
SELECT user_id, round(least(p1, p2), 6) AS min_p FROM p""")
def min_p_family(spark, d):
    """The least p-value of a family of two statistics."""
    u = P.table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 1).alias("a"), F.round(F.max("value"), 1).alias("b"))
    one = lambda v: D.upper_p(u.where("user_id % 2 = 0").select("user_id", v), u.where("user_id % 2 = 1").select("user_id", v), "user_id", v).select("user_id", F.col("p").alias(f"p_{v}"))
    return r6(D.min_p(one("a").join(one("b"), "user_id"), ["p_a", "p_b"]).select("user_id", "min_p"))


U = "u AS (SELECT user_id, user_id % 4 AS ctype, avg(value) AS v FROM events GROUP BY 1)"


@query(f"""WITH {U}, k AS (SELECT user_id AS contract_id, ctype FROM u), {O.weights('k', 'contract_id', 'ctype', 20, 'nested')},
b AS (SELECT resample, batch, contract_id, w FROM w, (SELECT unnest(range(10)) AS batch)), r AS (SELECT *, row_number() OVER (PARTITION BY resample, batch ORDER BY {O.draw('inner', 'resample', 'batch', 'contract_id', 'c')}, contract_id, c) AS i FROM (SELECT *, unnest(range(1, w::BIGINT + 1)) AS c FROM b)),
m AS (SELECT resample, batch, avg(v) AS v FROM r JOIN u ON r.contract_id = u.user_id WHERE i <= 5 GROUP BY ALL), a AS (SELECT resample, avg((v > 60)::INT) AS v FROM m GROUP BY 1)
SELECT 'alarm_rate' AS metric, {r6s('quantile_cont(v, 0.025)')} AS low, {r6s('quantile_cont(v, 0.975)')} AS high, count(v) AS n FROM a""")
def nested_alarm_rate(spark, d):
    """Contracts resampled, batches drawn within each resample, alarms counted over the batches, an interval over resamples."""
    u = P.table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v")).withColumn("ctype", F.col("user_id") % 4)
    w = B.weights(u.select("user_id", "ctype"), "user_id", "ctype", 20, "nested")
    means = D.nested_batches(w.join(u.select("user_id", "v"), "user_id"), "user_id", "v", k=5, n=10, stream="inner")
    rate = means.groupBy("resample").agg(F.avg((F.col("v") > 60).cast("double")).alias("v")).select("resample", F.lit("alarm_rate").alias("metric"), "v")
    return r6(B.long_interval(rate))


@query(f"""WITH {U}, s AS (SELECT CASE user_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'shift' ELSE 'val' END AS part, v FROM u)
SELECT part, {r6s('avg((v > 60)::INT)')} AS alarm_rate, {r6s('avg(v)')} AS mean_value, count_if(v IS NULL)::BIGINT AS missing FROM s GROUP BY part""")
def alarm_summary(spark, d):
    """Per set of batches the alarm rate, the mean value and how many values are missing."""
    u = P.table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    part = F.when(F.col("user_id") % 3 == 0, "test").when(F.col("user_id") % 3 == 1, "shift").otherwise("val")
    return r6(u.groupBy(part.alias("part")).agg(F.avg((F.col("v") > 60).cast("double")).alias("alarm_rate"), F.avg("v").alias("mean_value"), M.n_if(F.col("v").isNull()).alias("missing")))


# ---- checks


@query("""SELECT 'wrong offsets' AS "check", 0::BIGINT AS n UNION ALL SELECT 'impossible with answers', 0 UNION ALL SELECT 'text differs', (SELECT count(*) FROM documents WHERE text <> trim(text, E' \\t\\n\\x0b\\x0c\\r'))
UNION ALL SELECT 'several langs of a source', (SELECT count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT coalesce(lang, chr(0) || 'null')) > 1))
UNION ALL SELECT 'not labelled once', (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) + (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1))""")
def refusal_counts(spark, d):
    """What the corpus checks would refuse: each check with the number of its violations."""
    docs = P.table(spark, d, "documents")
    marks = docs.select("doc_id", F.lit(0).alias("s"), F.least(F.length("text"), F.lit(9)).alias("e"), F.substring("text", 1, 9).alias("answer"))
    stripped = docs.select("doc_id", F.regexp_replace("text", r"^\s+|\s+$", "").alias("other"))
    return K.counted({
        "wrong offsets": K.wrong_offsets(marks, docs, "doc_id", "text", "s", "e", "answer"),
        "impossible with answers": K.inconsistent(docs.select((F.lit(False)).alias("none"), F.lit(1).alias("answers")), "none", "answers"),
        "text differs": K.text_match(docs, stripped, "doc_id", "text", "other").where("kind <> 'exact'"),
        "several langs of a source": K.differing(docs, ["source"], "lang"),
        "not labelled once": K.not_covered_once(docs, P.table(spark, d, "labels"), ["doc_id"]),
    })


@query(f"""WITH {O.long()}, a AS (SELECT segment_id, label, split, ctype FROM long), b AS (SELECT segment_id, label, CASE WHEN segment_id % 50 = 0 THEN 'x' ELSE split END AS split, ctype FROM long WHERE segment_id % 97 <> 0)
SELECT 'only a' AS "check", count_if(b.segment_id IS NULL)::BIGINT AS n FROM a LEFT JOIN b USING (segment_id, label) UNION ALL SELECT 'only b', 0 UNION ALL SELECT 'split differs', count_if(a.split <> b.split)::BIGINT FROM a JOIN b USING (segment_id, label)
UNION ALL SELECT 'ctype differs', 0 UNION ALL SELECT 'repeated in a', 0 UNION ALL SELECT 'repeated in b', 0""")
def prediction_pair_audit(spark, d):
    """Two prediction tables that should cover the same rows: what is missing, repeated or unequal."""
    a = long(spark, d).select("segment_id", "label", "split", "ctype")
    b = a.where("segment_id % 97 <> 0").withColumn("split", F.when(F.col("segment_id") % 50 == 0, "x").otherwise(F.col("split")))
    return K.pair_audit(a, b, ["segment_id", "label"], ["split", "ctype"])


@query("""SELECT 'missing calls' AS "check", greatest(2000000 - count(*), 0)::BIGINT AS n FROM events UNION ALL SELECT 'slow', count_if(value > 400)::BIGINT FROM events UNION ALL SELECT 'unparsed', count_if(json_extract_string(props, '$.k') IS NULL)::BIGINT FROM events""")
def smoke_gate(spark, d):
    e = P.table(spark, d, "events")
    return K.smoke_violations(e, 2_000_000, {"slow": F.col("value") > 400, "unparsed": F.get_json_object("props", "$.k").isNull()})


@query("""SELECT customer.c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS json FROM customer""")
def json_export(spark, d):
    """Rows as JSON objects, the sink of reports and bundles."""
    c = P.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return c.select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_nationkey"), {"ignoreNullFields": "false"}).alias("json"))


@query(r"""WITH t AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), w AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1) AS w FROM t),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, common, round(greatest(common::DOUBLE / x.n, common::DOUBLE / y.n), 6) AS containment FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE greatest(common::DOUBLE / x.n, common::DOUBLE / y.n) > 0.5""")
def near_duplicates(spark, d):
    """Texts that lie by more than half in another one, by shingles of eight words; equal texts are one, named by the least id."""
    docs = C.without_copies(P.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return r6(C.contained_pairs(docs, "doc_id", "text", 0.5))
