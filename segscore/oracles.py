"""DuckDB SQL for the queries, on the same tables."""

from __future__ import annotations


def draw(stream: str, *keys: str) -> str:
    told = ", ".join(f"({k})::VARCHAR" for k in keys)
    return f"('0x' || substr(md5(concat_ws('|', '42', '{stream}', {told})), 1, 15))::BIGINT"


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


def long(stream: str = "score", name: str = "long") -> str:
    return f"""
seg_{name} AS (
  SELECT event_id AS segment_id, user_id AS contract_id, user_id % 4 AS ctype, value, event_type,
         json_extract_string(props, '$.k')::BIGINT AS k, {draw("split", "user_id")} % 3 AS part FROM events
), {name} AS (
  SELECT segment_id, contract_id, ctype, CASE part WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'shift' END AS split, label, y,
         0.6::DOUBLE * (({draw(stream, "label", "segment_id")} % 1000)::DOUBLE / 1000) + 0.4::DOUBLE * y::INT AS p
  FROM (SELECT *, CASE label WHEN 'buy' THEN event_type IN ('purchase', 'signup') WHEN 'hot' THEN coalesce(k >= 50, false) ELSE value > 250 END AS y
        FROM seg_{name} CROSS JOIN (VALUES ('buy'), ('hot'), ('pricey')) AS v(label))
)"""


def grid(rows: str, keys: str, name: str = "grid") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
{name} AS (
  SELECT {k}i, i / 100.0::DOUBLE AS t, count_if(y AND p >= i / 100.0::DOUBLE) AS tp, count_if(NOT y AND p >= i / 100.0::DOUBLE) AS fp, count_if(y) AS positives
  FROM {rows} CROSS JOIN (SELECT unnest(range(1, 100)) AS i) GROUP BY {k}i
)"""


def tuned(stream: str = "score", name: str = "tuned") -> str:
    rows = f"long_{name}"
    return f"""{long(stream, rows)}, val_{name} AS (SELECT * FROM {rows} WHERE split = 'val'), {grid(f"val_{name}", "label", f"grid_{name}")},
thr_{name} AS (
  SELECT label, t AS threshold, f1 AS best_f1 FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, abs(i - 50), i) AS r
    FROM (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(tp + fp + positives, 0), 0) AS f1 FROM grid_{name})) WHERE r = 1
), {name} AS (SELECT l.*, threshold, p >= threshold AS pred FROM {rows} l JOIN thr_{name} USING (label))"""


COUNTS = "count_if(y AND pred) AS tp, count_if(NOT y AND pred) AS fp, count_if(y AND NOT pred) AS fn"
F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"
AP = """
{name} AS (
  SELECT {k}sum(pos * tp::DOUBLE / seen) / nullif(sum(pos), 0) AS ap FROM (
    SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen
    FROM (SELECT {k}p, count_if(y) AS pos, count(*) AS n FROM {rows} GROUP BY {k}p)
    WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {keys}
)"""


def ap(rows: str, keys: str, name: str) -> str:
    return AP.format(rows=rows, keys=keys, k=f"{keys}, ", name=name)


CATEGORY_SUMMARY = f"""SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, {r6("quantile_cont(length(text)::DOUBLE, 0.5)")} AS median_chars,
{r6("quantile_cont(length(text)::DOUBLE, 0.9)")} AS p90_chars, count_if(contains(text, chr(10)))::BIGINT AS multiline, {r6("avg(length(text))")} AS mean_chars,
{r6("stddev_samp(length(text))")} AS std_chars, max(length(text))::BIGINT AS max_chars FROM documents GROUP BY lang"""

LABEL_SUPPORT_PIVOT = f"""WITH {long()}, s AS (SELECT DISTINCT label, split, contract_id FROM long WHERE y)
SELECT label, count_if(split = 'val')::BIGINT AS val, count_if(split = 'test')::BIGINT AS test, count_if(split = 'shift')::BIGINT AS shift FROM s GROUP BY label"""

SPLIT_SUMMARY = f"""WITH {long()}, s AS (SELECT split, segment_id, bool_or(y) AS a FROM long GROUP BY ALL)
SELECT split, count(*) AS segments, count_if(a)::BIGINT AS positive, count_if(NOT a)::BIGINT AS none, {r6("100.0 * count_if(NOT a) / count(*)")} AS none_pct FROM s GROUP BY split"""

RULE_SUPPORT_FILTER = f"WITH {long()} SELECT label, count(DISTINCT contract_id) AS contracts FROM long WHERE y AND split = 'test' GROUP BY label HAVING count(DISTINCT contract_id) >= 10"

OUTER_FLATTEN_PROPS = """SELECT event_id, CASE WHEN k >= 50 THEN 'k' END AS name, CASE WHEN k >= 50 THEN k END AS v
FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""

DENSE_KEY = "SELECT c_custkey, c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS key FROM customer"

NESTED_CORPUS = """SELECT doc_id::VARCHAR AS title, 0 AS paragraph_idx, source AS category, lang <> 'en' AS is_impossible, lang = 'en' AS has_answer,
CASE WHEN lang = 'en' THEN substr(text, 1, 5) END AS answer_text, CASE WHEN lang = 'en' THEN 0 END::BIGINT AS answer_start, CASE WHEN lang = 'en' THEN length(substr(text, 1, 5)) END::BIGINT AS answer_end FROM documents"""

BLANK, REDACTION = r"_{5,}|\[●\]|\[Name", r"(?i)\[\*\*\*\]|\[\*\]|\*{3,}|\[REDACTED\]|\[Omitted\]"
RATES = f"""rates AS (SELECT *, len(regexp_extract_all(substr(text, 1, 3000), '{BLANK}'))::BIGINT AS blank_markers, len(regexp_extract_all(text, '{REDACTION}'))::BIGINT AS redactions,
1000.0::DOUBLE * len(regexp_extract_all(text, '{REDACTION}')) / greatest(length(text), 1) AS per_1000 FROM documents)"""
REDACTION_RATE = f"WITH {RATES} SELECT doc_id, blank_markers, redactions, {r6('per_1000')} AS per_1000 FROM rates"
EXCLUSION_CASCADE = f"""WITH {RATES} SELECT doc_id, CASE WHEN length(text) < 500 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long'
WHEN contains(lower(substr(text, 1, 500)), 'amend') AND NOT contains(lower(substr(text, 1, 500)), 'amended and restated') THEN 'amendment'
WHEN blank_markers >= 3 THEN 'form_or_template' WHEN per_1000 > 1 THEN 'redacted' END AS reason FROM rates"""

FUZZY_PREFIX_MATCH = """WITH p AS (SELECT p_partkey, lower(p_name) AS name FROM part),
t AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN substr(name, 1, 10) ELSE name END AS title FROM p WHERE p_partkey % 2 = 0),
e AS (SELECT p_partkey, title FROM p JOIN t ON name = title),
r AS (SELECT p_partkey, count(*) AS n, min(title) AS title FROM p JOIN t ON starts_with(name, title) OR starts_with(title, name) WHERE p_partkey NOT IN (SELECT p_partkey FROM e) GROUP BY 1)
SELECT p_partkey, title, 'exact' AS how FROM e UNION ALL SELECT p_partkey, title, 'prefix' FROM r WHERE n = 1"""

PHRASE_CLASSIFY = """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (
  SELECT doc_id, list_distinct(list_filter([CASE WHEN contains(t, 'apache license') THEN 'Software' END, CASE WHEN contains(t, 'hosting services agreement') THEN 'Hosting' END,
    CASE WHEN contains(t, 'license') AND NOT contains(t, 'apache license') THEN 'License' END,
    CASE WHEN contains(t, 'services agreement') AND NOT contains(t, 'hosting services agreement') THEN 'Service' END,
    CASE WHEN contains(t, 'the') THEN 'Common' END], lambda x: x IS NOT NULL)) AS a FROM d)
SELECT doc_id, CASE WHEN len(a) = 1 THEN a[1] END AS type, CASE len(a) WHEN 1 THEN 'one' WHEN 0 THEN 'none' ELSE 'ambiguous' END AS type_status FROM h"""

GRID_CROSS = """WITH l AS (SELECT lang, count(*) AS segments, count(DISTINCT text) AS texts FROM documents GROUP BY 1)
SELECT lang, segments, texts, n AS ngram_max, c::DOUBLE AS c, w AS weighting, concat_ws('-', lang, n::VARCHAR, printf('%.1f', c::DOUBLE), w) AS config_id, round(1 / (c::DOUBLE * segments), 9) AS penalty
FROM l, (VALUES (1::BIGINT), (2::BIGINT)) a(n), (VALUES (0.1), (1.0), (10.0)) b(c), (VALUES ('none'), ('balanced')) e(w)"""

KV_MISSING_CALLS = """SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn - 1 = c.turn)"""

ALIGNED_PAIR_AUDIT = f"""WITH {long()}, b AS (SELECT segment_id, label, y FROM long WHERE segment_id % 97 <> 0)
SELECT count_if(b.y IS NULL)::BIGINT AS only_a, count_if(a.y IS NULL)::BIGINT AS only_b, count_if(a.y <> b.y)::BIGINT AS different, count(*) AS n FROM long a FULL JOIN b USING (segment_id, label)"""

FULL_OUTER_KINDS = f"""WITH {tuned()}, {tuned("other", "other")}, a AS (SELECT DISTINCT contract_id, label, 1 AS x FROM tuned WHERE split = 'test' AND pred), b AS (SELECT DISTINCT contract_id, label, 1 AS x FROM other WHERE split = 'test' AND pred)
SELECT label, CASE WHEN b.x IS NULL THEN 'a' WHEN a.x IS NULL THEN 'b' ELSE 'both' END AS kind, count(*) AS n FROM a FULL JOIN b USING (contract_id, label) GROUP BY ALL"""

PER_LABEL_PRF = f"""WITH {tuned()}, t AS (SELECT * FROM tuned WHERE split = 'test'), c AS (SELECT label, {COUNTS} FROM t GROUP BY label), {ap("t", "label", "aps")}
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {r6("coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)")} AS precision, {r6("coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)")} AS recall,
{r6(F1)} AS f1, (tp + fn)::BIGINT AS support, (tp + fp)::BIGINT AS predicted, {r6("ap")} AS ap FROM c LEFT JOIN aps USING (label)"""

MICRO_MACRO_SUMMARY = f"""WITH {tuned()}, c AS (SELECT split, label, {COUNTS} FROM tuned GROUP BY ALL)
SELECT split, {r6(f"avg({F1})")} AS macro_f1, {r6("coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0)")} AS micro_f1,
{r6("coalesce(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp), 0), 0)")} AS micro_precision, {r6("coalesce(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0), 0)")} AS micro_recall FROM c WHERE tp + fn > 0 GROUP BY split"""

NONE_FP_RATE = f"""WITH {tuned()}, s AS (SELECT split, segment_id, bool_or(y) AS a, bool_or(pred) AS b FROM tuned GROUP BY ALL)
SELECT split, count(*) AS segments, count_if(NOT a)::BIGINT AS none, count_if(NOT a AND b)::BIGINT AS none_fp, {r6("count_if(NOT a AND b)::DOUBLE / nullif(count_if(NOT a), 0)")} AS rate FROM s GROUP BY split"""

AVERAGE_PRECISION = f"WITH {long()}, {ap('long', 'split, label', 'aps')} SELECT split, label, {r6('ap')} AS ap FROM aps"

THRESHOLD_TUNING = f"WITH {tuned()} SELECT label, {r6('threshold')} AS threshold, {r6('best_f1')} AS best_f1 FROM thr_tuned"

POOLED_THRESHOLD = f"""WITH {long()}, v AS (SELECT CASE WHEN label IN ('buy', 'hot') THEN 'pool' ELSE label END AS g, y, p FROM long WHERE split = 'val'), {grid("v", "g")},
b AS (SELECT g, t, f1 FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, abs(i - 50), i) AS r FROM (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(tp + fp + positives, 0), 0) AS f1 FROM grid)) WHERE r = 1)
SELECT label, {r6("t")} AS threshold, {r6("f1")} AS best_f1 FROM (SELECT DISTINCT label, CASE WHEN label IN ('buy', 'hot') THEN 'pool' ELSE label END AS g FROM long WHERE split = 'val') JOIN b USING (g)"""

HIGH_RECALL = f"""WITH {tuned()}, h AS (SELECT label, coalesce(max(t) FILTER (WHERE tp::DOUBLE / nullif(positives, 0) >= 0.9::DOUBLE), 0.01) AS t90, max(positives) AS positives FROM grid_tuned GROUP BY label),
c AS (SELECT label, threshold AS rule_b, t90, CASE WHEN positives = 0 THEN threshold ELSE least(threshold, t90) END AS threshold FROM h JOIN thr_tuned USING (label))
SELECT c.label, {r6("rule_b")} AS rule_b, {r6("t90")} AS t90, {r6("threshold")} AS threshold, {r6("tp::DOUBLE / nullif(g.positives, 0)")} AS recall FROM c LEFT JOIN grid_tuned g ON g.label = c.label AND g.t = c.threshold"""

NEAR_BEST = f"""WITH {long()}, v AS (SELECT * FROM long WHERE split = 'val' AND label = 'pricey'), {grid("v", "label")},
s AS (SELECT i, t, round(2.0::DOUBLE * tp / nullif(tp + fp + positives, 0), 9) AS f1, round(tp::DOUBLE / nullif(positives, 0), 9) AS recall FROM grid)
SELECT i::INT AS i, {r6("t")} AS t, {r6("f1")} AS f1, {r6("recall")} AS recall FROM s WHERE f1 >= (SELECT max(f1) FROM s) - 0.005::DOUBLE ORDER BY s.recall DESC, i LIMIT 1"""

BINS = "least(floor(p * 10), 9)::BIGINT"
CALIBRATION_BINS = f"""WITH {long()}, b AS (SELECT {BINS} AS bin, count(*) AS n, sum(p) AS sp, count_if(y) AS sy FROM long WHERE split = 'test' GROUP BY 1)
SELECT i AS bin, coalesce(n, 0) AS n, {r6("sp / n")} AS mean_p, {r6("sy::DOUBLE / n")} AS rate FROM (SELECT unnest(range(10)) AS i) LEFT JOIN b ON i = bin"""

CALIBRATION_PER_LABEL = f"""WITH {long()}, b AS (SELECT label, {BINS} AS bin, count(*) AS n, sum(p) AS sp, count_if(y) AS sy FROM long GROUP BY ALL),
m AS (SELECT label, avg(p) AS mp, avg(y::INT) AS my FROM long GROUP BY label)
SELECT label, {r6("sum(abs(sy - sp)) / sum(n)")} AS ece, {r6("any_value(mp)")} AS mean_p, {r6("any_value(my)")} AS mean_y FROM b JOIN m USING (label) GROUP BY label"""

MISSED_LABELS = f"""WITH {tuned()}, t AS (SELECT * FROM tuned WHERE split = 'test'), s AS (SELECT segment_id, bool_or(pred) AS a FROM t GROUP BY 1)
SELECT label, count(*) AS missed, count_if(NOT a)::BIGINT AS missed_without_prediction FROM t JOIN s USING (segment_id) WHERE y AND NOT pred GROUP BY label"""

CONFUSION_PAIRS = f"""WITH {tuned()} SELECT a.label AS true_label, b.label AS predicted_label, count(*) AS n FROM tuned a JOIN tuned b USING (segment_id) WHERE a.y AND b.pred AND NOT b.y GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 15"""

ERROR_SAMPLES = f"""WITH {tuned()}, e AS (SELECT label, CASE WHEN y THEN 'fn' ELSE 'fp' END AS kind, segment_id FROM tuned WHERE split = 'test' AND y <> pred)
SELECT label, kind, segment_id FROM e QUALIFY row_number() OVER (PARTITION BY label, kind ORDER BY {draw("errors", "label", "kind", "segment_id")}, segment_id) <= 5"""

CLASS_WEIGHTS = f"WITH {long()} SELECT label, {r6('sqrt((count(*) - count_if(y))::DOUBLE / nullif(count_if(y), 0))')} AS weight FROM long GROUP BY label"

STRATIFIED_SPLIT = f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {draw("split", "source", "doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT DISTINCT source, n, floor(n * 0.6 + 0.5)::BIGINT AS tr FROM r), o AS (SELECT *, (n - tr) % 2 AS odd FROM s), v AS (SELECT *, (n - tr) // 2 + CASE WHEN odd = 1 AND sum(odd) OVER (ORDER BY source) % 2 = 1 THEN 1 ELSE 0 END AS va FROM o)
SELECT doc_id, source, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM r JOIN v USING (source)"""

NEGATIVE_DOWNSAMPLE = f"""WITH {long()}, v AS (SELECT segment_id, y FROM long WHERE split = 'val' AND label = 'pricey'), n AS (SELECT segment_id, y, row_number() OVER (ORDER BY {draw("down", "segment_id")}, segment_id) AS r FROM v WHERE NOT y)
SELECT segment_id, y FROM v WHERE y UNION ALL SELECT segment_id, y FROM n WHERE r <= (SELECT floor(count_if(y) * 0.5) FROM v)"""

ROUND_ROBIN = f"""WITH u AS (SELECT user_id, user_id % 4 AS ctype, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ctype ORDER BY {draw("robin", "ctype", "user_id")}, user_id) AS r FROM u),
s AS (SELECT *, row_number() OVER w AS turn, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum((r = 1)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM r WINDOW w AS (ORDER BY r, ctype))
SELECT user_id, ctype, turn FROM s WHERE before < 1500 OR seen < (SELECT count(DISTINCT ctype) FROM u)"""

QUOTA_ALLOCATION = """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT *, 37 * n::DOUBLE / sum(n) OVER () AS q FROM c), f AS (SELECT *, floor(q) AS f, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, n DESC, lang) AS i FROM q)
SELECT lang, n, (f + CASE WHEN i <= 37 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS slots FROM f"""

HALF_SAMPLE = f"""WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY {draw("half", "user_id")}, user_id) AS r, count(*) OVER () AS n FROM u) SELECT user_id FROM r WHERE r <= ceil(n / 2)"""

CONTEXT_WINDOWS = """WITH r AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS w FROM conversations)
SELECT conv_id, w AS window, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM r GROUP BY conv_id, w"""


def weights(contracts: str, key: str, stratum: str, n: int, stream: str, name: str = "w") -> str:
    return f"""
pl_{name} AS (SELECT {key}, {stratum} AS s, row_number() OVER (PARTITION BY {stratum} ORDER BY {key}) - 1 AS i, count(*) OVER (PARTITION BY {stratum}) AS n FROM {contracts}),
{name} AS (SELECT b AS resample, {key}, count(*) AS w FROM (SELECT b, x.s, {draw(stream, "b", "x.s", "x.i")} % x.n AS pick FROM pl_{name} x CROSS JOIN (SELECT unnest(range({n})) AS b)) d
  JOIN pl_{name} p ON p.s = d.s AND p.i = d.pick GROUP BY ALL)"""


BOOTSTRAP_WEIGHTS = f"WITH {long()}, c AS (SELECT DISTINCT contract_id, ctype FROM long), {weights('c', 'contract_id', 'ctype', 50, 'test')} SELECT resample, contract_id, w FROM w"


def boot(stream: str, split: str, stratum: str = "ctype", score: str = "score", name: str = "b") -> str:
    return f"""{tuned(score, f"tuned_{name}")}, r{name} AS (SELECT * FROM tuned_{name} WHERE split = '{split}'), k{name} AS (SELECT DISTINCT contract_id, ctype FROM r{name}), {weights(f"k{name}", "contract_id", stratum, 200, stream, f"w{name}")},
c{name} AS (SELECT contract_id, label, {COUNTS} FROM r{name} GROUP BY ALL),
s{name} AS (SELECT resample, label, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn FROM c{name} JOIN w{name} USING (contract_id) GROUP BY ALL),
{name} AS (SELECT resample, avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) AS macro_f1, 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1 FROM s{name} WHERE tp + fn > 0 GROUP BY resample)"""


def interval(rows: str, a: float, more: str = "") -> str:
    one = lambda m: f"SELECT '{m}' AS metric, quantile_cont({m}, {a!r}::DOUBLE) AS low, quantile_cont({m}, {1 - a!r}::DOUBLE) AS high, count({m}) AS n FROM {rows}"
    return f"SELECT metric, {r6('low')} AS low, {r6('high')} AS high, n{more} FROM ({one('macro_f1')} UNION ALL {one('micro_f1')})"


BOOTSTRAP_F1_CI = f"WITH {boot('test', 'test')} {interval('b', 0.025)}"
BOOTSTRAP_UNSTRATIFIED = f"WITH {boot('fresh', 'test', '0')} {interval('b', 0.025)}"
PAIRED_COMPARISON = f"""WITH {boot("test", "test")}, {boot("test", "test", score="other", name="o")}, d AS (SELECT b.macro_f1 - o.macro_f1 AS macro_f1, b.micro_f1 - o.micro_f1 AS micro_f1 FROM b JOIN o USING (resample))
{interval("d", 0.05 / 12 / 2, ", CASE WHEN low > 0 THEN 'A' WHEN high < 0 THEN 'B' ELSE 'none' END AS claim")}"""
TEST_MINUS_SHIFT = f"""WITH {boot("test", "test")}, {boot("shift", "shift", name="o")}, d AS (SELECT b.macro_f1 - o.macro_f1 AS macro_f1, b.micro_f1 - o.micro_f1 AS micro_f1 FROM b JOIN o USING (resample)) {interval("d", 0.025)}"""
ECE_BOOTSTRAP = f"""WITH {long()}, t AS (SELECT * FROM long WHERE split = 'test'), c AS (SELECT DISTINCT contract_id, ctype FROM t), {weights("c", "contract_id", "ctype", 100, "test")},
b AS (SELECT contract_id, {BINS} AS bin, count(*) AS n, sum(p) AS sp, count_if(y) AS sy FROM t GROUP BY ALL), s AS (SELECT resample, bin, sum(w * n) AS n, sum(w * sp) AS sp, sum(w * sy) AS sy FROM b JOIN w USING (contract_id) GROUP BY ALL),
e AS (SELECT resample, sum(abs(sy - sp)) / sum(n) AS ece FROM s GROUP BY 1) SELECT 'ece' AS metric, {r6("quantile_cont(ece, 0.025)")} AS low, {r6("quantile_cont(ece, 0.975)")} AS high, count(ece) AS n FROM e"""

SPANS = """spans AS (SELECT event_id, user_id, event_type, s AS start, s + ceil(value)::BIGINT AS "end" FROM (SELECT *, epoch_us(ts) // 60000000 - 28401120 AS s FROM events))"""
UNION_ = """u AS (SELECT user_id, event_type, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN max("end") OVER (PARTITION BY user_id, event_type ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS n FROM spans)) GROUP BY user_id, event_type, g)"""
INTERVAL_UNION = f'WITH {SPANS}, {UNION_} SELECT user_id, event_type, start, "end" FROM u'
INTERVAL_OVERLAP_JOIN = f"""WITH {SPANS}, {UNION_}, g AS (SELECT user_id, i * 720 AS g_start, i * 720 + 720 AS g_end FROM (SELECT user_id, unnest(range(min(start) // 720, (max("end") - 1) // 720 + 1)) AS i FROM u GROUP BY user_id)),
p AS (SELECT u.user_id, g_start, event_type, least("end", g_end) - greatest(start, g_start) AS o, "end" - start AS n FROM u JOIN g ON u.user_id = g.user_id AND start < g_end AND g_start < "end"),
c AS (SELECT user_id, g_start, event_type, max(o::DOUBLE / n) AS a, sum(o)::DOUBLE / 720 AS b FROM p GROUP BY ALL)
SELECT user_id, g_start, event_type, {r6("a")} AS of_span, {r6("b")} AS of_segment FROM c WHERE a >= 0.5 OR b >= 0.5"""
CROSS_CATEGORY = f"""WITH {SPANS}, {UNION_} SELECT a.event_type AS cat_a, b.event_type AS cat_b, count(*) AS n FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type < b.event_type AND a.start < b."end" AND b.start < a."end" GROUP BY ALL"""
SAME_CATEGORY = f"""WITH {SPANS} SELECT event_type, count_if(o)::BIGINT AS n FROM (SELECT event_type, coalesce(lead(start) OVER (PARTITION BY user_id, event_type ORDER BY start, "end", event_id) < "end", false) AS o FROM spans) GROUP BY event_type"""
BIN_LOOKUP = "SELECT ((value >= 1)::INT + (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT + (value >= 250)::INT)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1"
PAGE_OFFSETS = "SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations"

LINE_TABLE = r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, i - 1 AS n, l[i] AS raw FROM s, unnest(range(1, len(l) + 1)) AS x(i)),
o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, regexp_replace(raw, '^[\s\x{00a0}]+', '') AS lt FROM e),
t AS (SELECT doc_id, n, (b + length(raw) - length(lt))::BIGINT AS start, regexp_replace(lt, '[\s\x{00a0}]+$', '') AS line FROM o), k AS (SELECT * FROM t WHERE length(line) > 0)
SELECT doc_id, (row_number() OVER w - 1)::INT AS line_no, start, start + length(line) AS "end", line, n - coalesce(lag(n) OVER w, 0) >= 2 AS blank_before FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)"""

CHARSET_DECODE = "SELECT page_id, sha256(html) AS sha, (octet_length(encode(html)) + 1)::BIGINT AS n_odd, 'é' AS last FROM pages"

TOKENS = r"regexp_extract_all(regexp_replace(lower(text), '\*{3,}|_{5,}', ' redactedtoken ', 'g'), '([\p{L}\p{N}_]{2,})', 1)"
VOCAB = f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) >= 2"
TFIDF = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
s AS (SELECT doc_id, term, round(w / n, 6) AS weight FROM w JOIN n USING (doc_id))
SELECT * FROM (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM s) WHERE rank <= 3"""
OOV_RATE = f"""WITH t AS (SELECT lang, doc_id, unnest({TOKENS}) AS term FROM documents), v AS (SELECT term, true AS known FROM t WHERE lang = 'en' GROUP BY term HAVING count(DISTINCT doc_id) >= 2)
SELECT lang, count(*) AS tokens, {r6("count_if(known IS NULL)::DOUBLE / count(*)")} AS oov FROM t LEFT JOIN v USING (term) GROUP BY lang"""

NEAREST = """WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(array_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour) = 1"""

WORDS = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)"
WORD_OVERLAP = f"""WITH a AS (SELECT id, w, count(*) AS n FROM (SELECT doc_id AS id, unnest({WORDS}) AS w FROM documents) GROUP BY ALL), b AS (SELECT id, w, count(*) AS m FROM (SELECT item_id AS id, unnest({WORDS}) AS w FROM benchmark) GROUP BY ALL)
SELECT id, sum(least(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS common, coalesce(sum(n), 0)::BIGINT AS "left", sum(m)::BIGINT AS "right" FROM a FULL JOIN b USING (id, w) GROUP BY id HAVING coalesce(sum(m), 0) > 0"""
SHINGLES = """sh_{t} AS (SELECT DISTINCT {k}, array_to_string(w[i:i + 7], ' ') AS h FROM (SELECT {k}, {w} AS w FROM {t}), unnest(range(1, len(w) - 6)) AS x(i))"""
CONTAINED = f"""WITH {SHINGLES.format(t="documents", k="doc_id", w=WORDS)}, {SHINGLES.format(t="benchmark", k="item_id", w=WORDS)},
na AS (SELECT doc_id, count(*) AS na FROM sh_documents GROUP BY 1), nb AS (SELECT item_id, count(*) AS nb FROM sh_benchmark GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS common FROM sh_documents JOIN sh_benchmark USING (h) GROUP BY ALL),
s AS (SELECT doc_id, item_id, common, greatest(common::DOUBLE / na, common::DOUBLE / nb) AS containment FROM c JOIN na USING (doc_id) JOIN nb USING (item_id))"""
SHINGLE_CONTAINMENT = f"{CONTAINED} SELECT doc_id, item_id, common, {r6('containment')} AS containment FROM s"
MAX_CONTAINMENT = f"{CONTAINED} SELECT d.doc_id, {r6('coalesce(max(containment), 0)')} AS containment FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"

LONGEST_SENTENCES = r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.;:!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS l FROM documents), e AS (SELECT doc_id, i, l[i] AS sentence FROM s, unnest(range(1, len(l) + 1)) AS x(i)),
c AS (SELECT *, len(regexp_extract_all(sentence, '[A-Za-z0-9]+'))::BIGINT AS n_words FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, i) AS rank FROM c WHERE n_words BETWEEN 15 AND 40)
SELECT doc_id, rank, n_words, sentence FROM r WHERE rank <= 3"""

MONTH_WINDOWS = """WITH s AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders), m AS (SELECT a, z, unnest(generate_series(date_trunc('month', a), z::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM s)
SELECT greatest(a, m)::VARCHAR AS start, least(z, last_day(m))::VARCHAR AS "end" FROM m"""

TITLE_KEYS = """SELECT p_partkey, lower(rtrim(regexp_replace(trim(p_name), '-+$', ''))) AS key, substr(sha256('{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}'), 1, 16) AS request FROM part"""


def two_sides(bin_: str) -> str:
    return f"""h AS (SELECT {bin_} AS bin, count_if(day(ts) > 15)::DOUBLE AS b, count_if(day(ts) <= 15)::DOUBLE AS r FROM events GROUP BY 1), s AS (SELECT sum(b) AS tb, sum(r) AS tr FROM h)"""


PSI = f"""WITH {two_sides("(value >= 5)::INT + (value >= 20)::INT + (value >= 60)::INT + (value >= 150)::INT")}, f AS (SELECT coalesce(b, 0) AS b, coalesce(r, 0) AS r FROM (SELECT unnest(range(5)) AS i) LEFT JOIN h ON i = bin),
n AS (SELECT (b + 1e-4) / (tb + 5e-4) AS p, (r + 1e-4) / (tr + 5e-4) AS q FROM f, s) SELECT {r6("sum((p - q) * ln(p / q))")} AS psi FROM n"""
JS_DISTANCE = f"""WITH {two_sides("event_type")}, n AS (SELECT b / tb AS p, r / tr AS q FROM h, s)
SELECT {r6("sqrt(greatest((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0))")} AS js FROM n"""
CENTROID_COSINE = f"""WITH e AS (SELECT label % 2 AS side, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS u(i)), s AS (SELECT i, coalesce(sum(x) FILTER (WHERE side = 1), 0) AS b, coalesce(sum(x) FILTER (WHERE side = 0), 0) AS r FROM e GROUP BY i)
SELECT {r6("1 - sum(b * r) / nullif(sqrt(sum(b * b) * sum(r * r)), 0)")} AS cosine_distance FROM s"""
SHARE_DIFF = f"""WITH s AS (SELECT avg((event_type = 'purchase')::INT) FILTER (WHERE day(ts) > 15) - avg((event_type = 'purchase')::INT) FILTER (WHERE day(ts) <= 15) AS x FROM events) SELECT {r6("x")} AS diff, {r6("abs(x)")} AS abs_diff FROM s"""
SPEARMAN = f"""WITH o AS (SELECT round(o_totalprice, -3) AS x, dayofyear(o_orderdate) AS y FROM orders), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM o) SELECT {r6("corr(a, b)")} AS spearman FROM r"""

BATCHES = f"""m AS (SELECT user_id, count(*) AS n, count(*) % 3 AS times, count_if(value > 250) AS high FROM events GROUP BY 1), c AS (SELECT user_id, unnest(range(1, times + 1)) AS copy FROM m WHERE times > 0),
x AS (SELECT b AS batch, user_id, row_number() OVER (PARTITION BY b ORDER BY {draw("batch", "b", "user_id", "copy")}, user_id, copy) AS r FROM c CROSS JOIN (SELECT unnest(range(20)) AS b)), bw AS (SELECT batch, user_id, count(*) AS w FROM x WHERE r <= 5 GROUP BY ALL)"""
BATCH_DRAWS = f"WITH {BATCHES} SELECT batch::INT AS batch, user_id, w FROM bw"
LEAVE_BATCH_OUT = f"""WITH {BATCHES}, s AS (SELECT batch, sum(w * n)::BIGINT AS b_n, sum(w * high)::BIGINT AS b_high FROM bw JOIN m USING (user_id) GROUP BY 1)
SELECT batch::INT AS batch, b_n, b_high, ((SELECT sum(n) FROM m) - b_n)::BIGINT AS r_n, ((SELECT sum(high) FROM m) - b_high)::BIGINT AS r_high FROM s"""

USERS = "us AS (SELECT user_id, round(avg(value), 1) AS v FROM events GROUP BY 1)"
NULL_PVALUES = f"""WITH {USERS} SELECT user_id, {r6("v")} AS v, {r6("(1 + (SELECT count(*) FROM us n WHERE n.user_id % 2 = 0 AND n.v >= u.v))::DOUBLE / (1 + (SELECT count(*) FROM us WHERE user_id % 2 = 0))")} AS p FROM us u WHERE user_id % 2 = 1"""
TIE_SAFE = f"""WITH {USERS}, p AS (SELECT round((SELECT count(*) FROM us n WHERE n.v >= u.v)::DOUBLE / (SELECT count(*) FROM us), 9) AS p FROM us u), s AS (SELECT p, cume_dist() OVER (ORDER BY p) AS c FROM p),
t AS (SELECT max(p) AS t, max(c) AS c FROM s WHERE c <= 0.1) SELECT {r6("t.t")} AS threshold, {r6("t.c")} AS null_share, {r6("(SELECT avg((p.p <= t.t)::INT) FROM p)")} AS alarm_rate FROM t"""

KAPPA = f"""WITH l AS (SELECT quality AS x, CASE WHEN {draw("rater", "doc_id")} % 10 < 8 THEN quality ELSE 1 - quality END AS y FROM labels), m AS (SELECT count(*) AS n, avg((x = y)::INT) AS po, avg(x) AS a, avg(y) AS b FROM l)
SELECT n, {r6("po")} AS agreement, {r6("(po - (a * b + (1 - a) * (1 - b))) / nullif(1 - (a * b + (1 - a) * (1 - b)), 0)")} AS kappa FROM m"""

USAGE_COSTS = f"""WITH e AS (SELECT event_type, json_extract_string(props, '$.k')::DOUBLE AS k, value FROM events)
SELECT event_type, count(*) AS calls, {r6("sum(k)")} AS cost, {r6("1000 * sum(k) / (10 * count(*))")} AS cost_per_1000, {r6("quantile_cont(value, 0.5)")} AS latency_median, {r6("quantile_cont(value, 0.95)")} AS latency_p95 FROM e GROUP BY event_type"""
COST_PROJECTION = f"""WITH {long()}, c AS (SELECT contract_id, sum(k) AS cost FROM seg_long WHERE part = 0 GROUP BY 1), a AS (SELECT avg(cost) AS per_call FROM c), m AS (SELECT count(DISTINCT contract_id) AS missing FROM seg_long WHERE part <> 0)
SELECT {r6("per_call")} AS per_call, missing, {r6("per_call * missing")} AS projected FROM a, m"""
MERGED_ATTEMPTS = f"WITH {long()} SELECT contract_id, event_type, max_by(k, segment_id) FILTER (WHERE k < 90) AS k, count(*) AS attempts FROM seg_long GROUP BY contract_id, event_type"
RUN_HEALTH = f"""WITH {long()}, s AS (SELECT split, segment_id, count_if(p >= 0.3::DOUBLE) AS n, bool_or(p >= 0.3::DOUBLE AND p < 0.35::DOUBLE) AS low FROM long GROUP BY ALL)
SELECT split, {r6("avg((n = 0)::INT)")} AS empty_share, {r6("avg(n)")} AS mean_labels, {r6("avg(low::INT)")} AS low_share FROM s GROUP BY split"""
RUNS = ", ".join(long(f"run{i}", f"l{i}") for i in (1, 2, 3))
REPEATABILITY = f"""WITH {RUNS}, r AS ({" UNION ALL ".join(f"SELECT 'run{i}' AS run, segment_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE p >= 0.5::DOUBLE), '') AS s FROM l{i} GROUP BY segment_id" for i in (1, 2, 3))})
SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, {r6("avg((a.s = b.s)::INT)")} AS exact, {r6("avg(((a.s = '') <> (b.s = ''))::INT)")} AS flips FROM r a JOIN r b USING (segment_id) WHERE a.run < b.run GROUP BY ALL"""
SCORE_PERCENTILE = f"""WITH {USERS} SELECT user_id, {r6("100 * (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / count(*) OVER ()")} AS percentile FROM us"""
IQR_EXAMPLE = f"""WITH q AS (SELECT lang, quantile_cont(length(text)::DOUBLE, 0.25) AS q1, quantile_cont(length(text)::DOUBLE, 0.75) AS q3 FROM documents GROUP BY lang)
SELECT lang, doc_id, q1, q3 FROM documents JOIN q USING (lang) WHERE length(text) BETWEEN q1 AND q3 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {draw("guide", "lang", "doc_id")}, doc_id) = 1"""
DQ_VIOLATIONS = """SELECT 'n_chars differs' AS "check", (SELECT count(*) FROM documents WHERE length(text) <> n_chars) AS n
UNION ALL SELECT 'doc_id repeats', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'event without props', (SELECT count(*) FROM events WHERE json_extract_string(props, '$.k') IS NULL)
UNION ALL SELECT 'label without document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'same text', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1))"""
FLAG_EXPORT = f"WITH {tuned()} SELECT segment_id, label AS flag FROM tuned WHERE split = 'test' AND pred UNION ALL SELECT DISTINCT segment_id, 'NOT CLASSIFIED' FROM tuned WHERE split = 'shift'"
MARKDOWN_REPORT = f"""WITH {tuned()}, c AS (SELECT label, {COUNTS} FROM tuned WHERE split = 'test' GROUP BY label)
SELECT '| label | support | f1 |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || label || ' | ' || (tp + fn)::BIGINT || ' | ' || printf('%.4f', {F1}) || ' |', chr(10) ORDER BY label) AS md FROM c"""

LINEITEM_PIVOT = f"""SELECT l_returnflag, {r6("sum(l_extendedprice * (1 - l_discount)) FILTER (WHERE l_linestatus = 'F')")} AS "F", {r6("sum(l_extendedprice * (1 - l_discount)) FILTER (WHERE l_linestatus = 'O')")} AS "O" FROM lineitem GROUP BY l_returnflag"""
LINEITEM_BOOTSTRAP = f"""WITH li AS (SELECT l_orderkey, count_if(l_discount > 0.05::DOUBLE) AS hits, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT l_orderkey, o_orderpriority FROM li JOIN orders ON o_orderkey = l_orderkey), {weights("k", "l_orderkey", "o_orderpriority", 20, "scale")},
s AS (SELECT resample, sum(w * hits)::DOUBLE / sum(w * n) AS share FROM w JOIN li USING (l_orderkey) GROUP BY 1) SELECT 'share' AS metric, {r6("quantile_cont(share, 0.025)")} AS low, {r6("quantile_cont(share, 0.975)")} AS high, count(share) AS n FROM s"""
