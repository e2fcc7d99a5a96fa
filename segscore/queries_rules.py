"""Queries of rules on exports, offsets, errors, budgets and listings, with SQL written from the rules' text."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracles as O
from .functions import text as T
from .functions.hashing import draw
from .operators import calllog as L
from .operators import checks as K
from .plans import world as P
from .queries import query
from .sources import listing
from .sources.written import folder

# ---- offsets


@query("""WITH d AS (SELECT doc_id, replace(text, '.', '😀') AS t FROM documents), o AS (SELECT doc_id, t, length(t) AS n, unnest(range(0, 11)) AS i FROM d), p AS (SELECT doc_id, i, t, n * i // 10 AS pos FROM o)
SELECT doc_id, i, pos::BIGINT AS pos, (pos + len(regexp_extract_all(substring(t, 1, pos), '😀')))::BIGINT AS units, pos::BIGINT AS back FROM p""")
def utf16_offsets(spark, d):
    """Ten offsets of every document, whose full stops become characters of two units, as a browser counts them, and back."""
    t = F.replace(F.col("text"), F.lit("."), F.lit("😀"))
    rows = P.table(spark, d, "documents").select("doc_id", t.alias("t"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.floor(F.length(t) * i / 10))).alias("i", "pos"))
    rows = rows.withColumn("units", T.utf16_offset(F.col("t"), F.col("pos")))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.col("pos").cast("long").alias("pos"), "units", T.code_point_offset(F.col("t"), F.col("units")).alias("back"))


# ---- label exports

CATEGORIES = ["Licence", "Rights", "Term"]
FAULTS = ["", "hash", "missing", "unknown", "state", "category", "type", "range", "disagrees", "json"]


def exports(spark, d):
    """(exports, texts): an export per document, one fault in each by its number's last digit."""
    docs = P.table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 10).alias("k"))
    sha = F.sha2(F.encode(F.when(F.col("k") == 1, F.lit("other")).otherwise(F.col("text")), "UTF-8"), 256)
    category = F.when(F.col("k") == 5, "Nobody").otherwise("Licence")
    n = F.length("text")
    start = F.when(F.col("k") == 6, '"0"').otherwise("0")
    end = F.when(F.col("k") == 7, (n + 1).cast("string")).otherwise(n.cast("string"))
    state = F.when(F.col("k") == 8, "not present").when(F.col("k") == 4, "perhaps").when(F.col("k") == 5, "not present").otherwise("marked")
    rest = F.when(F.col("k") == 2, "").otherwise(', "Rights": "not present"')
    more = F.when(F.col("k") == 3, ', "Other": "not present"').otherwise("")
    body = F.concat(F.lit('{"text_sha256": "'), sha, F.lit('", "checklist": {"Licence": "'), state, F.lit('"'), rest, F.lit(', "Term": "not present"'), more, F.lit('}, "spans": [{"category": "'), category, F.lit('", "start": '), start, F.lit(', "end": '), end, F.lit("}]}"))
    return docs.select("doc_id", F.when(F.col("k") == 9, F.lit("[1]")).otherwise(body).alias("export")), docs.select("doc_id", "text")


@query("""SELECT doc_id, r AS rule, p AS path FROM documents JOIN (VALUES (1, 'text', 'text_sha256'), (2, 'missing', 'checklist.Rights'), (3, 'unknown', 'checklist.Other'), (4, 'state', 'checklist.Licence'), (4, 'disagrees', 'checklist.Licence'),
(5, 'category', 'spans.0'), (6, 'type', 'spans.0'), (7, 'range', 'spans.0'), (8, 'disagrees', 'checklist.Licence'), (9, 'json', '')) AS v(k, r, p) ON doc_id % 10 = k""")
def export_violations(spark, d):
    """Every rule on label exports, broken by one document in ten each."""
    rows, texts = exports(spark, d)
    return K.export_violations(rows, texts, "doc_id", CATEGORIES)


# ---- errors, budgets, costs, gates

MESSAGES = ["HTTPStatusError: Client error '401 Unauthorized' for url", "HTTPStatusError: Client error '404 Not Found' for url", "HTTPStatusError: Server error '503 Unavailable' for url", "HTTPStatusError: Client error '422 Bad' for url", "RuntimeError: gave up after 6 attempts: 429", "KeyError: 'segments'", "connection: ReadTimeout", "408 Request Timeout", "504 Gateway Timeout", "500 Internal", ""]
SQL_MESSAGES = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in MESSAGES) + "]"


@query(f"""WITH m AS (SELECT event_type, {SQL_MESSAGES}[event_id % {len(MESSAGES)} + 1] AS m FROM events), s AS (SELECT *, regexp_extract(m, '^HTTPStatusError: \\w+ error ''(\\d{{3}}) ', 1) AS status FROM m)
SELECT event_type, m AS message, regexp_matches(m, '^(connection:|408|504)') AS timeout, CASE WHEN starts_with(m, 'RuntimeError: gave up') THEN false WHEN status <> '' THEN status IN ('401', '402', '403', '404') ELSE NOT starts_with(m, 'HTTPStatusError') END AS setup, count(*) AS n FROM s GROUP BY ALL""")
def error_kinds(spark, d):
    """Which errors never reached the model, and which were waiting, per message."""
    told = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES)).cast("int"))
    rows = P.table(spark, d, "events").select("event_type", told.alias("message"))
    return rows.groupBy("event_type", "message", L.is_timeout(F.col("message")).alias("timeout"), L.is_setup_error(F.col("message")).alias("setup")).agg(F.count("*").alias("n"))


@query(f"""WITH u AS (SELECT o_custkey, sum(o_totalprice) / 10000 AS spent, count(*) * 6.0::DOUBLE AS pair, count(*) * 2.5::DOUBLE AS second, {O.draw("first", "o_custkey")} % 4 > 0 AS a, {O.draw("second", "o_custkey")} % 5 > 0 AS b FROM orders GROUP BY 1),
c AS (SELECT *, CASE WHEN NOT b THEN 'neither' WHEN a AND spent + pair <= 250 THEN 'both' WHEN spent + second <= 250 THEN 'second' ELSE 'neither' END AS choice FROM u)
SELECT o_custkey, choice, CASE choice WHEN 'both' THEN spent + pair > 150 WHEN 'second' THEN spent + second > 150 ELSE false END AS decide,
CASE WHEN choice = 'both' AND spent + pair > 150 THEN CASE WHEN spent + second <= 150 THEN 'second' ELSE 'second, decide' END WHEN choice = 'second' AND spent + second > 150 THEN 'neither' END AS fallback FROM c""")
def gate_choices(spark, d):
    """Which of two models a budget with a soft and a hard limit lets go on."""
    u = P.table(spark, d, "orders").groupBy("o_custkey").agg((F.sum("o_totalprice") / 10000).alias("spent"), (F.count("*") * 6.0).alias("pair"), (F.count("*") * 2.5).alias("second"))
    g = L.gate(F.col("spent"), F.col("pair"), F.col("second"), draw("first", "o_custkey") % 4 > 0, draw("second", "o_custkey") % 5 > 0, 150.0, 250.0)
    return u.select("o_custkey", g.alias("g")).select("o_custkey", "g.choice", "g.decide", "g.fallback")


@query("""SELECT event_id, round((((event_id % 5000) - (event_id % 5000) // 3) * 0.3::DOUBLE + (event_id % 5000) // 3 * 0.03::DOUBLE + user_id * 2.5::DOUBLE) / 1000000, 12) AS cost FROM events""")
def prompt_costs(spark, d):
    """Costs where cached tokens are part of the prompt's count."""
    prompt = F.col("event_id") % 5000
    cost = L.prompt_cost(prompt, F.floor(prompt / 3), F.col("user_id"), {"input": 0.3, "cached": 0.03, "output": 2.5})
    return P.table(spark, d, "events").select("event_id", F.round(cost, 12).alias("cost"))


@query(f"""WITH e AS (SELECT event_id::VARCHAR AS key, value, event_type, json_extract_string(props, '$.k')::BIGINT AS k, event_id FROM events)
SELECT NULL AS key, 'missing' AS reason, (SELECT count(*) FROM e WHERE event_id % 50 > 0) || ' of ' || (SELECT count(*) FROM e) AS detail
UNION ALL SELECT key, 'output', k::VARCHAR FROM e WHERE k > 90 UNION ALL SELECT key, 'latency', round(value)::BIGINT::VARCHAR FROM e WHERE value > 300
UNION ALL SELECT key, 'timeout', 'connection: reset' FROM e WHERE event_type = 'click' AND event_id % 7 = 0 UNION ALL SELECT key, 'unparsed', event_id || '_0' FROM e WHERE event_id % 40 = 0""")
def smoke_reasons(spark, d):
    """Why a first batch can't be passed: every record, attempt, timeout and segment at fault."""
    key = F.col("event_id").cast("string").alias("key")
    e = P.table(spark, d, "events")
    errors = F.when((F.col("event_type") == "click") & (F.col("event_id") % 7 == 0), F.array(F.lit("500 again"), F.lit("connection: reset"))).otherwise(F.array().cast("array<string>"))
    attempts = e.select(key, F.get_json_object("props", "$.k").cast("long").alias("output"), F.col("value").alias("latency_ms"), errors.alias("retry_errors"))
    failures = e.where("event_id % 40 = 0").select(key, F.concat(F.col("event_id").cast("string"), F.lit("_0")).alias("segment_id"))
    return L.smoke_reasons(e.select(key, (F.col("event_id") % 50 > 0).alias("done")), attempts, failures, 90, 300.0)


@query(f"""WITH s AS (SELECT CASE user_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'a' ELSE 'b' END AS model, {O.draw("x", "event_id")} % 1000 AS x, {O.draw("y", "event_id")} % 2000 AS y, event_id FROM events),
p AS (SELECT model, x >= 500 AS a, CASE WHEN y = 0 THEN x < 500 ELSE x >= 500 END AS b FROM s), t AS (SELECT model, count(*) AS pairs, count_if(a <> b)::BIGINT AS disagreements, count_if(a OR b)::BIGINT AS flagged FROM p GROUP BY 1),
f AS (SELECT model, count(*) AS failed FROM s WHERE model = 'b' AND event_id % 1000 = 0 GROUP BY 1)
SELECT model, pairs, disagreements, flagged, coalesce(failed, 0)::BIGINT AS failed, coalesce(failed, 0) = 0 AND CASE WHEN model = 'baseline' THEN disagreements = 0 ELSE disagreements <= 0.001 * pairs AND disagreements <= 0.01 * greatest(flagged, 1) END AS passed FROM t LEFT JOIN f USING (model)""")
def parity_verdicts(spark, d):
    """Served against expected flags: failed requests and the baseline's exactness included."""
    e = P.table(spark, d, "events")
    x, y = draw("x", "event_id") % 1000, draw("y", "event_id") % 2000
    rows = e.select("event_id", F.when(F.col("user_id") % 3 == 0, "baseline").when(F.col("user_id") % 3 == 1, "a").otherwise("b").alias("model"), x.alias("x"), F.when(y == 0, 999 - x).otherwise(x).alias("y"))
    totals = K.parity(rows, ["model"], "x", "y", 500).drop("max_diff")
    return K.parity_verdict(totals, "model", rows.where("model = 'b' and event_id % 1000 = 0").select("model"), ["baseline"])


# ---- a paged listing


@query("""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT printf('%010d', doc_id) AS accession, 'doc' || doc_id || '.htm' AS file_name, (doc_id % 7)::VARCHAR AS cik, 'EX-' || (doc_id % 3) AS file_type FROM h""")
def listed_hits(spark, d):
    """Documents as the hits of a search in pages that overlap, stored as JSON, and read as one table again."""
    return listing.hits(listing.read_pages(spark, stored_pages(spark, d)))


@query("""WITH t AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang AS query, n AS total, 'eq' AS relation, false AS truncated, (CASE WHEN n <= 50 THEN 1 ELSE 1 + ceil((n - 50) / 40.0) END)::BIGINT AS pages, n AS distinct_hits FROM t""")
def listing_completeness(spark, d):
    """Per search the hits it told, how many pages were stored, and whether all its hits are there."""
    return listing.report(listing.read_pages(spark, stored_pages(spark, d)), most=10_000_000)


def stored_pages(spark, d):
    """A page is fifty hits of a language's documents, of which ten stood on the page before."""
    docs = P.table(spark, d, "documents").select("doc_id", "lang")
    place = (F.row_number().over(W.partitionBy("lang").orderBy("doc_id")) - 1).alias("i")
    rows = docs.select("*", place, F.count("*").over(W.partitionBy("lang")).alias("n"))
    last = F.greatest(F.ceil((F.col("n") - 50) / 40), F.lit(0))
    mine = F.filter(F.sequence(F.greatest(F.floor((F.col("i") - 10) / 40), F.lit(0)), F.floor(F.col("i") / 40)), lambda p: (p * 40 <= F.col("i")) & (F.col("i") < p * 40 + 50) & (p <= last))
    source = F.struct(F.array((F.col("doc_id") % 7).cast("string")).alias("ciks"), F.concat(F.lit("EX-"), (F.col("doc_id") % 3).cast("string")).alias("file_type"))
    hit = F.struct(F.concat(F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(":doc"), F.col("doc_id").cast("string"), F.lit(".htm")).alias("_id"), source.alias("_source"))
    pages = rows.select("lang", "n", F.explode(mine).alias("page"), F.struct("i", hit.alias("h")).alias("h")).groupBy("lang", "n", "page").agg(F.transform(F.sort_array(F.collect_list("h")), lambda x: x["h"]).alias("hits"))
    told = pages.select(F.col("lang").alias("query"), (F.col("page") * 40).alias("offset"), F.struct(F.struct(F.col("n").alias("value"), F.lit("eq").alias("relation")).alias("total"), "hits").alias("hits"))
    path = f"{folder(spark)}/pages-{uuid.uuid4().hex}"
    told.write.json(path)
    return path
