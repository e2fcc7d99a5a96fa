"""Queries of whole studies: example retrieval, leave-batch-out drift, sequential draws, baseline models, call ledgers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import oracles as O
from .functions import text as T
from .functions.hashing import draw
from .operators import baseline as A
from .operators import bootstrap as B
from .operators import callrun as L
from .operators import curation as C
from .operators import driftstudy as Y
from .operators import framedraw as V
from .operators import metrics as M
from .operators import retrieval as R
from .plans import world as P
from .queries import query, r6
from .sources.written import written

# ---- retrieval of examples

#: Unit TF-IDF vectors of all documents, and the exact similarities of every target with every row.
SIMILAR = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({O.TOKENS}) AS term FROM documents) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
v AS (SELECT doc_id, term, w / n AS v FROM w JOIN n USING (doc_id)), g AS (SELECT doc_id AS target FROM v WHERE doc_id % 20 = 0 GROUP BY 1),
p AS (SELECT a.doc_id AS target, b.doc_id AS other, sum(a.v * b.v) AS s FROM v a JOIN v b ON a.term = b.term WHERE a.doc_id % 20 = 0 GROUP BY ALL),
e AS (SELECT g.target, d.doc_id AS other, quality IS NOT NULL AND quality = 1 AS labelled, round(coalesce(s, 0), 9) AS s FROM g JOIN documents d ON d.doc_id <> g.target LEFT JOIN p ON p.target = g.target AND p.other = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
o AS (SELECT target, other AS row, s FROM e WHERE labelled QUALIFY row_number() OVER (PARTITION BY target ORDER BY s DESC, other) = 1),
r AS (SELECT e.target, e.other AS row, e.s FROM e LEFT JOIN o ON o.target = e.target WHERE o.row IS NULL OR o.row <> e.other QUALIFY row_number() OVER (PARTITION BY e.target ORDER BY e.s DESC, e.other) = 1),
f AS (SELECT g.target, o.row AS labelled, {O.r6("o.s")} AS labelled_similarity, r.row AS other, {O.r6("r.s")} AS other_similarity FROM g LEFT JOIN o ON o.target = g.target LEFT JOIN r ON r.target = g.target)"""


def retrieved(spark, d):
    """Documents of good quality are the labelled rows; targets are the documents whose number is divisible by 20."""
    docs = P.table(spark, d, "documents")
    counts, n = C.counted_terms(docs, ["doc_id"], "text"), docs.count()
    df = C.document_counts(counts)
    packed = lambda rows: C.packed(C.term_weights(rows, df, n, ["doc_id"]), "doc_id", unit=True)
    good = written(P.table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("labelled")).distinct(), "labelled")
    pool = C.beside(packed(counts), good, "doc_id").withColumnRenamed("doc_id", "id")
    return R.nearest_packed(pool, packed(counts.where("doc_id % 20 = 0")).where("length(terms) > 0").withColumnRenamed("doc_id", "target"))


@query(f"WITH {SIMILAR} SELECT * FROM f")
def nearest_examples(spark, d):
    """For every target the nearest labelled document, and the nearest other one."""
    return r6(retrieved(spark, d))


@query(f"""WITH {SIMILAR}, c AS (SELECT source AS call, target, row_number() OVER (PARTITION BY source ORDER BY target) - 1 AS position, labelled, other FROM f JOIN documents ON doc_id = target),
x AS (SELECT call, example, min(pos) AS pos FROM (SELECT call, labelled AS example, 2 * position AS pos FROM c UNION ALL SELECT call, other, 2 * position + 1 FROM c) WHERE example IS NOT NULL GROUP BY ALL)
SELECT call, (row_number() OVER (PARTITION BY call ORDER BY pos) - 1)::INT AS place, example FROM x""")
def prompt_examples(spark, d):
    """The distinct examples of every call (a source's targets), in the order the targets bring them."""
    docs = P.table(spark, d, "documents").where("doc_id % 20 = 0")
    calls = docs.select(F.col("source").alias("call"), (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).alias("position"), F.col("doc_id").alias("target"))
    return R.examples(retrieved(spark, d), calls)


# ---- a drift study: null of leave-batch-out batches, thresholds, alarm rates with nested intervals

#: Contracts in a batch; batches of the null, of a set's point, and of a resample; resamples. The study's sizes are parameters.
K, NULL, POINT, RESAMPLES, INNER, ALPHA = 5, 200, 100, 60, 10, 0.01
SETS = ("test", "shift", "shift:en", "shift:fr")
PRIMARY = ("shift:en", "shift:fr")
LEVELS = {"ci": 0.95, "adjusted": 1 - 0.05 / (len(Y.families(P.MODELS)) * len(PRIMARY))}
N_BINS, N_LABELS, N_CONF = 10, len(P.LABELS), len(Y.CONFIDENCE_EDGES) + 1
COLUMNS = ["tokens", "oov", *(f"l{i}" for i in range(N_BINS)), *(f"{m}_{c}" for m in P.MODELS for c in ("parsed", "none", "failed", *(f"y{i}" for i in range(N_LABELS)), *(f"c{i}" for i in range(N_CONF))))]


def study(spark, d, asked=None):
    """(contracts' sums with ctype and split, products within each split, vectors), each written once. asked: the one split
    whose vectors are needed."""
    rows, vectors = P.drift_world(spark, d, asked)
    rows = written(rows, "drift-rows")
    edges = rows.where("split = 'val'").agg(F.percentile("n_chars", F.array(*(F.lit(i / 10) for i in range(1, N_BINS)))).alias("edges"))
    sums = written(Y.contract_sums(rows.crossJoin(F.broadcast(edges)), "contract", P.MODELS, P.LABELS, "edges", N_BINS - 1), "drift-sums")
    kinds = written(rows.select("contract", "ctype", "split").distinct(), "drift-kinds")
    return sums, kinds, written(vectors, "drift-vectors")


def of_split(df, kinds, where):
    return df.join(kinds.where(where).select("contract"), "contract", "left_semi")


def null_of(sums, kinds, vectors):
    """The validation set's own batches, each against all that it leaves."""
    val = "split = 'val'"
    own = of_split(sums, kinds, val)
    w = written(Y.batches(Y.positions(own, "contract"), K, NULL, "drift:null"), "drift-null")
    return Y.null_statistics(own, written(Y.gram(of_split(vectors, kinds, val), "contract"), "drift-gram"), w, "contract", P.MODELS, N_LABELS, N_BINS)


def picks(stream: str, k: int) -> str:
    """The places of one batch: of (g, n, b), columns p0.. by k steps."""
    out, before = "p_0", []
    sql = ["p_0 AS (SELECT * FROM sizes)"]
    for i in range(k):
        j = f"(n - {k - i})"
        t = f"CASE WHEN {j} >= 0 THEN {O.draw(stream, 'g', 'b', j)} % (greatest({j}, 0) + 1) END"
        taken = f"t{i} IN ({', '.join(before)})" if before else "false"
        sql.append(f"q_{i} AS (SELECT *, {t} AS t{i} FROM p_{i}), p_{i + 1} AS (SELECT *, CASE WHEN {j} < 0 THEN NULL WHEN {taken} THEN {j} ELSE t{i} END AS p{i} FROM q_{i})")
        before.append(f"p{i}")
        out = f"p_{i + 1}"
    return ", ".join(sql) + f", picked AS (SELECT g * {{n}} + b AS batch, g, unnest([{', '.join(before)}]) AS pos FROM {out})"


def weights_sql(members: str, n: int, stream: str, name: str) -> str:
    """name (batch, contract, w) of n batches for every group of members (g, contract, w)."""
    body = picks(stream, K).replace("{n}", str(n))
    for t in ["sizes", "picked", *(f"p_{i}" for i in range(K + 1)), *(f"q_{i}" for i in range(K))]:
        body = body.replace(f"{t} AS (", f"{name}_{t} AS (").replace(f"FROM {t})", f"FROM {name}_{t})")
    return f"""{name}_m AS (SELECT g, contract, row_number() OVER (PARTITION BY g ORDER BY contract, c) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, contract, unnest(range(w::BIGINT)) AS c FROM {members})),
{name}_sizes AS (SELECT g, n, unnest(range({n})) AS b FROM (SELECT DISTINCT g, n FROM {name}_m)), {body},
{name} AS (SELECT batch, contract, count(*) AS w FROM {name}_picked JOIN {name}_m USING (g, pos) GROUP BY ALL)"""


def world_sql() -> str:
    said = ", ".join(f"{O.draw(f'{m} fails', 'doc_id')} % 50 = 0 AS {m}_failed, " + ", ".join(f"0.8::DOUBLE * (({O.draw(m, chr(39) + x + chr(39), 'doc_id')} % 1000)::DOUBLE / 1000) + 0.2::DOUBLE * (split = 'shift')::INT AS {m}_p_{x}" for x in P.LABELS) for m in P.MODELS)
    cols = ["sum(n_tokens)::DOUBLE AS tokens", "sum(n_oov)::DOUBLE AS oov", *(f"count_if(lb = {i})::DOUBLE AS l{i}" for i in range(N_BINS))]
    for m in P.MODELS:
        some = " OR ".join(f"{m}_p_{x} >= 0.6" for x in P.LABELS)
        cols += [f"count_if(NOT {m}_failed)::DOUBLE AS {m}_parsed", f"count_if(NOT {m}_failed AND NOT ({some}))::DOUBLE AS {m}_none", f"count_if({m}_failed)::DOUBLE AS {m}_failed"]
        cols += [f"count_if(NOT {m}_failed AND {m}_p_{x} >= 0.6)::DOUBLE AS {m}_y{i}" for i, x in enumerate(P.LABELS)]
        cols += [f"count_if(NOT {m}_failed AND {m}_cb = {i})::DOUBLE AS {m}_c{i}" for i in range(N_CONF)]
    most = ", ".join("(" + " + ".join(f"(greatest({', '.join(f'{m}_p_{x}' for x in P.LABELS)}) >= {e}::DOUBLE)::INT" for e in Y.CONFIDENCE_EDGES) + f") AS {m}_cb" for m in P.MODELS)
    length = " + ".join(f"(n_chars >= edges[{i + 1}])::INT" for i in range(N_BINS - 1))
    deciles = ", ".join(f"quantile_cont(n_chars, {i / 10})" for i in range(1, N_BINS))
    return f"""docs AS (SELECT doc_id, source || '/' || lang AS contract, lang AS ctype, text, length(text) AS n_chars, CASE {O.draw("drift", "source || '/' || lang")} % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'shift' END AS split FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({O.TOKENS}) AS term FROM docs) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
vocab AS (SELECT term FROM tf JOIN docs USING (doc_id) WHERE split = 'val' GROUP BY term HAVING count(*) >= 2), cnt AS (SELECT doc_id, sum(tf) AS n_tokens, sum(CASE WHEN v.term IS NULL THEN tf ELSE 0 END) AS n_oov FROM tf LEFT JOIN vocab v ON v.term = tf.term GROUP BY doc_id),
w0 AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), n0 AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w0 GROUP BY 1),
cv AS (SELECT contract, term, sum(w / n) AS v FROM w0 JOIN n0 USING (doc_id) JOIN docs USING (doc_id) GROUP BY ALL),
edge AS (SELECT [{deciles}] AS edges FROM docs WHERE split = 'val'), sg AS (SELECT docs.*, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_oov, 0) AS n_oov, {said} FROM docs LEFT JOIN cnt USING (doc_id)),
sb AS (SELECT *, {length} AS lb, {most} FROM sg, edge), sums AS (SELECT contract, ctype, split, {", ".join(cols)} FROM sb GROUP BY ALL)"""


def psi_sql(b: list[str], r: list[str]) -> str:
    tb, tr, n = "(" + " + ".join(b) + ")", "(" + " + ".join(r) + ")", len(b)
    p, q = ([f"(({x} + 0.0001::DOUBLE) / ({t} + {n} * 0.0001::DOUBLE))" for x in xs] for xs, t in ((b, tb), (r, tr)))
    return f"CASE WHEN {tb} > 0 AND {tr} > 0 THEN " + " + ".join(f"({x} - {y}) * ln({x} / {y})" for x, y in zip(p, q, strict=True)) + " END"


def js_sql(b: list[str], r: list[str]) -> str:
    tb, tr = "(" + " + ".join(b) + ")", "(" + " + ".join(r) + ")"
    p, q = [f"({x} / nullif({tb}, 0))" for x in b], [f"({y} / nullif({tr}, 0))" for y in r]
    kl = [f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END" for u, v in ((p, q), (q, p)) for x, y in zip(u, v, strict=True)]
    return f"CASE WHEN {tb} > 0 AND {tr} > 0 THEN sqrt(greatest(({' + '.join(kl)}) / 2, 0)) END"


def stats_sql(weights: str, name: str, left_out: bool) -> str:
    """name (batch, stat, v): batches of `weights` against the validation set, recomputed from the vectors themselves."""
    side = lambda s, c, n: [f"{s}_{c}{i}" for i in range(n)]
    share = lambda a, n: f"b_{a} / nullif(b_{n}, 0) - r_{a} / nullif(r_{n}, 0)"
    values = {"oov_rate_diff": share("oov", "tokens"), "tfidf_centroid_distance": "1 - br / nullif(sqrt(bb * rr), 0)", "length_psi": psi_sql(side("b", "l", N_BINS), side("r", "l", N_BINS))}
    for m in P.MODELS:
        values |= {f"{m}:label_mix_js": js_sql(side("b", f"{m}_y", N_LABELS), side("r", f"{m}_y", N_LABELS)), f"{m}:none_share_diff": f"abs({share(f'{m}_none', f'{m}_parsed')})", f"{m}:confidence_psi": psi_sql(side("b", f"{m}_c", N_CONF), side("r", f"{m}_c", N_CONF))}
    less = (lambda c: f"t.{c} - b.{c}") if left_out else (lambda c: f"t.{c}")
    # Per term the batch's sum and what it leaves (or the whole reference).
    rest = "tv - bv" if left_out else "tv"
    return f"""{name}_t AS (SELECT {", ".join(f"sum({c}) AS {c}" for c in COLUMNS)} FROM sums WHERE split = 'val'),
{name}_b AS (SELECT batch, {", ".join(f"sum(w * {c}) AS {c}" for c in COLUMNS)} FROM {weights} JOIN sums USING (contract) GROUP BY batch),
{name}_tv AS (SELECT term, sum(v) AS tv FROM cv JOIN sums USING (contract) WHERE split = 'val' GROUP BY term), {name}_bv AS (SELECT batch, term, sum(w * v) AS bv FROM {weights} JOIN cv USING (contract) GROUP BY ALL),
{name}_d AS (SELECT batch, sum(bv * bv) AS bb, sum(bv * ({rest})) AS br, (SELECT sum(tv * tv) FROM {name}_tv) - sum(tv * tv) + sum(({rest}) * ({rest})) AS rr FROM (SELECT batch, bv, coalesce(tv, 0) AS tv FROM {name}_bv LEFT JOIN {name}_tv USING (term)) GROUP BY batch),
{name}_s AS (SELECT b.batch, {", ".join(f"b.{c} AS b_{c}, {less(c)} AS r_{c}" for c in COLUMNS)}, bb, br, rr FROM {name}_b b JOIN {name}_d USING (batch), {name}_t t),
{name} AS ({" UNION ALL ".join(f"SELECT batch, '{s}' AS stat, {v} AS v FROM {name}_s" for s, v in values.items())})"""


NULL_SQL = f"""{world_sql()}, val AS (SELECT 0 AS g, contract, 1 AS w FROM sums WHERE split = 'val'), {weights_sql("val", NULL, "drift:null", "wn")}, {stats_sql("wn", "nulls", True)}"""


@query(f"WITH {NULL_SQL} SELECT batch, stat, {O.r6('v')} AS v FROM nulls")
def leave_batch_out_null(spark, d):
    """Every statistic of every validation batch against the contracts that it leaves."""
    return r6(null_of(*study(spark, d, "val")))


FAMILY = {s: [s, *(f for f, members in Y.families(P.MODELS).items() if s in members)] for s in Y.statistics(P.MODELS)}
GROUPS_SQL = "grp AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{g}')" for s, gs in FAMILY.items() for g in gs) + ") AS x(stat, grp))"
LIMITS_SQL = f"""{GROUPS_SQL}, rn AS (SELECT stat, round(v, 12) AS v FROM nulls WHERE v IS NOT NULL), nn AS (SELECT stat, count(*) AS n FROM rn GROUP BY 1),
np AS (SELECT batch, a.stat, CASE WHEN a.v IS NULL THEN 1 ELSE (SELECT count(*) FROM rn WHERE rn.stat = a.stat AND rn.v >= round(a.v, 12))::DOUBLE / (SELECT n FROM nn WHERE nn.stat = a.stat) END AS p FROM nulls a),
ns AS (SELECT batch, grp, min(p) AS s FROM np JOIN grp USING (stat) GROUP BY ALL),
nsh AS (SELECT grp, s, sum(c) OVER (PARTITION BY grp ORDER BY s)::DOUBLE / {NULL} AS share FROM (SELECT grp, s, count(*) AS c FROM ns GROUP BY ALL)),
lim AS (SELECT grp, max(CASE WHEN share <= {ALPHA} THEN s END) AS threshold, coalesce(max(CASE WHEN share <= {ALPHA} THEN share END), 0) AS rate FROM nsh GROUP BY 1)"""


def rounded(stats):
    """Values to twelve places, so that ties don't hang on the order of sums."""
    return stats.withColumn("v", F.round("v", 12))


@query(f"WITH {NULL_SQL}, {LIMITS_SQL} SELECT grp AS \"group\", {O.r6('threshold')} AS threshold, {O.r6('rate')} AS null_alarm_rate FROM lim")
def drift_thresholds(spark, d):
    """Per family and statistic the tie-safe threshold on the least p-value, and the null's own rate of alarms."""
    null = written(rounded(null_of(*study(spark, d, "val"))), "drift-null-values")
    return r6(Y.thresholds(Y.scores(Y.p_values(null), P.MODELS), ALPHA))


def set_sql(key: str) -> tuple[str, str]:
    """CTEs for one set, and its row: point rate and both intervals per group."""
    part, _, kind = key.partition(":")
    name = key.replace(":", "_")
    where = f"split = '{part}'" + (f" AND ctype = '{kind}'" if kind else "")
    def flags(stats, out):
        return f"""{out}_p AS (SELECT batch, a.stat, CASE WHEN a.v IS NULL THEN 1 ELSE (1 + (SELECT count(*) FROM rn WHERE rn.stat = a.stat AND rn.v >= round(a.v, 12)))::DOUBLE / (1 + (SELECT n FROM nn WHERE nn.stat = a.stat)) END AS p FROM {stats} a),
{out} AS (SELECT batch, s.grp, coalesce(s.s <= threshold, false) AS alarm FROM (SELECT batch, grp, min(p) AS s FROM {out}_p JOIN grp USING (stat) GROUP BY ALL) s JOIN lim ON lim.grp = s.grp)"""
    body = f"""{name}_c AS (SELECT contract, ctype FROM sums WHERE {where}), {name}_one AS (SELECT 0 AS g, contract, 1 AS w FROM {name}_c), {weights_sql(f"{name}_one", POINT, f"drift:{key}", f"{name}_w")}, {stats_sql(f"{name}_w", f"{name}_v", False)}, {flags(f"{name}_v", f"{name}_a")},
{O.weights(f"{name}_c", "contract", "ctype", RESAMPLES, f"drift:boot:{key}", f"{name}_r")}, {name}_rg AS (SELECT resample AS g, contract, w FROM {name}_r), {weights_sql(f"{name}_rg", INNER, f"drift:inner:{key}", f"{name}_bw")}, {stats_sql(f"{name}_bw", f"{name}_bv2", False)}, {flags(f"{name}_bv2", f"{name}_ba")},
{name}_rate AS (SELECT batch // {INNER} AS resample, grp, avg(alarm::INT) AS rate FROM {name}_ba GROUP BY ALL)"""
    ends = ", ".join(f"quantile_cont(rate, {q}) AS {n}_{end}" for n, level in LEVELS.items() for end, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2)))
    row = f"SELECT '{key}' AS \"set\", p.grp AS \"group\", point, {', '.join(f'{n}_{e}' for n in LEVELS for e in ('low', 'high'))} FROM (SELECT grp, avg(alarm::INT) AS point FROM {name}_a GROUP BY 1) p JOIN (SELECT grp, {ends} FROM {name}_rate GROUP BY 1) i ON i.grp = p.grp"
    return body, row


_BODIES = [set_sql(k) for k in SETS]
RATES_SQL = f"{NULL_SQL}, {LIMITS_SQL}, {', '.join(b for b, _ in _BODIES)}, rates AS ({' UNION ALL '.join(r for _, r in _BODIES)})"


def rates_of(spark, d):
    """set, group, point rate of alarms, and its intervals, of all sets against the frozen null."""
    sums, kinds, vectors = study(spark, d)
    null = written(rounded(null_of(sums, kinds, vectors)), "drift-null-values")
    limits = written(Y.thresholds(Y.scores(Y.p_values(null), P.MODELS), ALPHA), "drift-limits")
    val = "split = 'val'"
    total = of_split(vectors, kinds, val).groupBy("term").agg(F.sum("weight").alias("t"))
    reference = of_split(sums, kinds, val).agg(*(F.sum(c).alias(c) for c in COLUMNS)).crossJoin(total.agg(F.sum(F.col("t") * F.col("t")).alias("rr")))
    reference = written(reference, "drift-reference")
    against = written(vectors.join(total, "term").groupBy(F.col("contract").alias("key")).agg(F.sum(F.col("weight") * F.col("t")).alias("d")), "drift-against")
    out = None
    for key in SETS:
        part, _, kind = key.partition(":")
        where = f"split = '{part}'" + (f" and ctype = '{kind}'" if kind else "")
        own, products = of_split(sums, kinds, where), written(Y.gram(of_split(vectors, kinds, where), "contract"), "drift-gram")
        contracts = kinds.where(where)
        one = Y.batches(Y.positions(contracts, "contract"), K, POINT, f"drift:{key}")
        boot = B.weights(contracts, "contract", "ctype", RESAMPLES, f"drift:boot:{key}")
        inner = Y.batches(Y.positions(boot, "contract", "w", "resample"), K, INNER, f"drift:inner:{key}")
        found = []
        for w, n in ((one, POINT), (inner, INNER)):
            values = rounded(Y.set_statistics(own, products, against, reference, written(w, "drift-batches"), "contract", P.MODELS, N_LABELS, N_BINS))
            found.append(Y.alarm_rates(Y.alarms(null, limits, written(values, "drift-values"), P.MODELS), n))
        row = found[0].select("group", F.col("rate").alias("point")).join(Y.rate_intervals(found[1], LEVELS), "group").select(F.lit(key).alias("set"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {RATES_SQL} SELECT a.\"set\", a.\"group\", {', '.join(f'{O.r6(f'a.{c}')} AS {c}' for c in ('point', *(f'{n}_{e}' for n in LEVELS for e in ('low', 'high'))))}, CASE WHEN a.\"set\" IN {PRIMARY!r} AND a.\"group\" IN {tuple(Y.families(P.MODELS))!r} THEN a.adjusted_low > t.adjusted_high END AS detects FROM rates a JOIN rates t ON t.\"set\" = 'test' AND t.\"group\" = a.\"group\"")
def drift_alarm_rates(spark, d):
    """Alarm rates of every set: by its own batches, and intervals of batches within resamples of its contracts; and, per
    family and primary set, whether the adjusted interval lies above that of test."""
    rates = written(rates_of(spark, d), "drift-rates")
    test = rates.where("set = 'test'").select("group", F.col("adjusted_high").alias("bound"))
    told = F.col("set").isin(*PRIMARY) & F.col("group").isin(*Y.families(P.MODELS))
    return r6(rates.join(test, "group").withColumn("detects", F.when(told, F.col("adjusted_low") > F.col("bound"))).drop("bound"))


# ---- a draw with rejections


def frame_candidates(spark, d):
    """(candidates, duplicates, weights of the strata): documents by language, with the reasons that refuse them. Texts are
    judged in place; what is shuffled are keys, hashes and reasons. Only documents that no reason of their own refuses are
    asked for duplicates, equal texts (of a shingle at least) as one, `same`."""
    docs = P.table(spark, d, "documents").withColumns(C.marker_rates(F.col("text")))
    items = written(C.shingle_rows(P.table(spark, d, "benchmark"), "item_id", "text"), "item-shingles")  # so that its size is known
    bench = C.containment(C.shingle_rows(docs, "doc_id", "text"), items, "doc_id", "item_id")
    overlap = bench.where("containment >= 0.5").select("doc_id", F.lit(True).alias("overlaps")).distinct()
    bare = F.array_join(F.regexp_extract_all("sentence", F.lit("([A-Za-z0-9]+)"), F.lit(1)), " ")
    sentences = written(C.longest_sentences(docs, "doc_id", "text").select("doc_id", F.md5(bare).alias("s")), "sentences")
    earliest = sentences.groupBy("s").agg(F.min("doc_id").alias("first_doc"))
    prior = sentences.join(earliest, "s").groupBy("doc_id").agg(((F.count("*") == 3) & F.bool_and(F.col("first_doc") < F.col("doc_id"))).alias("prior"))
    head = F.lower(F.substring("text", 1, 500))
    rules = [("too_short", F.length("text") < 500), ("too_long", F.length("text") > 20000), ("amendment", head.rlike("amend") & ~head.contains("amended and restated")), ("form_or_template", F.col("blank_markers") >= 3), ("redacted", F.col("per_1000") > 1)]
    docs = docs.withColumn("own", C.first_reason(rules))
    passed = docs.where("own is null").select("doc_id", "text")
    equal = passed.where(F.size(T.words(F.col("text"))) >= 8).select("doc_id", F.sha2("text", 256).alias("_d"))
    equal = equal.select("doc_id", F.min("doc_id").over(W.partitionBy("_d")).alias("least")).where("least < doc_id")
    rows = docs.select("doc_id", "lang", "own").join(overlap, "doc_id", "left").join(prior, "doc_id", "left").join(equal, "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("key"), F.col("lang").alias("stratum"), F.coalesce("own", F.when(F.col("overlaps"), "overlap")).alias("first"), F.when(F.col("prior"), "prior_appearance").alias("later"), F.coalesce("least", "doc_id").alias("same"))
    labels = P.table(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))
    return rows, C.contained_pairs(C.without_copies(passed, "doc_id", "text"), "doc_id", "text", 0.8).select("a", "b"), {x.lang: x.n for x in labels.collect()}


@query()
def frame_draw(spark, d):
    """The log of a draw of sixty documents over the languages in the shares of the labelled ones."""
    rows, pairs, counts = frame_candidates(spark, d)
    return V.draw_frame(written(rows, "frame-candidates"), pairs, counts, 60)


# ---- baseline models

TRAITS = ["quality", "toxic"]
SETTINGS = [A.Setting(1, w, c) for w in (False, True) for c in (1.0, 10.0)]


def labelled(spark, d):
    """id, text, split and the two traits of every labelled document."""
    labels = P.table(spark, d, "labels").select("doc_id", *((F.col(x) == 1).alias(x) for x in TRAITS))
    part = draw("baseline", "doc_id") % 5
    rows = P.table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")
    return written(rows.select(F.col("doc_id").alias("id"), "text", F.when(part < 3, "train").when(part == 3, "val").otherwise("test").alias("split"), *TRAITS), "labelled")


def r4(df):
    return df.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query()
def baseline_search(spark, d):
    """The log of one-vs-rest models over a grid of settings, and which one is chosen."""
    return r4(A.search(labelled(spark, d), "text", TRAITS, SETTINGS))


@query()
def baseline_test(spark, d):
    """Per trait the average precision of a model on test documents, and that of guessing (the share of the trait)."""
    rows = labelled(spark, d)
    features, _ = A.vectors(rows.select("id", (F.col("split") == "train").alias("train"), "text"), "text", 1)
    both = written(features.join(rows.drop("text"), "id"), "labelled-vectors")
    test = written(A.scored(both.where("split = 'train'"), both.where("split = 'test'"), TRAITS, A.Setting(c=10.0)), "test-scores")
    share = test.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("guess"))
    return r4(M.average_precision(test, ["label"]).join(share, "label"))


# ---- runs of paid calls

PRICES = {"input": 3.0, "written": 3.75, "output": 15.0}
CAP, OUTPUT = 1.0, 400
#: A user's turn is a call; every third one, by draw, is answered already, one in five of those not validly.
CALLS_SQL = f"""calls AS (SELECT conv_id || ':' || turn AS key, (length(text) / 3.0::DOUBLE * 3.75 + {OUTPUT} * 15.0) / 1000000 AS worst FROM conversations WHERE role = 'user'),
att AS (SELECT key, 1 AS attempt, {O.draw("valid", "key")} % 5 > 0 AS ok, worst * ({O.draw("cost", "key", "1")} % 100)::DOUBLE / 100 AS cost FROM calls WHERE {O.draw("sent", "key")} % 3 = 0)"""


def paid_calls(spark, d):
    """(calls, attempts so far)."""
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    calls = P.table(spark, d, "conversations").where("role = 'user'").select(key.alias("key"), L.worst_cost(F.length("text"), PRICES, OUTPUT).alias("worst"))
    return calls, sent(calls.where(draw("sent", "key") % 3 == 0).withColumn("attempt", F.lit(1)))


def sent(calls):
    """The stub of a service: what an attempt cost, and whether its answer was valid, by draw."""
    cost = F.col("worst") * (draw("cost", "key", "attempt") % 100).cast("double") / 100
    ok = F.when(F.col("attempt") == 1, draw("valid", "key") % 5 > 0).otherwise(draw("again", "key") % 2 == 0)
    return calls.select("key", "attempt", ok.alias("ok"), cost.alias("cost"))


@query(f"""WITH {CALLS_SQL}, p AS (SELECT c.key, worst, CASE WHEN a.key IS NULL THEN 1 ELSE 2 END AS attempt FROM calls c LEFT JOIN att a ON a.key = c.key WHERE a.key IS NULL OR NOT a.ok),
r AS (SELECT *, sum(worst) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS reserved, (SELECT coalesce(sum(cost), 0) FROM att) AS paid FROM p)
SELECT key, attempt, round(worst, 9) AS worst, round(reserved, 9) AS reserved, paid + reserved <= {CAP} AS admitted FROM r""")
def admitted_calls(spark, d):
    """The calls that still have to be sent, and which of them the budget admits by their worst cost."""
    calls, attempts = paid_calls(spark, d)
    rows = L.admitted(L.pending(calls, attempts), attempts, CAP)
    return rows.select("key", "attempt", F.round("worst", 9).alias("worst"), F.round("reserved", 9).alias("reserved"), "admitted")


@query()
def settled_run(spark, d):
    """All attempts when a run has ended, for lack of calls or of money."""
    calls, attempts = paid_calls(spark, d)
    return L.run(written(calls, "calls"), written(attempts, "attempts"), sent, CAP)[0].withColumn("cost", F.round("cost", 9))


FRAME_SQL = f"""t AS (SELECT doc_id AS segment_id, source || '#' || ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5) AS call FROM documents),
a AS (SELECT call, unnest(range(1, 2 + ({O.draw("tries", "call")} % 4 = 0)::INT)) AS attempt FROM (SELECT DISTINCT call FROM t)), b AS (SELECT *, ({O.draw("paid", "call", "attempt")} % 1000)::DOUBLE / 1000 AS cost, ({O.draw("took", "call", "attempt")} % 9000)::DOUBLE AS latency_ms FROM a),
c AS (SELECT call, sum(cost) AS cost, max_by(latency_ms, attempt) AS call_latency FROM b GROUP BY 1), n AS (SELECT call, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT *, {O.draw("fails", "segment_id")} % 20 = 0 AS parse_failure, {", ".join(f"CASE WHEN {O.draw('fails', 'segment_id')} % 20 > 0 AND {O.draw('said', chr(39) + x + chr(39), 'segment_id')} % 3 = 0 THEN ({O.draw('score', chr(39) + x + chr(39), 'segment_id')} % 100)::DOUBLE / 100 ELSE 0 END AS p_{x}" for x in P.LABELS)} FROM t)"""


@query(f"""WITH {FRAME_SQL} SELECT segment_id, call, {O.r6('cost / n')} AS cost, {O.r6('call_latency / n')} AS latency, call_latency, parse_failure, [{", ".join(f"p_{x}" for x in P.LABELS)}] AS proba,
list_filter([{", ".join(f"CASE WHEN p_{x} >= 0.5 THEN '{x}' END" for x in P.LABELS)}], lambda x: x IS NOT NULL) AS pred_labels FROM s JOIN n USING (call) JOIN c USING (call)""")
def call_frame(spark, d):
    """Documents as targets of calls of five: their shares of cost and latency, and dense scores in label order."""
    docs = P.table(spark, d, "documents")
    place = F.floor((F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1) / 5)
    targets = written(docs.select(F.col("doc_id").alias("segment_id"), F.concat_ws("#", "source", place.cast("string")).alias("call")), "targets")
    tries = F.sequence(F.lit(1), F.when(draw("tries", "call") % 4 == 0, 2).otherwise(1))
    attempts = targets.select("call").distinct().select("call", F.explode(tries).alias("attempt"))
    attempts = attempts.select("call", "attempt", ((draw("paid", "call", "attempt") % 1000).cast("double") / 1000).alias("cost"), (draw("took", "call", "attempt") % 9000).cast("double").alias("latency_ms"))
    said = [F.struct(F.lit(x).alias("label"), (draw("said", F.lit(x), "segment_id") % 3 == 0).alias("said"), ((draw("score", F.lit(x), "segment_id") % 100).cast("double") / 100).alias("score")) for x in P.LABELS]
    parsed = targets.where(draw("fails", "segment_id") % 20 > 0)
    scores = parsed.select("call", "segment_id", F.explode(F.array(*said)).alias("s")).where("s.said").select("call", "segment_id", "s.label", "s.score")
    none = parsed.select("call", "segment_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"))
    return r6(L.call_frame(targets, attempts, scores.unionByName(none), P.LABELS, {}))
