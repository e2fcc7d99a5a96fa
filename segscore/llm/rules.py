"""Quality rules with adaptive thresholds.

Every document gets the fixed base measures and some ratios. The ratios go into mergeable quantile sketches per
(lang, source): counts over logarithmic bins of a bounded relative error, so that sketches of parts, of a language, and
of all documents are sums of counts. A document is rejected where a ratio lies, on a logarithmic scale, further from its
group's median than a multiple of the distance from the median to the quartile on that side: the group's own spread, which
junk in up to a quarter of it cannot move, is all that a bound comes from. The quantiles of a group are blended with those
of its language, and these with those of all documents, each by the number of documents behind it, so that small groups
lean on larger ones and none is left out.

Counts that are mostly zero enter by what they surely exceed (a count less its square root, so that one symbol or one
repeated line is no evidence) with half an occurrence added to count and size. Then a text without any has a ratio too,
the smaller the longer it is, and a group without symbols still has a spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, saved, slices, texts, tidy

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The ratios; those held against thresholds, with the multiple of the quartile's distance at which their bounds lie.
RATIOS = {
    "symbols": "(n_symbols - sqrt(n_symbols) + 0.5) / (n_words + 0.5)",
    "dup_lines": "(n_dup_lines - sqrt(n_dup_lines) + 0.5) / (n_lines + 0.5)",
    "word_length": "word_chars / n_words",
    "words": "n_words",
}
SPREAD = {"symbols": 4.0, "dup_lines": 2.5, "word_length": 6.0}
GROWTH = 1.002
#: Words that a task numbers before it starts anew, and the weight of the larger group in a blend, in documents.
MEMO, PRIOR = 200_000, 200


def repeated_words(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Per document, its words that lie in windows found twice or more in it. ids: the words of all, one after another."""
    ends = np.append(starts[1:], len(ids))
    out = np.zeros(len(starts), np.int64)
    n = len(ids) - width + 1
    if n <= 0:
        return out
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    whole = doc[:n] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    h = doc[at].astype(np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[at + i].astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(at), bool)
    a, b = at[order[1:][same]], at[order[:-1][same]]
    equal = doc[a] == doc[b]
    for i in range(width):
        equal &= ids[a + i] == ids[b + i]
    if not equal.all():  # two windows share a hash: count these the plain way
        seen: dict[tuple, list[int]] = {}
        for k, p in enumerate(at):
            seen.setdefault((doc[p], *ids[p : p + width]), []).append(k)
        for group in seen.values():
            twice[group] = len(group) > 1
    else:
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    hit = at[twice]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    np.add.at(out, doc, (np.cumsum(cover[:-1]) > 0).astype(np.int64))
    return out


def measure(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns as _k0, _k1, ..., the number of non-blank lines, and the base measures of every row's whole text.

    A null text has no words, lines or symbols.
    """
    names = [f"_k{i}" for i in range(len(columns))]
    at = columns.index(text) if text in columns else len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, f"_k{at}", 4 << 20):
            ids, starts, rows, total = [], [], [], 0
            if len(known) > MEMO:
                known.clear()
            for body in texts(batch, f"_k{at}"):
                words = body.encode().split()
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                starts.append(total)
                total += len(words)
                lines = [x for x in body.split("\n") if x.strip(SPACES)]
                rows.append((len(lines), len(words), len(body) - sum(map(body.count, SPACES)), sum(map(body.count, SYMBOLS)), len(lines) - len(set(lines))))
            repeats = repeated_words(np.concatenate(ids), np.array(starts), width=5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(repeats)], names=[*names, "n_lines", *BASE])

    given = columns if text in columns else [*columns, text]
    rows = pick(docs, **{f"_k{i}": c for i, c in enumerate(given)})
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(columns)]] + [f"{c} long" for c in ("n_lines", *BASE)]
    return rows.mapInArrow(tidy(run), ", ".join(fields))


def sketch(values: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group, metric and logarithmic bin, from rows of (by..., metric, x, n). Bins of parts add up."""
    bin_ = F.when(F.col("x") > 0, F.ceil(F.log(F.col("x")) / F.lit(float(np.log(GROWTH)))).cast("int"))
    return values.withColumn("bin", F.coalesce(bin_, F.lit(-(10**6)))).groupBy(*by, "metric", "bin").agg(F.sum("n").cast("long").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "metric", "bin").agg(F.sum("n").cast("long").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """A group's total and its quantiles, each within a factor GROWTH of an exact one. A group is a few hundred bins."""
    w = W.partitionBy(*by, "metric")
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = sketches.withColumn("upto", upto).withColumn("total", F.sum("n").over(w))
    value = F.when(F.col("bin") == -(10**6), F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), F.col("bin")))
    return rows.groupBy(*by, "metric").agg(F.first("total").alias("total"), *(F.min(F.when(F.col("upto") >= F.col("total") * q, value)).alias(name) for name, q in at.items()))


def thresholds(measured: DataFrame, prior: float) -> DataFrame:
    """lang, source, and per ratio the logarithms of its blended quartiles: <ratio>_low, <ratio>_mid, <ratio>_high."""
    long = measured.where("n_words > 0").select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(e).cast("double").alias("x")) for m, e in RATIOS.items()))).alias("v"), F.lit(1).alias("n")).select("lang", "source", "v.metric", "v.x", "n")
    fine = saved(sketch(long, ["lang", "source"]), "quantile-sketches")
    at = {"low": 0.25, "mid": 0.5, "high": 0.75}
    group = quantiles(fine, ["lang", "source"], at)
    lang = quantiles(merged(fine, ["lang"]), ["lang"], at).select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), *(F.col(c).alias(f"l_{c}") for c in ("total", *at)))
    every = quantiles(merged(fine, []), [], at).select(F.col("metric").alias("a_metric"), *(F.col(c).alias(f"a_{c}") for c in at))
    both = group.join(lang, group["lang"].eqNullSafe(lang["l_lang"]) & (group["metric"] == lang["l_metric"])).join(F.broadcast(every), F.col("metric") == F.col("a_metric"))  # `every` has a row per ratio

    def blended(c: str) -> Column:
        whole = (F.col("l_total") * F.log(f"l_{c}") + prior * F.log(f"a_{c}")) / (F.col("l_total") + prior)
        return (F.col("total") * F.log(c) + prior * whole) / (F.col("total") + prior)

    rows = both.select("lang", "source", "metric", *(blended(c).alias(c) for c in at))
    # Saved, so that the planner knows its size: a small table goes to the rows, a large one is joined by shuffle.
    return saved(rows.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in RATIOS for c in at)), "bounds", (fine,))


def verdicts(measured: DataFrame, narrow: DataFrame, spread: dict[str, float], prior: float, salts: int) -> DataFrame:
    """measured (any columns, _lang, _source and the measures) with base_failed and kept; narrow: lang, source, measures."""
    bounds = thresholds(narrow, prior)
    # Beyond the size of a broadcast, a hot source meets its bounds in `salts` tasks: these are repeated, rows are dealt out.
    salted = measured.withColumn("_s", F.pmod(F.xxhash64("_k0", *BASE), F.lit(salts)))
    null = F.lit("\0null")
    known = [c for c in bounds.columns if c not in ("lang", "source")]
    bounds = bounds.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    bounds = bounds.select("_s", F.coalesce("lang", null).alias("_l"), F.coalesce("source", null).alias("_o"), *known)
    joined = salted.withColumn("_l", F.coalesce("_lang", null)).withColumn("_o", F.coalesce("_source", null)).join(bounds, ["_s", "_l", "_o"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))

    def beyond(metric: str, end: str, wide: Column) -> Column:
        """How far the ratio's logarithm lies beyond the bound on the side of a quartile; over 0: outside."""
        x = F.log(F.expr(f"CASE WHEN n_words > 0 THEN {RATIOS[metric]} END").cast("double"))
        mid, quartile = F.col(f"{metric}_mid"), F.col(f"{metric}_{end}")
        sign = 1 if end == "high" else -1
        return sign * (x - mid) - spread[metric] * sign * (quartile - mid) * wide

    # A mean over few words varies more: the spread of a text shorter than its group's median grows as that of a mean does.
    wide = F.greatest(F.lit(1.0), F.sqrt(F.exp("words_mid") / F.nullif(F.col("n_words"), F.lit(0))))
    one = F.lit(1.0)
    faults = [(F.col("n_symbols") > 1) & (beyond("symbols", "high", one) > 0), (F.col("n_dup_lines") > 1) & (beyond("dup_lines", "high", one) > 0)]
    faults += [beyond("word_length", end, wide) > 0 for end in ("low", "high")]
    good = ~failed
    for fault in faults:
        good = good & ~F.coalesce(fault, F.lit(False))
    return joined.withColumn("base_failed", failed).withColumn("kept", good)


def judge(docs: DataFrame, spread: dict[str, float] = SPREAD, prior: float = PRIOR, salts: int = 16) -> DataFrame:
    """doc_id, lang, source, the base measures, base_failed, kept for every row.

    base_failed: under 10 words, or more than a fifth of the words lie in repeated 5-word windows. kept: not failed, and
    every ratio lies within its group's thresholds; a text without symbols (repeated lines), or with one, is never too rich
    in them. Null lang or source is a group like any other. A null or empty text
    fails for lack of words; repeated rows are judged each; an empty table gives no rows; further columns are ignored.
    """
    measured = saved(measure(docs, ["doc_id", "lang", "source"]).withColumnsRenamed({"_k1": "lang", "_k2": "source"}), "measures")
    rows = measured.withColumns({"_lang": F.col("lang"), "_source": F.col("source")})
    return verdicts(rows, measured, spread, prior, salts).select(F.col("_k0").alias("doc_id"), "lang", "source", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, spread: dict[str, float] = SPREAD, prior: float = PRIOR, salts: int = 16) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever the names.

    A null or empty text goes for lack of words; every row is judged for itself, so that of repeated rows all stay or
    all go; an empty table stays empty. The rows are measured and written once, and judged where they lie.
    """
    measured = saved(measure(docs, docs.columns), "measured-rows")
    lang, source = (F.col(f"_k{docs.columns.index(c)}") for c in ("lang", "source"))
    rows = measured.withColumns({"_lang": lang, "_source": source})
    narrow = measured.select(lang.alias("lang"), source.alias("source"), "n_lines", *BASE)
    return verdicts(rows, narrow, spread, prior, salts).where("kept").select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)))
